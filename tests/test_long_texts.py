"""Regex signals see all of a long text."""

from docintake.config import Condition
from docintake.operators import signals


def test_match_after_200000_characters(spark):
    rows = [(1, "word " * 60_000 + "Total R$ 1.234,00"), (2, "word " * 60_000)]
    docs = signals.haystacks(spark.createDataFrame(rows, "document_id long, full_text string"))
    # the second and third pattern go to the helper; the last one spans nearly the whole text
    for pattern in (r"\d\.\d{3},", r"(?<=r)\$", r"(?<=^)word.*1\.234", r"^word(?= ).*,00$"):
        found = docs.orderBy("document_id").select(signals.condition(Condition("regex", pattern)).alias("found"))
        assert [r.found for r in found.collect()] == [True, False], pattern
