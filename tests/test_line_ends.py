"""A dot in a pattern of the user stops at a line feed only, as in Python and RE2, not at Java's further line ends."""

from docintake.config import Condition
from docintake.functions import validate
from docintake.operators import signals


def test_dot_crosses_other_line_ends(spark):
    texts = ["und\rder", "und x\x85y der", "und   der", "und\nder", "und der"]
    docs = signals.haystacks(spark.createDataFrame(list(enumerate(texts)), "document_id int, full_text string"))
    got = [r[0] for r in docs.orderBy("document_id").select(signals.condition(Condition("regex", r"\bund\b.*\bder\b"))).collect()]
    assert got == [True, True, True, False, True]


def test_dot_of_field_patterns(spark):
    raw = spark.createDataFrame([(0, "a\rb"), (1, "a b"), (2, "a\nb")], "k int, raw string")
    assert [r[0] for r in raw.orderBy("k").select(validate.regex_ok(raw.raw, "a.b")).collect()] == [True, True, False]
