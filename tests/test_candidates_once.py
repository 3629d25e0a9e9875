"""Candidates of ambiguous documents are picked behind the matching, which is evaluated once for each document."""

from docintake.config import Condition, Template
from docintake.operators import signals

TEMPLATES = [Template(k, str(k), ((Condition("regex", p),),)) for k, p in enumerate((r"\bab?c\b", r"\bac+\b", "z"), 1)]


def test_no_filter_holds_the_matching(spark):
    texts = [(0, "abc ac"), (1, "abc"), (2, ""), (3, None), (4, "ac")]
    docs = signals.haystacks(spark.createDataFrame(texts, "document_id long, full_text string"))
    found = signals.ambiguous_candidates(signals.decide(signals.match_templates(docs, TEMPLATES)))
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 2), (4, 1), (4, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") and not any("RLIKE" in line for line in plan.splitlines() if "Filter" in line)
