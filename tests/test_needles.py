"""Thousands of needles against the compiled form and against plain substring search."""

import random
import time

from docintake.config import Condition, Template
from docintake.operators import needles, signals

TEXTS = ["Nota Fiscal nº 12 valor R$ 10,00", "", None, "  DANFE ﬁscal\nnota", "c" * 300, "Olá, mundo: nota-fiscal!", "ab abc abcd", "٣ x ½"]


def hits(docs):
    return {r.document_id: [m.template_id for m in r.matches if m.confidence > 0] for r in docs.collect()}


def test_equals_the_compiled_form(spark, monkeypatch):
    r = random.Random(4)
    docs = signals.haystacks(spark.createDataFrame(list(enumerate(TEXTS)), "document_id int, full_text string"))
    some = [("texto", v) for v in ("nota fiscal", "NOTA", "R$", "nº", "abc", "bcd", "", " ", "ab", "!", "danfe", "fiscal nota", "cccc")] + [("regex", v) for v in (r"\d+,\d{2}", "([", r"nota\W+fiscal", "")] + [("other", "mundo")]
    made = [Template(k, str(k), tuple(tuple(Condition(*r.choice(some)) for _ in range(r.randrange(4))) for _ in range(r.randrange(3)))) for k in range(120, 0, -1)]
    want = hits(signals.match_templates(docs, made))
    for most in (needles.MOST_CHARACTERS, 12):
        monkeypatch.setattr(needles, "MOST_CHARACTERS", most)
        found = needles.match_many(docs, made)
        assert hits(found) == want and found.columns == [*docs.columns, "matches"]
    both = [{row.document_id: (row.decision, row.template_id) for row in signals.decide(f(docs, made)).collect()} for f in (needles.match_many, signals.match_templates)]
    assert both[0] == both[1]
    assert hits(needles.match_many(docs, [])) == {k: [] for k in range(len(TEXTS))}


def test_twenty_thousand_needles(spark, sf):
    r = random.Random(6)
    texts = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as document_id", "text as full_text")
    docs = signals.haystacks(texts).cache()
    plain = {row.document_id: row.normalised for row in docs.collect()}
    long = "".join(plain.values())
    words = {long[i : i + r.randrange(4, 20)].strip() for i in (r.randrange(len(long)) for _ in range(20_000))} | {f"absent {k}" for k in range(5_000)}
    wanted = sorted(w for w in words if len(w) >= 3)
    assert len(wanted) > 20_000
    began = time.time()
    got = hits(needles.match_many(docs, [Template(k, w, ((Condition("texto", w),),)) for k, w in enumerate(wanted)]))
    assert time.time() - began < 60
    for document_id in list(plain)[::20]:
        assert got[document_id] == [k for k, w in enumerate(wanted) if w in plain[document_id]]
