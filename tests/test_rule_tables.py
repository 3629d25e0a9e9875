"""Rules as tables against the compiled form and against plain Python."""

import random
import time
from decimal import Decimal, InvalidOperation


from docintake.config import Automation, Rule, RuleCondition
from docintake.operators import rule_tables, rules

C = RuleCondition
DOCS = "document_id long, fields map<string,string>, ext string, source_folder string, original_filename string, size long, template_id long"


def documents(spark, r, n):
    word = lambda: r.choice(["Acme", "ACME ltda", "ﬁnance", "µ", "straße", "", " ", "12", "12.0", "1e1", "-3", "2024-01-05", "NaN", " x "])
    rows = [
        (i, r.choice([None, {}, {n: word() for n in r.sample(["a", "b", "c"], r.randrange(4))}]), r.choice([None, "", ".PDF", "jpg", " .png "]), r.choice([None, "", "/in/A", "/in/ab"]), r.choice([None, "Nota 1.pdf", "ß.PDF"]), r.choice([None, 0, 5, 1500]), r.choice([None, 1, 2]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, DOCS)


def conditions(r):
    value = r.choice([" acme ", "FINANCE", "ΜU", "STRASSE", "", "12", "012.00", "10", "abc", "-1e1", "2024-01-04", "nan", "pdf, JPG", ".", "/IN/a", "n", "1500", "2", None, "µ", "no"])
    return C(r.choice(["field", "field", "field", "extension", "source_folder", "filename", "size", "template", "colour"]), r.choice(["eq", "contains", "gt", "lt", "like"]), value, r.choice(["a", "b", "c", None]))


def test_equals_the_compiled_form(spark):
    r = random.Random(8)
    docs = documents(spark, r, 300).cache()
    made = [Automation(k, r.randrange(9), tuple(conditions(r) for _ in range(r.choice([0, 1, 1, 2, 3]))), (), r.random() < 0.9) for k in range(60)]
    want = {x.document_id: x.automation_id for x in rules.evaluate_automations(docs, made).collect()}
    heads, rows = rule_tables.rule_tables(spark, made)
    got = rule_tables.first_matching(docs, heads, rows).collect()
    assert {x.document_id: x.rule_id for x in got} == want and len(got) == 300 and len(set(want.values())) > 2


def test_rules_joined_by_or(spark):
    r = random.Random(9)
    docs = documents(spark, r, 200).cache()
    made = [Rule(k, r.randrange(9), tuple(C("field", r.choice(["eq", "contains", "gt"]), r.choice(["acme", "12", "x", "-5"]), r.choice("abc")) for _ in range(r.randrange(4))), r.choice(["and", " OR ", ""])) for k in range(15)]
    want = {x.document_id: x.rule_id for x in docs.select("document_id", rules.first_matching_rule(made).alias("rule_id")).collect()}
    got = rule_tables.first_matching(docs, *rule_tables.rule_tables(spark, made)).collect()
    assert {x.document_id: x.rule_id for x in got} == want


def test_no_rules(spark):
    docs = documents(spark, random.Random(1), 5)
    for made in ([], [Rule(1, 1)], [Rule(1, 1, (C("colour", "eq", "x"),))]):
        got = rule_tables.first_matching(docs, *rule_tables.rule_tables(spark, made)).collect()
        assert [x.rule_id for x in got] == [None] * 5
    assert rule_tables.first_matching(docs.limit(0), *rule_tables.rule_tables(spark, [Rule(1, 1, (C("field", "eq", "x", "a"),))])).count() == 0


def slow(doc, made):
    def decimal(x):
        try:
            return Decimal(x)
        except InvalidOperation:
            return None

    for a in made:
        for c in a.conditions:
            v = doc[c.field_name]
            if not (v.casefold() == c.value.casefold() if c.operator == "eq" else c.value.casefold() in v.casefold() if c.operator == "contains" else decimal(v) > decimal(c.value)):
                break
        else:
            return a.automation_id
    return None


def test_ten_thousand_automations(spark):
    """The plan has the same size as for ten, one value is shared by all documents and all rules, and it ends in seconds."""
    r = random.Random(3)
    names = [f"Cliente {k:05d}" for k in range(9_000)]
    made = []
    for k in range(10_000):
        own = [C("field", "eq", "BR", "pais"), C("field", "gt", str(r.randrange(1000)), "valor")]
        own.append(C("field", "eq", r.choice(names).upper(), "cliente") if k % 4 else C("field", "contains", r.choice(names)[-4:], "cliente"))
        made.append(Automation(k, k, tuple(own)))
    rows = [(i, {"pais": "br", "valor": str(r.randrange(1000)), "cliente": r.choice(names)}, ".pdf", "/in", "n.pdf", 1, 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    sizes = []
    for n in (10, 10_000):
        began = time.time()
        found = rule_tables.first_matching(docs, *rule_tables.rule_tables(spark, made[:n]))
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        got = {x.document_id: x.rule_id for x in found.collect()}
        assert time.time() - began < 90
    assert sizes[0] == sizes[1]
    for i, fields, *_ in rows[::10]:
        assert got[i] == slow(fields, made)
    assert sum(x is not None for x in got.values()) > 500
