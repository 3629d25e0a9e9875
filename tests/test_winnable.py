import random

from docintake.config import Automation
from docintake.config import RuleCondition as C
from docintake.operators import rule_tables, rules
from test_rule_tables import documents


def test_rules_that_never_win_are_left_out(spark):
    r = random.Random(3)
    name, pdf, most, least = C("field", "eq", "acme", "a"), C("extension", "eq", "pdf"), C("size", "gt", "4"), C("size", "lt", "4")
    sets = [(name,), (name, pdf), (pdf, name), (name, most), (name, pdf, most), (most,), (name, pdf, least)]
    made = [Automation(k, r.randrange(20, 60), sets[k % len(sets)]) for k in range(140)] + [Automation(500, 10, (name, pdf)), Automation(501, 10, (pdf, name))]
    docs = documents(spark, r, 300).cache()
    want = {x.document_id: x.automation_id for x in rules.evaluate_automations(docs, made).collect()}
    heads, rows = rule_tables.rule_tables(spark, made)
    assert {x.document_id: x.rule_id for x in rule_tables.first_matching(docs, heads, rows).collect()} == want and len(set(want.values())) > 2

    ways = rule_tables._read(rows).withColumn("way", rule_tables.F.lit(0)).groupBy("rule_id", "way").agg(rule_tables.F.collect_list("c").alias("all")).join(heads.select("rule_id", "position"), "rule_id")
    left = {x.rule_id for x in rule_tables.winnable(ways).collect()}
    assert 500 in left and 501 not in left and len(left) <= 4
