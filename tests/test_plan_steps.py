"""Rules and names: what is the same for all rows is worked out once, and short cuts say what the long way says."""

from decimal import Decimal, InvalidOperation

from pyspark.sql import functions as F

from docintake.config import Action, Automation
from docintake.functions import naming, text
from docintake.operators import filing, rules

VALUES = ["5", " 5 ", "05", "-5", "5.0", "4.999999999", "4.9999999999", "5.000000001", "5e0", "1_0", "inf", "-inf", "nan", "", " ", "x", "-", "5.", ".5", "٥", "5\n", "999999999999999999", "9999999999999999999", "-0", None]
TARGETS = ["5", "5.0", "-0", "5e0", "1e30", "inf", "4.9999999999", "٥", "1_0", "nan", "abc"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def expected(value, target, wanted):
    if value is None or not value.strip():
        return False
    try:
        a, b = Decimal(value.strip().replace("_", "")), Decimal(target.replace("_", ""))
        if not (a.is_nan() or b.is_nan()):
            return (a > b) - (a < b) == wanted
    except InvalidOperation:
        pass
    a, b = value.strip(), target
    return (a > b) - (a < b) == wanted


def test_numbers_against_targets(spark):
    rows = spark.createDataFrame(list(enumerate(VALUES)), "i int, v string")
    ops = {"gt": 1, "lt": -1}
    found = rows.select("i", *[rules.evaluate_condition(F.col("v"), op, t).alias(f"{op} {t}") for op in ops for t in TARGETS]).collect()
    for r in found:
        for op, wanted in ops.items():
            for t in TARGETS:
                assert r[f"{op} {t}"] == expected(VALUES[r.i], t, wanted), (VALUES[r.i], op, t)


def test_targets_are_not_read_for_each_row(spark):
    rows = spark.createDataFrame([("5",)], "v string")
    assert "lambdafunction" not in plan(rows.select(rules.evaluate_condition(F.col("v"), "gt", "abc")))
    assert "200000], lambda" not in plan(rows.select(rules.evaluate_condition(F.col("v"), "gt", "200000"))).replace("(200000)", "200000]")


def test_names_are_columns_of_their_own(spark):
    docs = spark.createDataFrame([(1, 1, {"a": "CON"}, "/in", "n.pdf"), (2, 1, {}, "/in", "n.pdf"), (3, None, {"a": "x"}, "/in", "n.pdf")], "document_id long, automation_id long, fields map<string,string>, default_folder string, default_name string")
    a = Automation(1, 1, (), (Action(1, "rename", {"name_pattern": "{a}"}), Action(2, "move", {"dest_folder": "/x/{a}"})))
    out = filing.apply_actions(docs, [a], "/base")
    assert out.columns == [*docs.columns, "blocked", "has_move", "outputs"]
    assert [(r.blocked, r.has_move, [tuple(o) for o in r.outputs]) for r in out.orderBy("document_id").collect()] == [(False, True, [("move", "/x/_CON", "_CON")]), (True, True, []), (False, False, [])]
    assert "default_folder, default_folder" not in plan(out)


def test_safe_names_and_ends(spark):
    names = {"CON": "_CON", "LPT1": "_LPT1", "abcd": "abcd", "abcde": "abcde", "a b c d": "a b c d", " lead": " lead", "trail ": "trail", "a.b.c": "a.b.c", "x" * 10: "x" * 10, "x" * 11: "x" * 10, "a/bcdef": "a_bcdef", "çabcd": "çabcd", "abcde\n": "abcde\n", "": "_", "..": "_"}
    rows = spark.createDataFrame([(k,) for k in names], "v string")
    assert {r.v: r.n for r in rows.select("v", naming.sanitize_component(F.col("v"), 10).alias("n")).collect()} == names
    ends = ["a", " a", "a ", " a ", "\x1ca", "a\n", "", " ", "é", " é", "a b", "\U0001f600", None]
    rows = spark.createDataFrame(list(enumerate(ends)), "i int, v string")
    for r in rows.select("i", text.strip(F.col("v")).alias("s"), text.blank(F.col("v")).alias("b"), text.casefold(F.col("v")).alias("c")).collect():
        v = ends[r.i]
        assert (r.s, r.b, r.c) == ((None, True, None) if v is None else (v.strip(), not v.strip(), v.casefold()))
    dates = ["1995-01-02", "1995-1-2", "1995-01-02\n", "95-01-02", None]
    rows = spark.createDataFrame([(d,) for d in dates], "v string")
    assert [r[0] for r in rows.select(naming.fmt_date(F.col("v"), "xdd.mm/aaaamm")).collect()] == ["x02.01/199501", "x2.1/19951", None, None, None]
