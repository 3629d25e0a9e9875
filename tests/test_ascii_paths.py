from pyspark.sql import functions as F

from docintake.functions import text, validate


def test_ascii_and_other_texts_agree_with_python(spark):
    space = "".join(map(chr, [*range(0x80), 0x85, 0xA0, 0x2028, 0x3000]))
    rows = [(a + "x y" + b,) for a in space for b in ("", " ", "\x1f\n", "　")] + [("",), (" \t\x1c",), ("é ",)]
    for r in spark.createDataFrame(rows, "v string").select("v", text.strip(F.col("v")).alias("s"), validate.normalize_doc_id(F.col("v")).alias("d")).collect():
        assert (r.s, r.d) == (r.v.strip(), "".join(c for c in r.v if c.isdigit()))


def digits_ok(d, n):
    def check(k):
        rest = sum(int(x) * (2 + i % (8 if n == 14 else 99)) for i, x in enumerate(reversed(d[:k]))) % 11
        return 0 if rest < 2 else 11 - rest

    return len(d) == n and len(set(d)) > 1 and (check(n - 2), check(n - 1)) == (int(d[-2]), int(d[-1]))


def test_check_digits(spark):
    made = [f"{k * 7919 * 104729 % 10 ** m:0{m}d}" for k in range(40) for m in (9, 12)]
    rows = [(b + f"{c:02d}",) for b in made for c in range(100)] + [("0" * 14,), ("9" * 11,), ("9" * 30,), ("",), (None,)]
    valid = spark.createDataFrame(rows, "v string").select("v", validate.is_valid_cnpj(F.col("v")).alias("a"), validate.is_valid_cpf(F.col("v")).alias("b")).collect()
    assert all((bool(r.a), bool(r.b)) == (digits_ok(r.v or "", 14), digits_ok(r.v or "", 11)) for r in valid) and sum(bool(r.a) for r in valid) >= 39
    plan = spark.range(1).select(validate.is_valid_cnpj(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring") < 4
