"""Text and number functions against Python's own Unicode tables and decimals."""

import random
import re
import time
import unicodedata
from decimal import Decimal, InvalidOperation

import pytest
from pyspark.sql import functions as F

from docintake.config import Condition
from docintake.functions import patterns, text, validate
from docintake.operators import rules, signals


def column(spark, values, fn):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[1] for r in sorted(rows.select("i", fn(F.col("v")).alias("r")).collect())]


def bare(value):
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


def test_every_decomposition(spark):
    """All characters that decompose, and random texts that mix them with plain ones."""
    r = random.Random(1)
    some = [chr(c) for c in range(0x80, 0x110000) if unicodedata.decomposition(chr(c)) or unicodedata.combining(chr(c))] + [chr(c) for c in range(0xAC00, 0xD7A4, 7)]
    r.shuffle(some)
    values = ["|".join(some[i : i + 200]) for i in range(0, len(some), 200)]
    values += ["".join(r.choice(some) if r.random() < 0.3 else chr(r.randrange(32, 0x2FF)) for _ in range(60)) for _ in range(300)]
    for value, got in zip(values, column(spark, values, text.strip_accents), strict=True):
        assert got == bare(value)


def test_needles_in_other_forms(spark):
    docs = [(1, "Relatório: 대한민국 2024"), (2, "ﬁnance oﬃce"), (3, "ＮＯＴＡ　ＦＩＳＣＡＬ"), (4, "nota fiscal de 대한"), (5, None)]
    hay = signals.haystacks(spark.createDataFrame(docs, "document_id long, full_text string"))
    for needle, hits in (("대한민국", {1}), ("대한", {1, 4}), ("finance", {2}), ("OFFICE", {2}), ("nota fiscal", {3, 4}), ("２０２４", {1})):
        found = hay.select("document_id", signals.condition(Condition("texto", needle)).alias("hit")).collect()
        assert {r.document_id for r in found if r.hit} == hits, needle


NUMBERS = ["1e3", "1_000", "NaN", "Infinity", "-inf", "٣", "٣٫٥", "-٣.٥", "0.0000001", "0.000001", "-0", "+1.50", ".5", "5.", "", "x1", "1e", "--1", "0e5", "000.000", "12" * 20, "sNaN", "²", "1 2", " 7 "]


def test_numbers(spark):
    def decimal(value):
        try:
            return str(Decimal(value.strip()))
        except InvalidOperation:
            return None

    assert column(spark, NUMBERS, validate.normalize_number) == [decimal(v) for v in NUMBERS]
    money = ["٣,5", "R$ ١.٢٣٤,٥٦", "²", "1.234,56", "R$", "-,5", "5-", "1,2,3", "0,0000001"]

    def amount(value):
        kept = "".join(c for c in value if c.isdigit() or c in ",.-").replace(".", "").replace(",", ".")
        return decimal(kept) if kept else None

    assert column(spark, money, validate.normalize_money_brl) == [amount(v) for v in money]


def test_dates(spark):
    values = ["Apr 3 2026", "03/04/26", "3 April 2026 10:30", "2026-W14-5", "03/04/2026", "2026-04-03", "20260403", "April 2026", "10:30", "31/02/2026", "13/13/2026", "3.4.2026", "x 12"]
    wanted = ["2026-04-03"] * 7 + [None] * 4 + ["2026-04-03", None]
    assert column(spark, values, validate.normalize_date) == wanted
    fields = column(spark, values, lambda c: validate.validate_field("data", c, True)["normalized"])
    assert fields == wanted


def test_comparing_numbers_of_any_length(spark):
    values = ["0.00000000001", "9" * 33, "-" + "9" * 33, "1e400", "-1e-400", "0", "-0.0", "00012.50", "12.5", "1_2.5", "٣", "inf", "-Infinity", "abc", "1999-01-01", "5e", "", "  7 "]
    targets = ["0", "9", "12.50", "-1e3", "inf", "abc", "1e400", "2"]

    def decimal(value):
        try:
            return Decimal(value.strip())
        except InvalidOperation:
            return None

    for target in targets:
        for operator in ("gt", "lt"):
            wanted = []
            for v in values:
                left, right = decimal(v), decimal(target)
                if left is None or right is None:
                    left, right = v.strip(), target.strip()
                wanted.append(bool(v.strip()) and (left > right if operator == "gt" else left < right))
            assert column(spark, values, lambda c: rules.evaluate_condition(c, operator, target)) == wanted, (operator, target)  # noqa: B023


SAFE = [r"\d{44}", r"[a-z0-9.]+@[a-z]+\.[a-z]+", r"\bund\b.*\bder\b", r"\+\d{1,3} \(", "token = ", r"a|b+c", r"(?:ab)+", r"\d+,\d+", "[^]]x", ".*="]
UNSAFE = [".*.*.*=", "(.*)(.*)(.*)x", r"\s*\s*\s*;", r"\d+\d+\d+x", "(a+)+$", r"(x)\1", "(?=a)b", "(a|b+)*c", r"x.*a.*b", r"\w+-?\w+;", "(?:a*)*"]


def test_patterns():
    assert [p for p in SAFE if not patterns.is_safe(p)] == [] and [p for p in UNSAFE if patterns.is_safe(p)] == []


def test_field_patterns(spark):
    raw = ["123", "12a", "x" * 5000, None, "٣"]
    ok = lambda p: column(spark, raw, lambda c: F.coalesce(validate.regex_ok(c, p), F.lit(False)))
    assert ok("([") == [False] * 5  # invalid: the value fails, not the job
    assert ok(r"\d+") == [True, False, False, False, True] == ok(r"(?=\d)\d*\d*")
    assert ok("(x+x+)+y") == [False] * 5  # ends by its deadline
    assert ok(r"[0-9]+|[0-9]+a") == [bool(re.fullmatch("[0-9]+|[0-9]+a", v)) if v and len(v) < 4097 else False for v in raw]


def test_nested_fields_ask_the_helpers(spark):
    from docintake.config import TemplateField
    from docintake.operators import fields

    own = {1: [TemplateField("d", "data", True), TemplateField("n", "numero"), TemplateField("m", "moeda"), TemplateField("t", "texto", False, r"(?=\d)\d+")], 2: []}
    rows = [(1, 1, {"d": "Apr 3 2026", "n": "1e3", "m": "٣,5", "t": "12"}), (2, 1, {"d": "03/04/2026", "t": "x"}), (3, 2, {"d": "1"}), (4, 1, {})]
    docs = spark.createDataFrame(rows, "document_id long, template_id long, pairs map<string,string>")
    got = {r.document_id: [(f.name, f.valid, f.normalized) for f in r.filled] for r in fields.fill_nested(docs, own).collect()}
    assert got == {
        1: [("d", True, "2026-04-03"), ("n", True, "1E+3"), ("m", True, "3.5"), ("t", True, "12")],
        2: [("d", True, "2026-04-03"), ("t", False, "x")], 3: [], 4: [("d", False, None)],
    }


@pytest.mark.parametrize("pattern", [".*.*.*=", r"\s*\s*\s*;"])
def test_slow_patterns_have_a_deadline(spark, pattern):
    import time

    docs = signals.haystacks(spark.createDataFrame([(1, "a " * 100_000)], "document_id long, full_text string"))
    began = time.time()
    assert not docs.select(signals.condition(Condition("regex", pattern))).first()[0]
    assert time.time() - began < 20


def test_case_folding(spark):
    """All characters that folding changes, and random texts; a value equals and contains itself in a rule."""
    r = random.Random(11)
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).casefold() != chr(c) or chr(c).lower() != chr(c))]
    values = ["|".join(some[i : i + 100]) for i in range(0, len(some), 100)] + ["µg", "ﬁnance", "ǰ", "ΑΣ", "ΣΑΣ ς", "İstanbul", "STRASSE straße ẞ"]
    values += ["".join(r.choice(some) if r.random() < 0.4 else chr(r.randrange(33, 0x2FF)) for _ in range(30)) for _ in range(300)]
    assert column(spark, values, text.casefold) == [v.casefold() for v in values]
    own = ["µg", "ﬁnance", "ǰ", "ẞ", "Σ"]
    for v in own:
        for op, other in (("eq", v.upper()), ("contains", v), ("eq", v)):
            want = v.casefold() == other.strip().casefold() if op == "eq" else True
            assert column(spark, [f" {v} "], lambda c: rules.evaluate_condition(c, op, other)) == [want]  # noqa: B023


def test_digits_of_other_scripts_in_tax_ids(spark):
    values = ["٥٢٩.982.247-25", "529.982.247-25", "529.982.247-24", "١١١١١١١١١١١", "1١1١1١1١1١1", "52998224725²", "²" * 11, "११.२२२.३३३/०००१-८१", "11222333000181"]
    assert column(spark, values, validate.normalize_doc_id) == ["".join(c for c in v if c.isdigit()) for v in values]
    assert column(spark, values, validate.is_valid_cpf)[:3] == [True, True, False]
    assert column(spark, values, validate.is_valid_cpf)[3:7] == [False, True, False, False]  # digits that stand for one value but differ are no one digit
    assert column(spark, values, validate.is_valid_cnpj)[7:] == [True, True]


SLOW = [r"[0-9]{1,200}[0-9]{1,200}[0-9]{1,200}k", r"[0-9]{1,200}[0-9]{1,200}k", r"\d{1,50}\d{1,50}\d{1,50}\d{1,50}k", r"[a-z]{2,}[a-z]{2,500}[a-z]{2,500}x", r"(?:a?b?c?){20}d", r"(a*)*b", r"(x+x+)+y", r"a?a?a?a?aaaab", r"(?:\d+,?)+x", r"(\d|\d\d)+x", r"(?:ab|aba|b)+x", r".*nota.*fiscal"]
QUICK = ["(?i)nota", r"\d{44}", r"nota\s+fiscal", r"\b\d+x", r"\d+x", r"[^a]*a", r"[\w.]+@[\w.]+\.\w+", r"R\$\s*\d+,\d{2}", r"colou?r", r"NF-?e?\b", r"(a|ab)(c|bcd)(d*)", r"cnpj:?\s*\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}"]


def test_ambiguous_patterns_get_a_deadline(spark):
    """Safe patterns stay with the built-in matcher, all others end by their deadline, whatever the text."""
    assert [p for p in SLOW if patterns.is_safe(p)] == [] and [p for p in QUICK if not patterns.is_safe(p)] == []
    assert patterns.is_safe(r"(?:\d+,)+x") and not patterns.is_linear(r"(?:\d+,)+x") and not patterns.is_linear("nota.*fiscal")
    assert [p for p in QUICK if not patterns.is_linear(p)] == []
    texts = ["7" * 200_000, "a" * 200_000, "ab" * 100_000, "x" * 700, "7," * 100_000]
    hay = signals.haystacks(spark.createDataFrame(list(enumerate(texts)), "document_id int, full_text string")).cache()
    hay.count()
    for p in [*SLOW, *QUICK, r"(?:\d+,)+x", "7.*8", "(?:ab)+c"]:
        began = time.time()
        hay.where(signals.condition(Condition("regex", p))).count()
        assert time.time() - began < 20, p  # five texts; without a deadline the first alone takes minutes


def test_search_from_the_start_of_a_run(spark):
    """The lookbehind before a leading run changes no answer."""
    r = random.Random(5)
    made = [r.choice([r"\d+", r"[a-c]*", r"[^x]{2,}", r"\w+", r"b+?", r"a{1,3}", "(?:ab)+"]) + r.choice(["x", r"\d", r"\b", "ab", "", r"\s?y"]) for _ in range(60)]
    texts = ["".join(r.choice("abcx1 y") for _ in range(r.randrange(12))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", *[F.col("t").rlike(patterns.from_run_start(p)).alias(f"p{i}") for i, p in enumerate(made)]).collect()
    for row in got:
        assert [row[i + 1] for i in range(len(made))] == [bool(re.search(p, row.t)) for p in made]
