"""Normalisation and validation of typed fields: dates, money, numbers, tax ids, booleans, free text."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns, slow
from .text import all_digits, ascii_digits, beyond_ascii, blank, let, other_digits, strip

#: Spellings of booleans.
TRUE = ("sim", "true", "1", "verdadeiro", "s", "v")
FALSE = ("não", "nao", "false", "0", "falso", "n", "f")
#: A raw value longer than this fails a field regex.
REGEX_LENGTH = 4096
#: Formats tried in this order after ISO; the day comes first.
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d M yyyy")
#: Numbers that are canonical as they stand.
CANONICAL = r"^-?(?:0|[1-9][0-9]*)(?:\.(?!0{6})[0-9]+)?\z"

RESULT = "struct<valid:boolean,raw:string,normalized:string,reason:string>"


def _plain_date(text: Column) -> Column:
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    compact = F.when(text.rlike(r"^\d{8}\z"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    # each format by its own separator, as a text that fails a format costs far more than one that is not tried
    shapes = [F.when(text.rlike(rf"^\d{{1,2}}[{f[1]}]\d{{1,2}}[{f[1]}]\d{{4}}\z"), F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS]
    return F.date_format(F.coalesce(iso, compact, *shapes), "yyyy-MM-dd")


def date_question(raw: Column) -> Column:
    """The date text that built-in functions do not read and slow.lenient_date() may; null where there is nothing to ask."""
    return let(strip(raw), lambda text: F.when(_plain_date(text).isNull() & text.rlike(r"(?U)\d"), text))


def normalize_date(raw: Column, answer: Column | None = None) -> Column:
    """ISO date text. ISO and compact ISO first, then day-first formats; null for anything else.

    Month names, two-digit years, times of day and week dates go to a helper, which sees only the rows that need it.
    Dates with missing parts are null, since what fills them would change from day to day. `answer` is what the helper
    said to date_question(raw), for callers inside an array, where it cannot be called.
    """
    return F.coalesce(let(strip(raw), _plain_date), slow.lenient_date(date_question(raw)) if answer is None else answer)


def canonical(number: Column) -> Column:
    """Plain decimal text without leading zeros and without a bare point; the scale stays (1.50 is not 1.5)."""
    sign = F.regexp_extract(number, r"^(-?)", 1)
    whole = F.regexp_replace(F.regexp_extract(number, r"^[-+]?(\d*)", 1), r"^0+(?=\d)", "")
    part = F.regexp_extract(number, r"\.(\d+)$", 1)
    whole = F.when(whole == "", F.lit("0")).otherwise(whole)
    return F.concat(sign, whole, F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))


def _is_plain(text: Column) -> Column:
    return text.rlike(r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z") & ~text.rlike(r"^[-+]?0*\.0{6}")


def _number_question(text: Column) -> Column:
    return let(text, lambda x: F.when(~x.rlike(CANONICAL) & ~_is_plain(x) & x.rlike(r"(?iU)\d|inf|nan"), x))


def _decimal_text(text: Column, answer: Column | None) -> Column:
    """Canonical text of a decimal number; exponents, tiny numbers, NaN and infinities go to a helper, null is no number."""
    return F.coalesce(let(text, lambda x: F.when(x.rlike(CANONICAL), x).when(_is_plain(x), canonical(x))), slow.exotic_number(_number_question(text)) if answer is None else answer)


def _amount(raw: Column) -> Column:
    kept = F.when(beyond_ascii(raw), ascii_digits(F.regexp_replace(raw, rf"[^\p{{Nd}}{other_digits()},\-]", ""))).otherwise(F.regexp_replace(raw, r"[^0-9,\-]", ""))
    return F.translate(kept, ",", ".")


def money_question(raw: Column) -> Column:
    """What slow.exotic_number() must be asked about an amount; null where there is nothing to ask."""
    return _number_question(_amount(raw))


def number_question(raw: Column) -> Column:
    """What slow.exotic_number() must be asked about a number; null where there is nothing to ask."""
    return _number_question(ascii_digits(strip(raw)))


def normalize_money_brl(raw: Column, answer: Column | None = None) -> Column:
    """1.234,56 and R$ 2.000,00 to 1234.56 and 2000.00; null for what is no amount. Digits of any script count."""
    return _decimal_text(_amount(raw), answer)


def normalize_number(raw: Column, answer: Column | None = None) -> Column:
    """decimal text of plain numbers, exponents, grouped digits and digits of any script."""
    return _decimal_text(ascii_digits(strip(raw)), answer)


def normalize_doc_id(raw: Column) -> Column:
    """F8: digits only, of any script, as they stand."""
    return F.when(beyond_ascii(raw), F.regexp_replace(raw, rf"[^0-9{all_digits()}]", "")).otherwise(F.regexp_replace(raw, "[^0-9]", ""))


def _check_digit(number: Column, length: int, weights: list[int]) -> Column:
    """The check digit of the first digits of a number of `length` digits, one for each weight."""
    total = sum((F.floor(number / 10 ** (length - 1 - i)) % 10 * w for i, w in enumerate(weights)), F.lit(0))
    return (11 - total % 11) % 11 % 10  # remainders 0 and 1 both give 0


def _checked(raw: Column, length: int, first: list[int], second: list[int]) -> Column:
    def right(digits: Column) -> Column:
        # up to 14 digits: their number, divided by powers of ten, is exact as a double
        sums = let(digits.try_cast("long"), lambda n: (_check_digit(n, length, first) * 10 + _check_digit(n, length, second)) == n % 100)
        return F.coalesce(F.when(digits.rlike(rf"^[0-9]{{{length}}}\z"), sums), F.lit(False))

    # a number in digits of one kind only is none, whatever they stand for; superscripts and the like stand for nothing
    return let(normalize_doc_id(raw), lambda typed: ~typed.rlike(r"^(.)\1*\z") & right(ascii_digits(typed)))


def is_valid_cnpj(raw: Column) -> Column:
    """14 digits, not all equal, two check digits."""
    weights = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return _checked(raw, 14, weights, [6, *weights])


def is_valid_cpf(raw: Column) -> Column:
    """11 digits, not all equal, two check digits."""
    return _checked(raw, 11, list(range(10, 1, -1)), list(range(11, 1, -1)))


def normalize_bool(raw: Column) -> Column:
    """'true', 'false' or null."""
    return let(F.lower(strip(raw)), lambda word: F.when(word.isin(*TRUE), "true").when(word.isin(*FALSE), "false"))


def regex_ok(raw: Column, pattern: str) -> Column:
    """the whole raw value matches; values beyond REGEX_LENGTH do not, nor does any if the pattern is invalid.

    Patterns that Java cannot read or may take long over go to a helper with a deadline.
    """
    short = F.length(raw) <= REGEX_LENGTH
    if not patterns.is_valid(pattern):
        return F.lit(False)
    if not needs_helper(pattern):
        return short & raw.rlike(rf"(?Ud)^(?:{pattern})\z")
    return short & slow.matches_with_deadline(F.when(short, raw), pattern)


def needs_helper(pattern: str) -> bool:
    return patterns.is_valid(pattern) and not (patterns.is_safe(pattern) and patterns.java_reads(f"(?Ud){pattern}"))


def validate_field(
    field_type: Column | str, raw: Column, required: Column | bool, regexes: list[tuple[Column, str]] = (), answers: Column | None = None
) -> Column:
    """struct(valid, raw, normalized, reason).

    regexes: (which rows, pattern) pairs; a row is held against the first pattern whose condition holds. `answers`,
    struct(date, number and one for each pattern that needs them), are those of the helpers, for callers inside an array; see asked().
    """
    date, number = (None, None) if answers is None else (answers["date"], answers["number"])
    kind = F.lit(field_type) if isinstance(field_type, str) else field_type
    needed = F.lit(required) if isinstance(required, bool) else required
    tax_id = let(normalize_doc_id(raw), lambda x: F.when(F.when(F.length(x) == 14, is_valid_cnpj(x)).otherwise(is_valid_cpf(x)), x))
    normalized = (
        F.when(kind == "data", normalize_date(raw, date))
        .when(kind == "moeda", normalize_money_brl(raw, number))
        .when(kind == "numero", normalize_number(raw, number))
        .when(kind == "cpf_cnpj", tax_id)
        .when(kind == "booleano", normalize_bool(raw))
        .otherwise(raw)
    )
    pattern_ok = F.lit(True)
    for which, pattern in reversed(list(regexes)):
        ok = regex_ok(raw, pattern) if answers is None or not needs_helper(pattern) else answers[_name(pattern)]
        pattern_ok = F.when(which, ok).otherwise(pattern_ok)

    def judged(x: Column) -> Column:
        valid = F.when(x["empty"], ~needed).otherwise(x["normalized"].isNotNull() & x["pattern_ok"])
        reason = F.when(x["empty"], F.when(needed, "required")).when(x["normalized"].isNull(), F.concat(F.lit("not a "), kind)).when(~x["pattern_ok"], "pattern")
        return F.struct(valid.alias("valid"), raw.alias("raw"), F.when(~x["empty"], x["normalized"]).alias("normalized"), reason.alias("reason"))

    return let(F.struct(blank(raw).alias("empty"), normalized.alias("normalized"), pattern_ok.alias("pattern_ok")), judged)


def _name(pattern: str) -> str:
    return f"p{zlib.crc32(pattern.encode())}"


def asked(rows: Column, regexes: list[str]) -> Column:
    """array<struct(date, number, p...)>: what the helpers say about rows, array<struct(field_type, raw, regex, ...)>, item by item.

    The helpers get null for a document that has nothing to ask.
    """

    def put(question: Callable[[Column], Column]) -> Column:
        return let(F.transform(rows, question), lambda q: F.when(F.exists(q, lambda x: x.isNotNull()), q))

    date = put(lambda r: F.when(r["field_type"] == "data", date_question(r["raw"])))
    number = put(lambda r: F.when(r["field_type"] == "moeda", money_question(r["raw"])).when(r["field_type"] == "numero", number_question(r["raw"])))
    found = {"date": slow.lenient_dates(date), "number": slow.exotic_numbers(number)}
    for pattern in filter(needs_helper, regexes):
        short = put(lambda r: F.when((r["regex"] == pattern) & (F.length(r["raw"]) <= REGEX_LENGTH), r["raw"]))  # noqa: B023 - called at once
        found[_name(pattern)] = slow.all_match_with_deadline(short, pattern)
    kinds = {n: "string" if n in ("date", "number") else "boolean" for n in found}
    return F.arrays_zip(*[F.coalesce(a, F.array_repeat(F.lit(None).cast(kinds[n]), F.size(rows))).alias(n) for n, a in found.items()])


def confidence_band(score: Column) -> Column:
    """F15"""
    return F.when(score.isNull(), "—").when(score >= 0.8, "Alta").when(score >= 0.5, "Média").otherwise("Baixa")


def confidence_percent(score: Column) -> Column:
    """whole per cent, halves up."""
    return F.floor(score * 100 + 0.5).cast("long")
