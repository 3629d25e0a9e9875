"""Automation rules as Column expressions. Rules are small and compiled; documents are many and never leave the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Automation, Rule, RuleCondition, normalize_extensions
from ..functions.text import ascii_digits, blank, casefold, let, strip, suffix

#: A number as the text that sorts like it: its sign, the place of its first digit, its digits without zeros at both ends.
_SHAPE = r"^([-+]?)(?:([0-9]*)\.?([0-9]*)(?:[eE]([-+]?[0-9]{1,9}))?|(?i:inf(?:inity)?))\z"


def number(c: Column) -> Column:
    """struct(sign, place, digits) of a number of any length, null for anything else; NaN compares with nothing."""

    def read(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x, _SHAPE, i)
        endless = x.rlike(r"(?i)inf")
        digits = let(F.concat(part(2), part(3)), lambda d: F.struct(F.regexp_replace(d, r"^0+|0+\z", "").alias("kept"), (F.length(d) - F.length(F.regexp_replace(d, r"^0+", ""))).alias("zeros")))

        def made(d: Column) -> Column:
            sign = F.when(~endless & (d["kept"] == ""), 0).when(part(1) == "-", -1).otherwise(1)
            place = F.when(endless, 1 << 40).otherwise(F.length(part(2)) - d["zeros"] + F.coalesce(F.nullif(part(4), F.lit("")).cast("long"), F.lit(0)))
            return F.struct(sign.alias("sign"), (sign * place).cast("long").alias("place"), d["kept"].alias("digits"))

        return F.when(x.rlike(_SHAPE) & (endless | x.rlike("^[-+]?\\.?[0-9]")), let(digits, made))

    return let(F.replace(ascii_digits(strip(c)), F.lit("_"), F.lit("")), read)


#: Numbers that are compared as decimals, by compiled code.
_SHORT, _DECIMAL = r"^-?[0-9]{1,18}(?:\.[0-9]{1,9})?\z", "decimal(27,9)"


def number_of(target: str) -> Column | None:
    """number() of a text that is the same for all rows, read once; None where number() is null."""
    x = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in target.strip()).replace("_", "")
    m, endless = re.match(_SHAPE.replace(r"\z", r"\Z"), x), "inf" in x.lower()
    if not m or not (endless or re.match(r"[-+]?\.?[0-9]", x)):
        return None
    whole, part = m[2] or "", m[3] or ""
    digits = whole + part
    sign = 0 if not endless and not digits.strip("0") else -1 if m[1] == "-" else 1
    place = 1 << 40 if endless else len(whole) - (len(digits) - len(digits.lstrip("0"))) + int(m[4] or 0)
    return F.struct(F.lit(sign).alias("sign"), F.lit(sign * place).cast("long").alias("place"), F.lit(digits.strip("0")).alias("digits"))


def compared_with(value: Column, target: str) -> Column:
    """-1, 0 or 1 for a number in a text against a target; null where either is no number. Short plain ones take no apart."""
    known = number_of(target)
    if known is None:
        return F.lit(None).cast("int")
    slow = let(number(value), lambda n: F.when(n.isNotNull(), compared(n, known)))
    if not re.fullmatch(r"-?[0-9]{1,18}(\.[0-9]{1,9})?", target, re.ASCII):
        return slow
    a, b = value.cast(_DECIMAL), F.lit(target).cast(_DECIMAL)
    return F.when(value.rlike(_SHORT), F.when(a < b, -1).when(a > b, 1).otherwise(0)).otherwise(slow)


def compared(left: Column, right: Column) -> Column:
    """-1, 0 or 1 for two numbers of number()."""
    order = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)
    digits = order(left["digits"], right["digits"]) * left["sign"]
    return F.when(left["sign"] != right["sign"], order(left["sign"], right["sign"])).when(left["sign"] == 0, 0).when(left["place"] != right["place"], order(left["place"], right["place"])).otherwise(digits)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def evaluate_condition(value: Column, operator: str, target: str | None) -> Column:
    """R2: one comparison of a field value; blank values and unknown operators are false."""
    target = (target or "").strip()
    folded = target.casefold()
    if operator == "eq":
        result = casefold(strip(value)) == folded
    elif operator == "contains":
        result = casefold(value).contains(folded)
    elif operator in ("gt", "lt"):
        wanted, text = (1 if operator == "gt" else -1), strip(value)
        as_text = text > target if operator == "gt" else text < target
        result = F.coalesce(compared_with(value, target) == wanted, as_text)
    else:
        return F.lit(False)
    return F.coalesce(~blank(value) & result, F.lit(False))


def field_value(name: str | None, fields: str = "fields") -> Column:
    return F.try_element_at(fields, F.lit(name or ""))


def rule_matches(rule: Rule, fields: str = "fields") -> Column:
    """A rule without conditions never matches."""
    if not rule.conditions:
        return F.lit(False)
    parts = [evaluate_condition(field_value(c.field_name, fields), c.operator, c.value) for c in rule.conditions]
    return _any(parts) if rule.conjunction.strip().casefold() == "or" else _all(parts)


def first_matching_rule(rules: list[Rule], fields: str = "fields") -> Column:
    """Id of the active rule of least priority that matches, or null."""
    ordered = sorted((r for r in rules if r.active), key=lambda r: r.priority)
    return F.coalesce(*[F.when(rule_matches(r, fields), F.lit(r.rule_id)) for r in ordered], F.lit(None).cast("int"))


def ext_matches(raw: str | list | None, ext: Column) -> Column:
    """Whether an extension is among those the user typed, whatever case and with or without a dot."""
    wanted = normalize_extensions(raw)
    actual = casefold(strip(F.coalesce(ext, F.lit(""))))
    actual = F.when((actual == "") | actual.startswith("."), actual).otherwise(F.concat(F.lit("."), actual))
    return actual.isin(*wanted) if wanted else F.lit(False)


def evaluate_filter(c: RuleCondition, fields: str = "fields") -> Column:
    """One entry filter on the columns ext, size, source_folder_id, original_filename, template_id and the field map."""
    target = (c.value or "").strip()
    if c.field == "field":
        return evaluate_condition(field_value(c.field_name, fields), c.operator, c.value)
    if c.field in ("source_folder", "template"):
        own = F.col("source_folder_id" if c.field == "source_folder" else "template_id").cast("string")
        return F.coalesce(own == target, F.lit(False))
    if c.field in ("extension", "filename"):
        own = F.coalesce("ext" if c.field == "extension" else "original_filename", F.lit(""))
        folded = casefold(own) if c.field == "filename" and c.operator == "contains" else casefold(strip(own))
        return folded.contains(target.casefold()) if c.operator == "contains" else folded == target.casefold()
    if c.field == "size":
        wanted = {"gt": 1, "lt": -1, "eq": 0}.get(c.operator)
        return F.coalesce(compared_with(F.col("size").cast("string"), target) == wanted, F.lit(False)) if wanted is not None else F.lit(False)
    return F.lit(False)


def filter_matches(filters: list[RuleCondition], conjunction: str = "and", fields: str = "fields") -> Column:
    """No filters let everything pass."""
    if not filters:
        return F.lit(True)
    parts = [evaluate_filter(f, fields) for f in filters]
    return _any(parts) if conjunction.strip().casefold() == "or" else _all(parts)


def condition_matches(c: RuleCondition, fields: str = "fields") -> Column:
    """As R6, but extensions are compared as typed by users and source folders by their path text."""
    if c.field == "extension" and c.operator != "contains":
        return ext_matches(c.value, F.col("ext"))
    if c.field == "source_folder":
        own, target = F.coalesce("source_folder", F.lit("")), (c.value or "").strip().casefold()
        result = casefold(own).contains(target) if c.operator == "contains" else casefold(strip(own)) == target
        return (own != "") & result
    return evaluate_filter(c, fields)


def automation_matches(a: Automation, fields: str = "fields") -> Column:
    """All conditions; none never match."""
    return _all([condition_matches(c, fields) for c in a.conditions]) if a.conditions else F.lit(False)


def evaluate_automations(docs: DataFrame, automations: list[Automation], fields: str = "fields") -> DataFrame:
    """Adds automation_id, the active automation of least position whose conditions all hold, or null."""
    ordered = sorted((a for a in automations if a.active), key=lambda a: a.position)
    picked = [F.when(automation_matches(a, fields), F.lit(a.automation_id)) for a in ordered]
    return docs.withColumn("automation_id", F.coalesce(*picked, F.lit(None).cast("int")).cast("long"))


def fields_map(filled: DataFrame) -> DataFrame:
    """document_id, fields: name -> normalized of valid, non-blank values; of equal names the last field_no counts."""
    good = filled.where(F.col("valid") & ~blank(F.col("normalized")))
    last = good.groupBy("document_id", "name").agg(F.max_by("normalized", "field_no").alias("value"))
    return last.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("fields"))


def file_attrs(docs: DataFrame, originals: DataFrame, folders: DataFrame, results: DataFrame) -> DataFrame:
    """docs(document_id, origin_id, ...) with ext, size, source_folder_id, source_folder, original_filename, template_id."""
    o = originals.select(F.col("origin_id"), F.col("filename").alias("o_name"), F.col("size").alias("o_size"), F.col("folder_id").alias("source_folder_id"))
    f = folders.select(F.col("folder_id").alias("source_folder_id"), F.col("path").alias("source_folder"))
    r = results.select("document_id", "template_id")
    j = docs.join(o, "origin_id", "left").join(f, "source_folder_id", "left").join(r, "document_id", "left")
    name = F.coalesce("o_name", "filename")
    return j.withColumns({"original_filename": name, "ext": F.lower(suffix(name)), "size": F.coalesce("o_size", F.lit(0))}).drop("o_name", "o_size")

