"""Rules and automations as tables: thousands of them, in a plan that does not grow with their number.

What rules.py compiles into one expression for each rule, is here a join. Every rule is entered in an index under one of its
conditions, the one that the fewest documents can meet: an equality by its value, else a `contains` by the rarest run of
GRAM characters of what it looks for, else the mere presence of the value it compares. A document looks up its own
values, and the rules found are held against it in full; of those that hold, the least position wins. A rule whose
conditions are joined by `or` is entered once for each of them.

The index is as large as the rules; whether it is broadcast is left to Spark. Candidates are reduced to one a document
before they are shuffled. Documents have different ids, as everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Automation, Rule
from ..functions.text import blank, casefold, let, strip
from ..sources.files import staged
from .rules import compared, number

GRAM = 3
#: Different values that conditions look at, up to which only these are looked up.
MOST_SHAPES = 500
EQUAL, PART, THERE = "equal", "part", "there"
CONDITIONS = "rule_id long, field string, operator string, value string, field_name string"
RULES = "rule_id long, position long, conjunction string"


def rule_tables(spark: SparkSession, rules: Iterable[Rule | Automation]) -> tuple[DataFrame, DataFrame]:
    """(rules, conditions) of active rules or automations, in their order of evaluation."""
    place = lambda r: r.priority if isinstance(r, Rule) else r.position
    name = lambda r: r.rule_id if isinstance(r, Rule) else r.automation_id
    active = sorted((r for r in rules if r.active), key=place)
    heads = [(name(r), k, r.conjunction if isinstance(r, Rule) else "and") for k, r in enumerate(active)]
    rows = [(name(r), c.field, c.operator, c.value, c.field_name) for r in active for c in r.conditions]
    return spark.createDataFrame(heads, RULES), spark.createDataFrame(rows, CONDITIONS)


def _read(conditions: DataFrame) -> DataFrame:
    """rule_id, c: what a condition compares (attr), how (mode), and with what (values, text, number)."""
    field, operator, target = F.col("field"), F.col("operator"), strip(F.coalesce("value", F.lit("")))
    part = operator == "contains"
    listed = (field == "extension") & ~part
    attr = F.when(field == "field", F.concat(F.lit("field:"), F.coalesce("field_name", F.lit("")))).when(listed, "dotted").when(field.isin("extension", "source_folder", "filename", "size", "template"), field)
    mode = (
        F.when(field == "field", F.when(operator.isin("eq", "contains", "gt", "lt"), operator))
        .when(field == "size", F.when(operator.isin("eq", "gt", "lt"), F.concat(F.lit("number_"), operator)))
        .when(field == "template", "eq")
        .when(part, "contains")
        .otherwise("eq")
    )
    typed = F.regexp_extract_all(casefold(target), F.lit(r"(?U)[^,;\s\x1c-\x1f]+"), F.lit(0))
    extensions = F.transform(typed, lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x)))
    values = F.when(listed, F.array_distinct(extensions)).otherwise(F.array(casefold(target)))
    c = F.struct(attr.alias("attr"), F.when(attr.isNotNull(), mode).alias("mode"), values.alias("values"), target.alias("text"), number(target).alias("number"))
    return conditions.select("rule_id", c.alias("c")).distinct()


def _attributes(fields: str) -> Column:
    """map attr -> struct(text, folded) of a document: its values that are not blank, and what is known of its file."""
    own = F.filter(F.map_entries(fields), lambda e: ~blank(e["value"]))
    one = lambda key, value, there: F.when(there, F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    ext, folder, always = F.coalesce("ext", F.lit("")), F.coalesce("source_folder", F.lit("")), F.lit(True)
    dotted = let(strip(ext), lambda e: F.when((e == "") | e.startswith("."), e).otherwise(F.concat(F.lit("."), e)))
    entries = F.concat(
        F.coalesce(F.transform(own, lambda e: F.struct(F.concat(F.lit("field:"), e["key"]).alias("key"), e["value"].alias("value"))), F.array().cast("array<struct<key:string,value:string>>")),
        one("source_folder", folder, folder != ""),
        one("extension", ext, always),
        one("dotted", dotted, always),
        one("filename", F.coalesce("original_filename", F.lit("")), always),
        one("size", F.col("size").cast("string"), F.col("size").isNotNull()),
        one("template", F.col("template_id").cast("string"), F.col("template_id").isNotNull()),
    )
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], let(strip(e["value"]), lambda v: F.struct(v.alias("text"), casefold(v).alias("folded"))))))


def _holds(c: Column, attributes: Column) -> Column:
    def judged(a: Column) -> Column:
        both = F.struct(number(a["text"]).alias("a"), c["number"].alias("b"))
        order = let(both, lambda n: F.when(n["a"].isNotNull() & n["b"].isNotNull(), compared(n["a"], n["b"])))
        mixed = lambda sign, text: let(order, lambda o: F.when(o.isNotNull(), o == sign).otherwise(text))
        return (
            F.when(c["mode"] == "eq", F.array_contains(c["values"], a["folded"]))
            .when(c["mode"] == "contains", F.contains(a["folded"], c["values"][0]))
            .when(c["mode"] == "gt", mixed(1, a["text"] > c["text"]))
            .when(c["mode"] == "lt", mixed(-1, a["text"] < c["text"]))
            .when(c["mode"] == "number_gt", order == 1)
            .when(c["mode"] == "number_lt", order == -1)
            .when(c["mode"] == "number_eq", order == 0)
        )

    return F.coalesce(let(F.try_element_at(attributes, c["attr"]), judged), F.lit(False))


def _grams(value: Column, lengths: Iterable[int] = range(1, GRAM + 1)) -> Column:
    """All different runs of so many characters of a value."""
    length = F.length(value)
    runs = lambda k: F.when(length >= k, F.transform(F.sequence(F.lit(1), F.greatest(length - (k - 1), F.lit(1))), lambda i: F.substr(value, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[runs(k) for k in lengths]))


def _shapes(entries: DataFrame) -> set[tuple[str, str | None, int]]:
    """The (kind, attr, length of the probe) that occur: 0 for all but runs, no attr where there are more than MOST_SHAPES."""
    length = F.when(F.col("kind") == PART, F.length("probe")).otherwise(0)
    found = {tuple(r) for r in entries.select("kind", "attr", length).distinct().limit(MOST_SHAPES + 1).collect()}
    if len(found) <= MOST_SHAPES:
        return found
    return {(r[0], None, r[1]) for r in entries.select("kind", length).distinct().collect()}


def _looked_up(shapes: set[tuple[str, str | None, int]]) -> Column:
    """What a document looks for in the index: array<struct(kind, attr, probe)>, of the shapes that the index has."""
    probe = lambda kind, attr, value: F.struct(F.lit(kind).alias("kind"), attr.alias("attr"), value.alias("probe"))
    parts = []
    for kind, length in sorted({(kind, length) for kind, _, length in shapes}):
        attrs = [a for k, a, n in shapes if (k, n) == (kind, length)]
        own = F.map_entries("attributes") if None in attrs else F.filter(F.map_entries("attributes"), lambda e: e["key"].isin(attrs))  # noqa: B023 - called at once
        if kind == PART:
            parts.append(F.flatten(F.transform(own, lambda e: F.transform(_grams(e["value"]["folded"], [length]), lambda g: probe(PART, e["key"], g)))))  # noqa: B023
        else:
            parts.append(F.transform(own, lambda e: probe(kind, e["key"], e["value"]["folded"] if kind == EQUAL else F.lit(""))))  # noqa: B023
    return F.concat(*parts)


def _entries(conditions: DataFrame) -> DataFrame:
    """(rule_id, way, c, kind, probe): all the places where a rule can be entered for a condition."""
    c = F.col("c")
    runs = F.filter(_grams(c["values"][0]), lambda g: F.length(g) == F.least(F.lit(GRAM), F.length(c["values"][0])))
    made = F.when(c["mode"] == "eq", F.transform("c.values", lambda v: F.struct(F.lit(EQUAL).alias("kind"), v.alias("probe"))))
    made = made.when((c["mode"] == "contains") & (c["values"][0] != ""), F.transform(runs, lambda g: F.struct(F.lit(PART).alias("kind"), g.alias("probe"))))
    made = made.otherwise(F.array(F.struct(F.lit(THERE).alias("kind"), F.lit("").alias("probe"))))
    return conditions.select("rule_id", "way", "c", F.explode(made).alias("e")).select("rule_id", "way", "c", "e.kind", F.col("c.attr").alias("attr"), "e.probe")


def winnable(ways: DataFrame) -> DataFrame:
    """The ways (rule_id, way, all, position) that can come first.

    A way never wins where another with the same conditions, or with some of them only, comes before it: whatever meets
    the one meets the other. Each is held against those with its own conditions, with all but one and with a single one.
    So rules that say the same of one value, however many, leave one candidate to each document that has it.
    """
    place = F.struct("position", "rule_id", "way")
    keyed = ways.withColumn("said", F.array_sort(F.transform("all", lambda c: F.to_json(c))))
    first = keyed.groupBy(F.to_json("said").alias("key")).agg(F.min(place).alias("first"))
    fewer = F.concat(F.array("said"), F.transform("said", lambda x: F.array(x)), F.transform("said", lambda x: F.filter("said", lambda y: y != x)))
    held = keyed.select("rule_id", "way", place.alias("own"), F.explode(F.array_distinct(F.transform(fewer, lambda x: F.to_json(x)))).alias("key")).join(first, "key")
    kept = held.groupBy("rule_id", "way").agg((F.min("first") == F.first("own")).alias("kept")).where("kept")
    return ways.join(kept.drop("kept"), ["rule_id", "way"], "left_semi")


def first_matching(docs: DataFrame, rules: DataFrame, conditions: DataFrame, fields: str = "fields", key: str = "document_id", name: str = "rule_id") -> DataFrame:
    """docs with `name`: the id of the rule of least position (then least id) whose conditions hold, or null.

    docs has the columns of evaluate_automations(); rules(rule_id, position, conjunction), conditions(rule_id, field,
    operator, value, field_name). A rule without conditions never matches.
    """
    either = rules.select("rule_id", (F.lower(F.trim(F.coalesce("conjunction", F.lit("and")))) == "or").alias("either"))
    read = _read(conditions).join(either, "rule_id").withColumn("way", F.when(F.col("either"), F.xxhash64(F.to_json("c"))).otherwise(0)).drop("either")
    # one condition that cannot hold is enough for all of its way
    ways = read.groupBy("rule_id", "way").agg(F.collect_list("c").alias("all"), F.bool_and(F.coalesce(F.col("c.mode").isNotNull() & (F.size("c.values") > 0), F.lit(False))).alias("can"))
    ways = staged(winnable(ways.where("can").drop("can").join(rules.select("rule_id", "position"), "rule_id")))
    read = read.join(ways.select("rule_id", "way"), ["rule_id", "way"], "left_semi")
    entries = staged(_entries(read))
    if not (shapes := _shapes(entries)):
        return docs.withColumn(name, F.lit(None).cast("long"))

    # read three times below, and its strings are dear to make
    known = staged(docs.select(key, _attributes(fields).alias("attributes")))
    places = ["kind", "attr", "probe"]
    met = known.select(F.explode(_looked_up(shapes)).alias("p")).select("p.*").join(entries.select(*places).distinct(), places, "left_semi").groupBy(*places).agg(F.count("*").alias("docs"))
    priced = entries.join(met, places, "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    # an equality is entered under each of its values, a `contains` under its rarest run only
    rarest = priced.where(F.col("kind") == PART).groupBy("rule_id", "way", "c").agg(F.min_by("probe", F.struct("docs", "probe")).alias("probe"), F.min("docs").alias("cost")).withColumn("probes", F.array("probe")).drop("probe").withColumn("kind", F.lit(PART))
    others = priced.where(F.col("kind") != PART).groupBy("rule_id", "way", "c", "kind").agg(F.collect_set("probe").alias("probes"), F.sum("docs").alias("cost"))
    chosen = rarest.unionByName(others).groupBy("rule_id", "way").agg(F.min_by(F.struct("kind", F.col("c.attr").alias("attr"), "probes"), F.struct("cost", "kind", F.to_json("c"))).alias("e"))
    index = chosen.select("rule_id", "way", "e.kind", "e.attr", F.explode("e.probes").alias("probe"))
    index = staged(index)

    # what is looked up carries no values: they meet the few rules found once, by document
    asked = known.select(key, F.explode(_looked_up(_shapes(index))).alias("p")).select(key, "p.*")
    pairs = asked.join(index, places).select(key, "rule_id", "way")
    holding = pairs.join(ways, ["rule_id", "way"]).join(known, key).where(F.forall("all", lambda c: _holds(c, F.col("attributes"))))
    best = holding.groupBy(key).agg(F.min(F.struct("position", "rule_id")).alias("best"))
    return docs.join(best.select(key, F.col("best.rule_id").alias(name)), key, "left")


def evaluate_automations(docs: DataFrame, automations: DataFrame, conditions: DataFrame, fields: str = "fields") -> DataFrame:
    """R9 over tables: automations(automation_id, position, active), conditions(automation_id, field, operator, value, field_name)."""
    heads = automations.where("active").select(F.col("automation_id").alias("rule_id"), "position", F.lit("and").alias("conjunction"))
    return first_matching(docs, heads, conditions.withColumnRenamed("automation_id", "rule_id"), fields, name="automation_id")
