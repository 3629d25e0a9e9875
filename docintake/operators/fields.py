"""Field fill, validation and quality score. Fields stay an array per document until they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TemplateField
from ..functions.text import let, norm_key
from ..functions.validate import asked as answers_of
from ..functions.validate import validate_field


#: Columns of a template's field, as template_fields_table() gives them.
FIELD = ("field_no", "name", "field_type", "required", "regex")


def pairs_map(pairs: Column) -> Column:
    """normalised key -> value; of equal keys the last counts: it stands last among them once they are sorted by place."""
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(norm_key(p["key"]).alias("key"), i.alias("place"), p["value"].alias("value"))))

    def last_of_each(entries: Column) -> Column:
        last = F.filter(entries, lambda p, i: ~F.coalesce(F.get(entries, i + 1)["key"] == p["key"], F.lit(False)))
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))

    return let(placed, last_of_each)


def template_fields_table(spark, fields: dict[int, list[TemplateField]]) -> DataFrame:
    """Fields of templates as a table: template_id, field_no, name, field_type, required, regex."""
    rows = [(t, i, f.name, f.field_type, f.required, f.regex) for t, fs in fields.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "template_id long, field_no int, name string, field_type string, required boolean, regex string")


def map_fields(docs: DataFrame, template_fields: DataFrame) -> DataFrame:
    """docs(document_id, template_id, pairs map) -> one row per template field: raw (null if absent), missing_required.

    The fields of all templates are broadcast, as user configuration is small.
    """
    # one row for each template, with the keys of its fields ready: documents stay where they are, however few templates there are
    listed = template_fields.groupBy("template_id").agg(F.collect_list(F.struct(*FIELD, norm_key(F.col("name")).alias("key"))).alias("__fields"))
    # the fields are exploded, not what is found: the pairs of a document are worked out once, below
    rows = docs.join(F.broadcast(listed), "template_id").select("document_id", "template_id", "pairs", F.explode("__fields").alias("f"))
    rows = rows.select("document_id", "template_id", *[f"f.{c}" for c in FIELD], F.try_element_at("pairs", F.col("f.key")).alias("raw"))
    return rows.withColumn("missing_required", F.col("required") & F.col("raw").isNull())


def merge_missing(filled: DataFrame, extra: DataFrame) -> DataFrame:
    """extra(document_id, key, value, pos) fills only missing required fields; the last of equal keys counts."""
    last = extra.withColumn("k", norm_key(F.col("key"))).groupBy("document_id", "k").agg(F.max_by("value", "pos").alias("extra_value"))
    j = filled.withColumn("k", norm_key(F.col("name"))).join(last, ["document_id", "k"], "left")
    raw = F.when(F.col("missing_required"), F.col("extra_value")).otherwise(F.col("raw"))
    return j.withColumn("raw", raw).withColumn("missing_required", F.col("required") & F.col("raw").isNull()).drop("k", "extra_value")


def _patterns(patterns: list[str]) -> list[tuple[Column, str]]:
    return [(F.col("regex") == p, p) for p in dict.fromkeys(patterns)]


def validated(filled: DataFrame, patterns: list[str]) -> DataFrame:
    """adds valid, normalized, reason; optional fields that are absent are left out, as nothing was filled."""
    present = filled.where(F.col("raw").isNotNull() | F.col("required"))
    out = present.withColumn("__v", validate_field(F.col("field_type"), F.col("raw"), F.col("required"), _patterns(patterns)))
    return out.select("document_id", "template_id", "field_no", "name", "field_type", "required", "regex", "raw", "__v.valid", "__v.normalized", "__v.reason")


def compute_confidence(fields: DataFrame) -> DataFrame:
    """document_id, score, invalid_required; fields(document_id, required, valid) has a row for each required field."""
    needed, good = F.count_if("required"), F.count_if(F.col("required") & F.col("valid"))
    return fields.groupBy("document_id").agg(
        F.when(needed == 0, F.lit(1.0)).otherwise(good / F.greatest(needed, F.lit(1))).alias("score"), (good < needed).alias("invalid_required")
    )


def fill_nested(docs: DataFrame, fields: dict[int, list[TemplateField]]) -> DataFrame:
    """F2-F13 without a shuffle: docs(template_id, pairs map) with `filled` (array of structs), `score`, `invalid_required`.

    Templates are compiled into one `case` over template_id that lists the fields and raw values; one validation serves
    them all, so the plan does not grow with it and documents with long texts are never exploded.
    """
    asked = F.array().cast("array<struct<name:string,field_type:string,required:boolean,regex:string,raw:string>>")
    for template_id, own in fields.items():
        rows = []
        for f in own:
            known = {"name": f.name, "field_type": f.field_type, "required": f.required, "regex": f.regex}
            rows.append(F.struct(*[F.lit(v).cast("boolean" if k == "required" else "string").alias(k) for k, v in known.items()], F.try_element_at("pairs", norm_key(F.lit(f.name))).alias("raw")))
        if rows:
            asked = F.when(F.col("template_id") == template_id, F.array(*rows)).otherwise(asked)
    patterns = dict.fromkeys(f.regex for own in fields.values() for f in own if f.regex)

    def checked(r: Column, answers: Column) -> Column:
        v = validate_field(r["field_type"], r["raw"], r["required"], [(r["regex"] == p, p) for p in patterns], answers)
        return let(v, lambda x: F.struct(r["name"].alias("name"), r["required"].alias("required"), *[x[n].alias(n) for n in ("valid", "raw", "normalized", "reason")]))

    present = docs.withColumn("__rows", F.filter(asked, lambda r: r["required"] | r["raw"].isNotNull()))
    helped = present.withColumn("__answers", answers_of(F.col("__rows"), list(patterns)))
    out = helped.withColumn("filled", F.zip_with("__rows", "__answers", checked)).drop("__rows", "__answers")
    needed, good = F.filter("filled", lambda r: r["required"]), F.filter("filled", lambda r: r["required"] & r["valid"])
    score = F.when(F.size(needed) == 0, F.lit(1.0)).otherwise(F.size(good) / F.greatest(F.size(needed), F.lit(1)))
    return out.withColumns({"score": score, "invalid_required": F.size(good) < F.size(needed)})


def apply_corrections(fields: DataFrame, corrections: DataFrame, patterns: list[str]) -> DataFrame:
    """F16: fields after corrections(document_id, name, value): validated anew and marked manually_corrected."""
    c = corrections.select("document_id", "name", F.col("value").alias("new_raw"), F.lit(True).alias("corrected"))
    j = fields.join(c, ["document_id", "name"], "left").withColumn("corrected", F.coalesce("corrected", F.lit(False)))
    j = j.withColumn("raw", F.when(F.col("corrected"), F.col("new_raw")).otherwise(F.col("raw")))
    kind = F.coalesce("field_type", F.lit("texto"))
    j = j.withColumn("__v", validate_field(kind, F.col("raw"), F.col("required"), _patterns(patterns)))
    keep = [F.when(F.col("corrected"), F.col(f"__v.{n}")).otherwise(F.col(n)).alias(n) for n in ("valid", "normalized", "reason")]
    return j.select("document_id", "template_id", "field_no", "name", "field_type", "required", "regex", "raw", *keep, F.col("corrected").alias("manually_corrected"))


def approvable(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """ids of documents in review that have a template and no required field invalid or absent."""
    bad = fields.where(F.col("required") & ~F.coalesce("valid", F.lit(False))).select("document_id").distinct()
    return docs.where("state = 'em_revisao' and template_id is not null").join(bad, "document_id", "left_anti").select("document_id")
