"""Queries of the training-data operators, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fim, hard_negatives, html_main, langid, pii, quality_mil, rules_iforest, secret_scan, sentencepiece_bpe, sharding, simhash, twins
from .common import id_crc32, table


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def public_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def spans_column(keep: F.Column | None = None) -> F.Column:
    """kind:start:end of the parallel span arrays, comma-joined in their order."""
    spans = F.arrays_zip("kinds", "starts", "ends")
    return F.array_join(
        F.transform(
            F.filter(spans, lambda s: s["kinds"] != keep) if keep is not None else spans,
            lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")),
        ),
        ",",
    )


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_mil.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (id_crc32("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules_iforest.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *base, "base_failed", "kept", "anomaly")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op6_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))

    def joined(*kinds: str) -> F.Column:
        each = F.transform(F.concat(*kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(each, ",")

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(*pii.KINDS).cast("binary"), 256).alias("base_sha256"), joined(*pii.KINDS, "term").alias("spans"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), *public_vocabulary())


def op9_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(spans_column(F.lit("entropy")).cast("binary"), 256).alias("base_sha256"),
        spans_column().alias("spans"),
    )


def op7_dom_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (id_crc32("doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, "vec_id % 50 = 0")


def op12_sentencepiece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.checked(table(spark, sf_dir, "documents"), public_pieces())


def op13_fenwick_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = (
    op1_hilbert_shards, op2_simhash_near_dedup, op3_attention_quality, op4_isolation_rules, op5_winnowing,
    op6_pii_disclosure, op7_dom_belief, op8_byte_bpe, op9_secret_entropy, op10_byte_cnn_language,
    op11_hard_negatives, op12_sentencepiece_agenda, op13_fenwick_fim,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """The others hold a part that DuckDB cannot say: XXH64, trained models, offsets of matches, tokenizer ranks."""
    return {"op1_hilbert_shards": twins.hilbert_shards(["lang", "source", "n_chars"], 24, 5), "op5_winnowing": twins.WINNOWING, "op11_hard_negatives": twins.HARD_NEGATIVES, "op13_fenwick_fim": twins.FIM}
