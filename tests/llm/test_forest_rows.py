"""Thresholds of the isolation forests come from every labelled document, however many there are."""

import numpy as np
from pyspark.sql import functions as F

from docintake.llm import rules_iforest as forest


def test_threshold_of_a_table(spark):
    rng = np.random.default_rng(3)
    for n_good, n_bad in ((0, 5), (40, 0), (3000, 200), (5000, 1)):
        scores, y = rng.random(n_good + n_bad).round(3), np.array([1] * n_good + [0] * n_bad)
        rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, scores, strict=True)], "y int, s double")
        assert forest.calibrated_on(rows, "s") == forest.calibrated(scores, y == 1)


def test_all_rows_are_calibrated_on(spark, monkeypatch):
    """9,000 labelled documents, more than the 8,000 that used to be looked at."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (i * 37 + F.col("id") % 11).cast("string"))), " ")
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), words.alias("text"))
    seen, real = [], forest.calibrated_on
    monkeypatch.setattr(forest, "calibrated_on", lambda scored, name: seen.append(scored.count()) or real(scored, name))
    judged = forest.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert seen == [9_000] * len(forest.FAMILIES) and set(judged) == set(forest.FAMILIES)
    stats = np.array([[r[s] for s in forest.STATS] for r in forest.with_statistics(docs).collect()])
    assert not forest.judge(stats, judged)[1].any()  # without bad rows the threshold lies above all good scores
