"""Keys that a few fingerprints explode into are joined by sorting, however small Spark takes them to be."""

from pyspark.sql import functions as F

from docintake.llm import simhash


def test_keys_are_not_broadcast(spark):
    nodes = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(nodes)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_many_spots_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_SPOTS", 0)
    nodes = spark.range(3000).select((F.xxhash64("id") % 7).alias("fp"))
    found = simhash.links(nodes.distinct(), hot=2)
    kinds = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "LeftSemi" in line]
    assert kinds and all("SortMergeJoin" in line for line in kinds)
    assert found.where("bit_count(a ^ b) > 4").count() == 0
