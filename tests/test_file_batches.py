"""A stream of many small files: bounded batches that lose no file, and few tasks for many files."""

from docintake.sources import files
from docintake.streaming import ops


def test_batches_hold_all_files(spark, tmp_path):
    rows = [(f"/in/{k % 3}/{k}.pdf", f"text {k}".encode()) for k in range(250)]
    files.put_files(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path / "files"))
    before = {k: spark.conf.get(k) for k in ops.SMALL_FILES}
    with ops.lowered(spark, ops.SMALL_FILES):
        run = ops.land_batches(ops.file_stream(spark, str(tmp_path / "files"), 100), "append", str(tmp_path / "rows"), str(tmp_path / "c"))
        run.awaitTermination()
    assert [p["numInputRows"] for p in run.recentProgress] == [100, 100, 50]
    assert sorted(bytes(r.content) for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == sorted(c for _, c in rows)
    assert {k: spark.conf.get(k) for k in ops.SMALL_FILES} == before


def test_few_tasks_for_many_files(spark, tmp_path):
    files.put_files(spark.range(700).selectExpr("concat('/', id, '.pdf') path", "encode('x', 'UTF-8') content"), str(tmp_path / "in"))
    with ops.lowered(spark, ops.SMALL_FILES):
        found = files.scan_files(spark, str(tmp_path / "in"))
        assert found.count() == 700 and found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
