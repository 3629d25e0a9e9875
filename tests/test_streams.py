"""Streams over several files whose times interleave give what one ordered table gives."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_queries import duck, plain  # noqa: F401 - a fixture

from docintake import catalog


@pytest.mark.parametrize("order", [1, -1])
@pytest.mark.parametrize("name", ["t3_quiet_files", "t4_live_states"])
def test_files_of_interleaved_times(name, order, spark, sf, duck, tmp_path):  # noqa: F811
    events = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values("ts", ascending=order > 0)
    (tmp_path / "events.parquet").mkdir()
    # 12 files are three batches; the newest rows come first or last, and every file spans all times
    for i in range(12):
        events.iloc[i::12].to_parquet(tmp_path / "events.parquet" / f"{i:02}.parquet", coerce_timestamps="us")
    assert plain(catalog.queries()[name](spark, str(tmp_path)).toPandas()) == plain(duck.sql(catalog.oracle_sql()[name]).df())


def test_file_stream(spark, tmp_path):
    from docintake.streaming import ops

    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in (("a.PDF", b"%PDF-1"), ("sub/b.jpg", b"\xff\xd8x"), ("c.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(data)

    def land():
        run = ops.file_stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        run.awaitTermination()
        return sorted((r.path.rsplit("/", 1)[1], r["size"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert land() == [("a.PDF", 6), ("b.jpg", 3)]
    (tmp_path / "in" / "d.png").write_bytes(b"png!")
    assert land() == [("a.PDF", 6), ("b.jpg", 3), ("d.png", 4)]  # each file once


def _land(spark, rows, where, files):
    rows = pa.Table.from_pandas(rows.sort_values("ts"), preserve_index=False)
    where.mkdir()
    for i in range(files):  # every file spans all times
        pq.write_table(rows.take(list(range(i, len(rows), files))), where / f"{i:03}.parquet", coerce_timestamps="us")
    return spark.read.parquet(str(where)).schema


def _size(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_states_do_not_grow_with_batches(spark, sf, tmp_path):
    """2 and 6 batches of rows that are late each time keep the same summaries and end in what the batch form says."""
    from docintake.operators import lifecycle
    from docintake.plans.inputs import frame
    from docintake.streaming import ops

    for name, start, form in (("state_log", ops.live_states, lifecycle.replay_states), ("observations", ops.quiet_files, None)):
        table = frame(spark, sf, name).withColumn("ts", F.col("ts").cast("timestamp")).where("ts < '2024-01-03'")
        kept, ends = {}, {}
        for batches in (2, 6):
            root = tmp_path / f"{name}{batches}"
            schema = _land(spark, table.toPandas(), root, 6)
            where = tmp_path / f"{name}{batches}-out"
            start(ops.table_stream(spark, str(root), schema, 6 // batches), str(where), str(where / "checkpoint"), buckets=2).awaitTermination()
            assert len(list((where / "results").glob("batch=*"))) == batches
            kept[batches] = spark.read.parquet(str(where / "pieces")).count(), _size(where / "pieces")
            key = "document_id" if form else "path"
            ends[batches] = sorted(map(repr, (ops.latest(spark, str(where), key) if form else ops.quiet(ops.latest(spark, str(where), key), 3600)).collect()))
        assert kept[2][0] == kept[6][0] and abs(kept[2][1] - kept[6][1]) < 0.1 * kept[2][1] and ends[2] == ends[6]
        if form:
            assert ends[2] == sorted(map(repr, form(table).collect()))
        else:
            assert len(ends[2]) > 0


def test_gate_reads_the_prefixes_of_its_batch(spark, tmp_path):
    from docintake.streaming import ops

    schema = "path string, hash string, arrival long"
    where = tmp_path / "in"
    for number, names in enumerate((["aa1", "bb1", "aa1"], ["aa1", "cc1"], ["bb1", "aa2", "zz9"])):
        rows = [(f"/in/{number}-{k}.pdf", h, number * 10 + k) for k, h in enumerate(names)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(where))
        files = spark.readStream.schema(schema).parquet(str(where))
        ops.gate_stream(files, str(tmp_path / "registry"), str(tmp_path / "c")).awaitTermination()
    registry = spark.read.parquet(str(tmp_path / "registry"))
    assert sorted((r.hash, r.filename, r.duplicate_hits) for r in ops.registry_hits(registry).collect()) == [("aa1", "0-0.pdf", 2), ("aa2", "2-1.pdf", 0), ("bb1", "0-1.pdf", 1), ("cc1", "1-1.pdf", 0), ("zz9", "2-2.pdf", 0)]
    plan = ops.known_hashes(spark, str(tmp_path / "registry"), ["aa", "zz"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.hash for r in ops.known_hashes(spark, str(tmp_path / "registry"), ["aa", "zz"], 2).collect()) == ["aa1"]
    assert ops.known_hashes(spark, str(tmp_path / "none"), ["aa"], 0).count() == 0


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    from docintake.sources import files

    df = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "k long, v string")
    where = str(tmp_path / "t")
    files.write_stage(df.where("k < 20"), where, "k", 0)
    for _ in range(2):
        files.write_stage(df.where("k < 35"), where, "k", 1)
    assert sorted((r.k, r.v) for r in files.staged_table(spark, where).collect()) == [(k, f"v{k}") for k in range(35)]
    assert {r[0] for r in spark.read.parquet(where).where("k >= 20").select("batch").distinct().collect()} == {1}
    files.write_stage(df, where, "k")
    files.write_stage(df, where, "k")
    assert files.staged_table(spark, where).count() == 50


def test_ignored_files_are_never_opened(spark, tmp_path):
    """A file that the rule ignores may be too large to read, or not readable at all."""
    from docintake.sources import files
    from docintake.streaming import ops

    for name, data in (("a.PDF", b"%PDF-1"), ("sub/b.JpEg", b"x"), ("sub/big.txt", b"x" * 5000), ("c.pdf.bak", b"x" * 5000), ("d", b"x" * 5000), ("e.png", b"png")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        want = ["a.PDF", "b.JpEg", "e.png"]
        assert sorted(r.path.rsplit("/", 1)[1] for r in files.scan_files(spark, str(tmp_path / "in")).collect()) == want
        run = ops.file_stream(spark, str(tmp_path / "in")).select("path").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
