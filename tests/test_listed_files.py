"""Files are listed and read by tasks: each row a file of its own, each file once, none known to the driver."""

from docintake.sources import files
from docintake.streaming import ops


def test_rows_with_one_path_are_as_many_files(spark, tmp_path):
    rows = [("/in/a.pdf", b"1"), ("/in/a.pdf", b"2"), ("/in/a.pdf", b"2"), ("/in/b c%20.PDF", b""), ("/in/c.txt", b"x")]
    files.put_files(spark.createDataFrame(rows, "path string, content binary").coalesce(2), str(tmp_path / "in"))
    got = sorted((r.path.rsplit("/", 1)[1], bytes(r.content), r["size"]) for r in files.scan_files(spark, str(tmp_path / "in")).collect())
    assert got == [("a.pdf", b"1", 1), ("a.pdf", b"2", 1), ("a.pdf", b"2", 1), ("b c%20.PDF", b"", 0)]


def test_names_that_spark_passes_over(spark, tmp_path):
    (tmp_path / "in" / "_sub").mkdir(parents=True)
    for name in ("_a.pdf", ".b.png", "_sub/c.jpg", ".pdf"):
        (tmp_path / "in" / name).write_bytes(b"x")
    found = files.scan_files(spark, str(tmp_path / "in"))
    assert sorted(r.path.removeprefix(f"file:{tmp_path}/in/") for r in found.collect()) == [".b.png", "_a.pdf", "_sub/c.jpg"]
    assert not found.select("path", "size").where("size > 5").count() and files.scan_files(spark, str(tmp_path / "none")).count() == 0


def test_the_driver_knows_of_no_file(spark, tmp_path):
    files.put_files(spark.range(50).selectExpr("concat('/', id, '.pdf') path", "encode('x', 'UTF-8') content"), str(tmp_path / "in"))
    found = files.scan_files(spark, str(tmp_path / "in"))
    assert found.count() == 50 and not any(p.endswith(".pdf") for p in found.inputFiles())


def test_pattern_goes_by_the_source(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"in{k}").mkdir()
        (tmp_path / f"in{k}" / f"{k}.pdf").write_bytes(b"x")
    assert sorted(r.path[-5:] for r in files.scan_files(spark, f"{tmp_path}/in[01]").collect()) == ["0.pdf", "1.pdf"]


def test_listed_stream_lands_each_file_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ops, "NAMES_EACH", 10)
    put = lambda a, b, to: files.put_files(spark.range(a, b).selectExpr("concat('/', id % 3, '/', id, '.pdf') path", "encode(string(id), 'UTF-8') content"), str(tmp_path / "in" / to))

    def land():
        run = ops.land_batches(ops.listed_stream(spark, str(tmp_path / "in"), str(tmp_path / "listings"), 2), "append", str(tmp_path / "rows"), str(tmp_path / "c"))
        run.awaitTermination()
        return sorted(int(bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "rows")).collect()), len(run.recentProgress)

    got, batches = land()
    assert got == [] and batches <= 1
    put(0, 95, "first")
    got, batches = land()
    assert got == list(range(95)) and batches >= 5
    put(95, 100, "second")
    assert land()[0] == list(range(100))
    assert land()[0] == list(range(100))
