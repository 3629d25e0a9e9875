"""File plans against one-by-one runs in plain Python."""

import random
import time
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from docintake.operators import collisions, filing


def one_by_one(plans, manifest, most, keep):
    """[(document_id, position, identical, final)]; with `keep`, each output holds its place for the next ones."""
    holds, out = dict(manifest), []
    for document, position, dest, content in sorted(plans):
        p, final, same = PurePosixPath(dest), None, False
        for i in range(most + 1):
            place = str(p.parent / (f"{p.stem}_{i}{p.suffix}" if i else p.name))
            if place not in holds:
                final = place
                break
            if content is not None and holds[place] == content:
                same = True
                break
        if final and keep:
            holds[final] = content
        out.append((document, position, same, final))
    return out


PLANS, MANIFEST = "document_id long, position int, dest string, hash string", "path string, hash string"


def resolved(fn, spark, plans, manifest, most):
    frames = spark.createDataFrame(plans, PLANS), spark.createDataFrame(manifest, MANIFEST)
    return sorted((r.document_id, r.position, r.identical, r.final) for r in fn(*frames, most).collect())


@pytest.mark.parametrize("most", [3, 10_000])
def test_outputs_one_after_another(spark, most):
    r = random.Random(most)
    names = ["/o/a.pdf", "/o/a_1.pdf", "/o/a_1_1.pdf", "/o/a_2.pdf", "/o/b", "/o/b_1", "/o/.hid", "/o/c.x.pdf", "/o/c.x_3.pdf", "/q/a.pdf"]
    contents = ["h1", "h2", "h3", "h4", "h5", "h6", "h7", None]
    plans = [(d, k, r.choice(names), r.choice(contents)) for d in range(60) for k in range(2)]
    manifest = [(p, r.choice(contents)) for p in ["/o/a.pdf", "/o/a_2.pdf", "/o/a_1_2.pdf", "/o/b_1", "/o/c.x_1.pdf", "/o/zzz.pdf"]]
    assert resolved(collisions.resolve_batch, spark, plans, manifest, most) == one_by_one(plans, manifest, most, keep=True)
    assert resolved(collisions.resolve_collision, spark, plans, manifest, most) == one_by_one(plans, manifest, most, keep=False)


@pytest.mark.parametrize("seed", range(3))
def test_names_that_push_each_other(spark, seed):
    """Chains of numbered names, some held, some wanted by several, in every order."""
    r = random.Random(seed)
    tails = ["", "_1", "_2", "_1_1", "_1_2", "_2_1", "_1_1_1", "_3", "_10", "_01", "_1_01_1"]
    names = [f"/o/{stem}{tail}{end}" for stem in ("a", "x.y", ".h", "_5", "_") for tail in tails for end in (".pdf", "")]
    plans = [(d, k, r.choice(names), r.choice(["h1", "h2", "h3", "h4", None])) for d in range(90) for k in range(2)]
    manifest = [(p, r.choice(["h1", "h2", None])) for p in r.sample(names, 12)]
    most = r.choice([1, 2, 3, 10_000])
    assert resolved(collisions.resolve_batch, spark, plans, manifest, most) == one_by_one(plans, manifest, most, keep=True)


def test_a_folder_of_numbered_names(spark):
    """A million names of one folder that differ in their number: only the contested ones are played."""
    n = 1_000_000
    plans = spark.range(n).select(F.col("id").alias("document_id"), F.lit(0).alias("position"), F.concat(F.lit("/o/doc_"), F.col("id").cast("string"), F.lit(".pdf")).alias("dest"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash"))
    extra = spark.createDataFrame([(-2, 0, "/o/doc_7.pdf", "x"), (-1, 0, "/o/doc_7_1.pdf", "z"), (n, 0, "/o/doc.pdf", "p"), (n + 1, 0, "/o/doc.pdf", "q"), (n + 2, 0, "/o/doc.pdf", "h3")], PLANS)
    began = time.time()
    out = collisions.resolve_batch(plans.unionByName(extra), spark.createDataFrame([], MANIFEST))
    moved = out.where("final is null or final <> dest").collect()
    assert time.time() - began < 60
    # doc_7.pdf is taken and so is doc_7_1.pdf; doc.pdf's second content finds all 10,000 numbers taken, its third is there
    assert {(r.document_id, r.final, r.identical) for r in moved} == {(7, "/o/doc_7_2.pdf", False), (n + 1, None, False), (n + 2, None, True)}


def test_a_taken_name_pushes_the_next_one(spark):
    plans = [(1, 0, "/o/a.pdf", "x"), (2, 0, "/o/a_1.pdf", "y")]
    got = resolved(collisions.resolve_batch, spark, plans, [("/o/a.pdf", "z")], 10_000)
    assert [f for *_, f in got] == ["/o/a_1.pdf", "/o/a_1_1.pdf"]


def test_contents_without_a_hash_are_never_identical(spark):
    got = resolved(collisions.resolve_batch, spark, [(1, 0, "/o/a", None), (2, 0, "/o/a", None)], [], 10_000)
    assert got == [(1, 0, False, "/o/a"), (2, 0, False, "/o/a_1")]


def test_crowded_name(spark):
    """10,000 siblings and 100,000 outputs of one name: two get numbers, contents that are there count as identical."""
    held = [("/o/a.pdf", "m0")] + [(f"/o/a_{i}.pdf", f"m{i}") for i in range(1, 10_001) if i not in (500, 9_000)]
    manifest = spark.createDataFrame(held, MANIFEST)
    content = F.when(F.col("id") % 10 == 0, F.concat(F.lit("m"), (F.col("id") % 5000).cast("string"))).otherwise(F.concat(F.lit("n"), F.col("id").cast("string")))
    plans = spark.range(1, 100_001).select(F.col("id").alias("document_id"), F.lit(0).alias("position"), F.lit("/o/a.pdf").alias("dest"), content.alias("hash"))
    for fn, placed in ((collisions.resolve_batch, 2), (collisions.resolve_collision, None)):
        began = time.time()
        got = {r.document_id: r for r in fn(plans, manifest).collect()}
        assert time.time() - began < 60 and len(got) == 100_000
        if placed:
            finals = {k: r.final for k, r in got.items() if r.final}
            assert finals == {1: "/o/a_500.pdf", 2: "/o/a_9000.pdf"} and got[99_990].identical and not got[99_991].identical


def test_no_free_number_is_an_error(spark):
    outputs = spark.createDataFrame([(1, 0, "move", "/o/a", "x", "/in/a"), (2, 0, "copy", "/o/b", "x", "/in/b")], "document_id long, position int, kind string, dest string, hash string, source string")
    manifest = spark.createDataFrame([("/o/a", "y"), ("/o/a_1", "z")], MANIFEST)
    rows = {r.document_id: r for r in filing.audit_rows(collisions.resolve_collision(outputs, manifest, 1), "run").collect()}
    assert rows[1].status == "error" and rows[2].status == "done" and rows[2].dest_path == "/o/b"
