"""Mined negatives against all pairs."""

import math
import random

import pytest

from docintake.llm import hard_negatives as hn
from docintake.llm import queries as q


def slow(rows, every, window=hn.Window(), scale=256):
    """Rows are (vec_id, label, vector), ids once each."""
    fine = []
    for i, y, v in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, y, [math.floor(scale * x) for x in v]))
    out = set()
    for a, label, v in fine:
        if a % every:
            continue
        scored = sorted((-sum(x * z for x, z in zip(v, w, strict=False)), i, y) for i, y, w in fine if i != a)
        positives = [(i, -s) for s, i, y in scored if y == label][: window.positives]
        for p, ps in positives:
            inside = [(i, -s) for s, i, y in scored if y != label and window.low * ps <= 100 * -s <= window.high * ps]
            out |= {(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(inside[: window.negatives], 1)}
    return out


def mined(spark, rows, every, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = [tuple(r) for r in hn.mine(df.repartition(3), f"vec_id % {every} = 0", **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [hn.BLOCK, 3])
def test_against_all_pairs(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.randrange(3), [rng.choice([-1.5, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(3)]) for i in range(120)]
    window = hn.Window(positives=4, negatives=2, low=20, high=100)
    for w in (hn.Window(), window):  # few values, so many ties and scores of zero and below
        assert mined(spark, rows, 10, window=w, block=block) == slow(rows, 10, w)


def test_small_batches_and_slices(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, rng.randrange(2), [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(hn, "AT_ONCE", 20)
    try:
        assert mined(spark, rows, 9) == slow(rows, 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_that_take_no_part(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    odd = [(None, 1, [1.0] * 4), (60, None, [1.0] * 4), (61, 1, None), (70, 1, [1.0, None, 1.0, 1.0]), (80, 1, [1.0, float("nan"), 0.0, 0.0]), (90, 1, [float("inf")] * 4), (100, 2, [1.0, 2.0]), (110, 1, [])]
    assert mined(spark, rows + odd, 10) == slow(rows + odd, 10) != slow(rows, 10)


def test_repeated_rows_and_hot_vectors(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    same = [(i, 1, [0.5, 0.5, 0.5, 0.5]) for i in range(100, 400)]  # most rows hold one vector and one label
    assert mined(spark, (rows + same) + rows[:30] + same * 2, 10) == slow(rows + same, 10)
    twin = [(10, 2, [1.0, -1.0, 0.5, 0.5])] * 9 + [(10, 2, [1.0, -1.0, 0.5, 0.25])]
    got = mined(spark, rows + twin, 10)
    assert {r[0] for r in got} <= {r[0] for r in rows} and slow(rows, 10) != got


def test_large_numbers(spark):
    for scale in (1e3, 1e9, 1e15):
        rng = random.Random(7)
        rows = [(i, rng.randrange(2), [rng.choice([-1.0, 0.5, 0.75]) for _ in range(3)]) for i in range(40)]
        want = {r for r in slow(rows, 5, scale=scale) if abs(r[4]) < 1 << 63}
        if scale < 1e10:
            assert mined(spark, rows, 5, scale=scale) == want
        else:
            mined(spark, rows, 5, scale=scale)  # beyond 64 bits: ends, with scores at the limit


def test_keys_sort_as_pairs():
    pairs = [(0, 5, 0, 1), (0, 5, 0, 3), (0, 5, 1, -7), (0, 0, 1, 2), (0, -4, 0, 9), (1, 8, 1, 0)]
    keys = [hn.pack(*p) for p in pairs]
    assert keys == sorted(keys) and [hn.unpack(k) for k in keys] == pairs


def test_edges(spark, sf):
    assert mined(spark, [], 10) == set()
    assert mined(spark, [(0, 1, [1.0])], 10) == set()
    wide = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("*", "1 as key", "2 as score", "3 as anchor_id")
    assert hn.mine(wide, "vec_id % 50 = 0").count() > 0
    with pytest.raises(ValueError):
        hn.Window(high=120)


def test_query(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = q.op11_hard_negatives(spark, sf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r) for r in got.collect()} == slow(rows, 50)
