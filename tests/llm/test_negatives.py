"""Hard negatives: SQL, brute force over odd vectors, the curve, the bounds and what they save."""

import math

import numpy as np
import pytest
from llm_util import SF, SMALL, against_sql, as_rows
from pyspark.sql import functions as F

from loanscope.llm import negatives as N

VECS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    """All pairs of (vec_id, embedding, label) rows, in Python integers."""
    good = []
    for v, e, lab in rows:
        if v is None or lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        good.append((v, [math.floor(256 * x) for x in e], (lab + 1) % 10 if v % 7 == 0 else lab))
    out = []
    for a, (v, q, lab) in enumerate(good):
        if v % every:
            continue
        score = [sum(x * y for x, y in zip(q, r)) for _, r, _ in good]
        order = sorted(range(len(good)), key=lambda i: (-score[i], good[i][0]))
        for p in [i for i in order if i != a and good[i][2] == lab][:positives]:
            fits = [i for i in order if good[i][2] != lab and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(v, good[p][0], n + 1, good[i][0], score[p], score[i]) for n, i in enumerate(fits[:negatives])]
    return sorted(out, key=repr)


def mined(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return as_rows(N.hard_negatives(df, moved, F.col("vec_id") % 50 == 0))


def test_query_against_sql_and_brute_force(spark):
    got, want = against_sql(spark, "op11_negatives", SF)
    assert got == want and len(got) > 20
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert as_rows(N.op11_negatives(spark, SMALL)) == brute(rows)


def odd_rows():
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((5, 12))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 5] * 0.3 + rng.standard_normal(12) * 0.1], int(rng.integers(0, 4)))
            for i in range(700)]
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 3) for i in range(400)]                     # a third of all are one vector
    rows += [(50, rows[50][1], 1), (50, rows[50][1], 1), (100, rows[7][1], 2), (100, None, 1), (150, [], 1), (151, [], 2)]
    rows += [(None, hot, 1), (2000, hot, None), (2050, [float("nan")] * 12, 1), (2100, [None] + hot[1:], 1),
             (2150, [float("inf")] + hot[1:], 2), (2200, [0.0] * 12, 3), (2250, hot[:5], 1), (2300, [-x for x in hot], 2),
             (2350, hot, 77), (2400, [300.0] * 12, 2), (2401, [200.0] * 12, 3), (2402, [290.0] * 12, 2)]
    return rows


@pytest.mark.parametrize("block,group,home", [(1024, 256, 2), (16, 7, 2), (50, 20, 1)])
def test_odd_rows(spark, monkeypatch, block, group, home):
    for name, value in (("BLOCK", block), ("GROUP", group), ("HOME", home), ("PART", 3), ("ZONES", 20), ("KEPT", 900)):
        monkeypatch.setattr(N, name, value)
    df = spark.createDataFrame(odd_rows(), VECS).selectExpr("*", "1 AS row", "2 AS block", "3 AS low", "'x' AS key", "4 AS grp").repartition(4)
    assert mined(df) == brute(odd_rows())


def test_no_rows(spark):
    assert mined(spark.createDataFrame([], VECS)) == []
    assert mined(spark.createDataFrame([(50, [1.0], 1)], VECS)) == []
    assert mined(spark.createDataFrame([(50, None, 1), (None, [1.0], 1)], VECS)) == []


def test_curve_is_a_hilbert_curve():
    side = np.arange(8)
    x = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = N.hilbert_keys(x, 3)
    assert len(set(keys)) == 512
    path = x[sorted(range(512), key=lambda i: keys[i])]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()      # each step goes to a neighbour


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (40, 9)), rng.integers(-300, 300, (60, 9))
    least, most = N.bounds(a, b.min(0, keepdims=True), b.max(0, keepdims=True))
    s = a @ b.T
    assert (least <= s.min(1, keepdims=True)).all() and (most >= s.max(1, keepdims=True)).all()
    big = rng.integers(-(1 << 27), 1 << 27, (3, 40))
    assert N.products(big, big).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in big] for r in big]


@pytest.mark.parametrize("scale", [1, 1 << 52])
def test_best_breaks_ties_by_place(scale):
    rng = np.random.default_rng(2)
    s = rng.integers(-4, 5, (30, 50)) * scale
    fits = rng.random(s.shape) < 0.5
    i, j = N.best(s, fits, 4)
    for r in range(30):
        want = sorted(np.flatnonzero(fits[r]).tolist(), key=lambda c: (-int(s[r, c]), c))[:4]
        assert sorted(j[i == r].tolist()) == sorted(want)


def test_bounds_save_blocks_where_vectors_cluster(spark, monkeypatch):
    """Of clusters far apart, an anchor's positives need a few blocks only."""
    monkeypatch.setattr(N, "BLOCK", 40)
    rng = np.random.default_rng(5)
    sign = np.where(np.arange(40 * 8).reshape(40, 8) * 2654435761 % 97 % 2 == 0, 1.0, -1.0)
    rows = [(i, [float(x) for x in sign[i % 40] + rng.standard_normal(8) * 0.02], i % 40 % 5) for i in range(4000)]
    points = N.points_of(spark.createDataFrame(rows, VECS), F.col("label"))
    blocks = N.blocks_of(points)
    zones, chunks = N.zones_of(blocks)
    asked = N.anchors_of(points.where("vec_id % 50 = 0")).withColumn("low", F.array(F.lit(1800 * 256).cast("long"))).withColumn(
        "high", F.array(F.lit(N.HIGHEST).cast("long")))
    reads = N.chosen(asked, zones, chunks, True, None)
    pairs = sum(len(r.row) // 8 for r in reads.collect())
    assert 0 < pairs < 80 * blocks.count() / 4
