"""Top-k search and mixing against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddymesh.llm import mixing, topk


@pytest.mark.parametrize("k", [3, 20, 500])
def test_top_k(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(200)]
    rows += [(i, rows[3][1]) for i in range(200, 280)]  # one very common vector
    rows += [(280 + i, [float(x) for x in rng.normal(0, 0.3, 5)]) for i in range(30)]  # of another length
    bad = [(400, None), (420, [None] * 8), (440, [math.nan] * 8), (460, [math.inf] * 8), (480, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5)
    own = df.select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in topk.top_k(own, own.where("id % 20 = 0"), k).collect())
    q = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows}
    want = []
    for i in (i for i in q if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i]))[:k]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("size", [1e5, 1e7, 3e7, 1e9, 3e38])
def test_top_k_of_large_components(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 4) * (size if i % 3 else 1.0)]) for i in range(120)] + [(121, [size, -size, size, 0.5]), (140, [-size] * 4), (160, [size] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    own = df.select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in topk.top_k(own, own.where("id % 20 = 0"), 9).collect())
    q = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows}
    want = []
    for i in (i for i in q if i % 20 == 0):
        best = sorted((-min(topk.MOST, max(topk.LEAST, sum(a * b for a, b in zip(q[i], q[j])))), j) for j in q if j != i)[:9]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v array<long>")
    assert topk.top_k(df, df).count() == 0
    one = spark.createDataFrame([(0, [1, 2])], "id long, v array<long>")
    assert topk.top_k(one, one).count() == 0


def documents(spark):
    rows = [(i, "w " * (1 + i % 13), f"s{i % 5}", 1, 2) for i in range(400)] + [(900 + i, "hot word " * 5, "hot", 1, 2) for i in range(500)]
    rows += [(None, "a b c", None, 1, 2), (2000, None, None, 1, 2), (2001, "", "void", 1, 2), (2002, "x " * 500, "s0", 1, 2), (5, "w w", "s0", 1, 2), (5, "w w", "s0", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int").repartition(4)


def test_mixture(spark, monkeypatch):
    docs = documents(spark)
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count()
    sizes, goal, taken = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        assert goal.setdefault(r.source, r.target) == r.target
        taken[r.source] += r.taken
        assert r.taken == r.passes * r["size"] <= 2 * r["size"] and len(r.positions) == r.passes
        assert all(0 <= p <= 1 for p in r.positions)
        assert r.source_size is not None
    names = sorted(n for n in sizes if n is not None) + [None]
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    want, total = {n: 0.0 for n in names}, 1.5 * sum(sizes.values())
    open_ = set(names)
    while open_:
        left = total - sum(want[n] for n in names if n not in open_)
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > 2 * sizes[n]}
        for n in over or open_:
            want[n] = 2.0 * sizes[n] if over else share[n]
        open_ = open_ - over if over else set()
    for n in names:
        assert goal[n] == pytest.approx(want[n])
        assert abs(taken[n] - goal[n]) <= max((r["size"] for r in rows if r.source == n), default=0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    again = {(r.doc_id, r.text): r.positions for r in mixing.mixture(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text): r.positions for r in rows}


def test_times_follow_the_schedule(spark):
    schedule = [(0.0, 1.0), (0.5, 3.0), (1.0, 0.0)]
    got = [r.t for r in spark.range(0, 101).select(mixing.time_of(schedule, F.col("id") / 100).alias("t")).collect()]
    grid = np.linspace(0, 1, 200_001)
    passed = np.cumsum(np.interp(grid, *zip(*schedule))) / 200_000 / mixing.integral(schedule)
    assert np.allclose(got, np.interp(np.arange(101) / 100, passed, grid), atol=2e-3)


def test_mixed_copies_in_order(spark):
    docs = documents(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.passes for r in mixing.mixture(docs).collect())
    assert mixing.mixed(docs.limit(0)).count() == 0
