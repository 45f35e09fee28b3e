"""Ranks, running sums and correlations by buckets and blocks, against plain loops, on one hot group as well."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraline.functions import stats
from spectraline.plans import features, signal


def mean_ranks(values):
    order = sorted(values)
    return {v: order.index(v) + (order.count(v) + 1) / 2 for v in set(values)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = [("hot", i, round(rng.gauss(0, 3), 1)) for i in range(900)] + [("cold", i, float(i % 3)) for i in range(900, 920)]
    out += [(None, 1000, 5.0), (None, 1001, 5.0), (None, 1002, 1.0), ("hot", 1003, None)]
    return out, spark.createDataFrame(out, "g string, id long, v double").cache()


def test_prefix_sums(rows):
    data, df = rows
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    for r in stats.prefix_sums(counts, ["g"], "v", ["n", "s"]).collect():
        below = [i for g, i, v in data if g == r.g and (r.v is not None and (v is None or v < r.v))]
        assert (r.n_before, r.s_before) == (len(below), sum(below))


def test_average_ranks(rows):
    data, df = rows
    got = {r.id: r["rank"] for r in stats.average_ranks(df.filter("v is not null"), "v", ["g"]).collect()}
    for g in ("hot", "cold", None):
        want = mean_ranks([v for h, _, v in data if h == g and v is not None])
        assert all(got[i] == want[v] for h, i, v in data if h == g and v is not None)


def test_no_task_sorts_a_group(rows):
    """One group is ranked in many buckets: no window is over the group alone, but for the sums of buckets."""
    _, df = rows
    plan = stats.average_ranks(df, "v", ["g"])._jdf.queryExecution().sparkPlan().toString().split("\n")
    for i, line in enumerate(plan):
        if " Window " in f" {line} " or "+- Window" in line:
            assert "_bucket" in line and ("Aggregate" in "".join(plan[i + 1 : i + 4]) or line.count("_bucket") >= 1), line
    hot = df.filter("g = 'hot' and v is not null")
    sizes = [r["count"] for r in hot.withColumn("b", stats.value_buckets(hot, "v")).groupBy("b").count().collect()]
    assert len(sizes) > 60 and max(sizes) < 60


def test_next_in_order(spark):
    rng = random.Random(8)
    data = [(float(rng.randint(0, 300)), i, rng.random()) for i in range(500)]
    got = {r.i: (r.next_x, r.next_w) for r in stats.next_in_order(spark.createDataFrame(data, "x double, i long, w double"), ["x", "i"], ["x", "w"]).collect()}
    order = sorted(data)
    assert got == {a[1]: (b[0], b[2]) for a, b in zip(order, order[1:], strict=False)} | {order[-1][1]: (None, None)}


@pytest.mark.parametrize("by", [(), ("fold",)])
def test_zeros_left_out_rank_alike(spark, by):
    rng = random.Random(6)
    data = [(f, c, i % 2, rng.choice([0.0] * 6 + [-1.0, -0.5, 1.0, 2.0, 2.0 + i % 2])) for f in range(2) for i in range(60) for c in range(4)]
    long = spark.createDataFrame(data, "fold int, channel int, target int, value double").cache()
    totals = long.filter("channel = 0").groupBy("fold", "target").agg(F.count("*").alias("n"))
    full = sorted(tuple(r) for r in stats.mann_whitney(long, *by).collect())
    sparse = sorted(tuple(r) for r in stats.mann_whitney(long.filter("value <> 0"), *by, totals=totals).collect())
    assert np.allclose(np.array(full), np.array(sparse)) and len(full) == 4 * (2 if by else 1)
    for r in stats.mann_whitney(long.filter("value <> 0"), *by, totals=totals).collect():
        own = [(y, v) for f, c, y, v in data if c == r.channel and (not by or f == r.fold)]
        u = sum((a > b) + 0.5 * (a == b) for y, a in own if y == 0 for z, b in own if z == 1)
        assert r.u == pytest.approx(u)


def test_sparse_ranks_shuffle_only_what_is_not_zero(spark):
    """The query's plan filters zeros before anything is exchanged."""
    plan = features.f2(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "NOT (" in plan and "0.0" in plan


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_in_blocks(spark, method):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 7)).round(1)
    x[:, 3] += 2 * x[:, 0]
    x[:, 6] = 1.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(4)
    y = x.copy()
    if method == "spearman":
        for c in range(7):
            ranks = mean_ranks(x[:, c].tolist())
            y[:, c] = [ranks[v] for v in x[:, c].tolist()]
    got = {(r.f, r.g): r.r for r in stats.correlations(df, method, width=3, at_once=2).collect()}
    assert len(got) == 49
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(y.T)
    for (f, g), r in got.items():
        assert r is None if 6 in (f, g) else r == pytest.approx(want[f, g])


def test_many_features(spark):
    """Two thousand features: four million pairs stay a distributed table."""
    df = spark.range(40).selectExpr("id", "transform(sequence(0, 1999), i -> double((id * (i + 7) + i * i) % 101)) as features")
    out = stats.correlations(df, at_once=20)
    assert out.count() == 2000 * 2000 and out.filter("f = g and abs(r - 1) > 1e-9").count() == 0


def test_mean_roc_by_loop(spark):
    rng = random.Random(9)
    data = [(f, rng.randint(0, 1), float(rng.randint(0, 20))) for f in range(3) for _ in range(60)]
    got = {r.k: (r.mean, r.std) for r in stats.mean_roc(spark.createDataFrame(data, "fold int, target int, score double"), "fold", "score").collect()}
    curves = []
    for f in range(3):
        own = [(s, y) for g, y, s in data if g == f]
        p, q = sum(y for _, y in own), sum(1 - y for _, y in own)
        points = [(0.0, 0.0)] + [(sum(1 - y for s, y in own if s >= c) / q, sum(y for s, y in own if s >= c) / p) for c in sorted({s for s, _ in own}, reverse=True)]
        curve = {}
        for (f0, t0), (f1, t1) in zip(points, points[1:], strict=False):
            curve |= {k: t0 + (t1 - t0) * (k / 99 - f0) / (f1 - f0) for k in range(100) if f0 < k / 99 <= f1}
        first = next(t for (f, t), nxt in zip(points, points[1:], strict=False) if nxt[0] > 0)
        curves.append([first, *(curve[k] for k in range(1, 100))])
    want = np.mean(curves, axis=0)
    assert set(got) == set(range(100)) and all(got[k][0] == pytest.approx(want[k]) for k in range(100))


def test_peak_overlap_by_loop(spark):
    sf = "/root/testdata/sf0.001"
    order = sorted((r.mz, r.idx, r.width) for r in signal.P.lipids(spark, sf).collect())
    gaps = [max(a[0] + 3 * a[2] - (b[0] - 3 * b[2]), 0) for a, b in zip(order, order[1:], strict=False)]
    assert signal.w9(spark, sf).first().overlap == pytest.approx(np.mean(gaps), abs=1e-6)
