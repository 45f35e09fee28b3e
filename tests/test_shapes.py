"""Interval index, rasters, blobs, noise and isotope chains against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraline.operators import binning, peaks, spatial

RING = "array<struct<x:double,y:double>>"


@pytest.mark.parametrize("salt", [1, 3])
def test_bins_of_all_widths(spark, salt):
    rng = random.Random(7)
    points = [(i, rng.choice([rng.uniform(-5, 105), float(rng.randint(0, 100))]), 1.0) for i in range(500)]
    spans = [(0, 0.0, 100.0)] + [(i, lo := rng.uniform(-3, 100), lo + 10 ** rng.uniform(-5, 2)) for i in range(1, 150)] + [(200 + i, float(i), float(i + 1)) for i in range(100)] + [(400, 7.0, 7.0)]
    got = binning.range_join(spark.createDataFrame(points, "id long, mz double, intensity double"), spark.createDataFrame(spans, "bin_idx long, lo double, hi double"), salt=salt)
    assert sorted((r.id, r.bin_idx) for r in got.collect()) == sorted((i, b) for i, m, _ in points for b, lo, hi in spans if lo <= m <= hi)
    assert set(got.columns) == {"id", "mz", "intensity", "bin_idx", "lo", "hi"}


def test_one_wide_bin_adds_no_cells(spark):
    """10,000 narrow bins and one over all of them are stored in two cells each at most, and peaks are probed twice."""
    bins = spark.range(10_000).selectExpr("id as bin_idx", "id * 0.1 as lo", "id * 0.1 + 0.1 as hi").unionByName(spark.sql("select 10000L as bin_idx, 0d as lo, 1000d as hi"))
    stored = bins.withColumn("level", binning.level(F.col("lo"), F.col("hi")))
    n = stored.withColumn("cell", F.explode(binning.cells(F.col("lo"), F.col("hi"), F.pow(F.lit(2.0), F.col("level"))))).count()
    assert n <= 20_002 and stored.select("level").distinct().count() <= 3
    p = spark.range(1000).selectExpr("id", "id + 0.05 as mz", "1d as intensity")
    assert binning.bin_sum(p, bins, ["id"]).count() == 2000


def test_zero_fill(spark):
    bins = spark.createDataFrame([(3, 0.0, 1.0), (5, 1.0, 2.0)], "bin_idx long, lo double, hi double")
    p = spark.createDataFrame([("a", 0.5, 2.0), ("b", 7.0, 1.0)], "k string, mz double, intensity double")
    rows = p.select("k")
    filled = binning.zero_filled(binning.bin_sum(p, bins, ["k"]), rows, bins, ["k"])
    assert sorted(map(tuple, filled.collect())) == [("a", 3, 2.0), ("a", 5, 0.0), ("b", 3, 0.0), ("b", 5, 0.0)]
    assert binning.counted(filled, rows, bins) is filled
    with pytest.raises(ValueError, match="4 values for 2 places"):
        binning.counted(filled, rows.filter("k = 'a'"), bins)


def inside(rings, px, py):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_rasters_with_holes_by_loop(spark):
    rng = random.Random(5)
    shapes = []
    for i in range(12):
        n = rng.randint(3, 8)
        outer = [(rng.choice([rng.uniform(-4, 14), float(rng.randint(-4, 14))]), rng.choice([rng.uniform(-4, 14), rng.randint(-4, 14) + 0.5])) for _ in range(n)]
        shapes.append((i, [outer, [(2.0, 2.0), (5.0, 2.0), (5.0, 6.5), (2.0, 6.0)]][: 1 + i % 2]))
    wkt = [(i, "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")") for i, rings in shapes]
    table = spark.createDataFrame(wkt, "ann long, wkt string").withColumn("rings", spatial.wkt_rings("wkt"))
    got = {(r.ann, r.y, r.x) for r in spatial.rasterize(table, ["ann"]).collect()}
    assert got == {(i, y, x) for i, rings in shapes for y in range(-5, 15) for x in range(-5, 15) if inside(rings, x + 0.5, y + 0.5)}
    share = {(r.ann, r.y, r.x): r.share for r in spatial.coverage(table, ["ann"], 4).collect()}
    for i, rings in shapes:
        for y, x in itertools.product(range(-5, 15), repeat=2):
            n = sum(inside([[(4 * a, 4 * b) for a, b in r] for r in rings], 4 * x + j + 0.5, 4 * y + k + 0.5) for j in range(4) for k in range(4))
            assert share.get((i, y, x), 0) == n / 16


def test_geometries_without_area(spark):
    rows = [(1, "POLYGON EMPTY"), (2, "POLYGON ((0 0, 3 0, 0 0))"), (3, "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))"), (4, None)]
    table = spark.createDataFrame(rows, "ann long, wkt string").withColumn("rings", spatial.wkt_rings("wkt"))
    assert sorted((r.ann, r.y, r.x) for r in spatial.rasterize(table, ["ann"]).collect()) == [(3, 0, 0), (3, 0, 1), (3, 1, 0), (3, 1, 1), (3, 5, 5)]


def test_raster_cost_follows_edges_and_lines(spark):
    """A square of 3,000 x 3,000 pixels is 3,000 runs, whatever its width."""
    big = spark.sql("select 1L as ann, 'POLYGON ((0 0, 3000 0, 3000 3000, 0 3000, 0 0))' as wkt").withColumn("geometry", spatial.wkt_polygon("wkt"))
    runs = spatial.raster_runs(big, ["ann"])
    assert runs.count() == 3000 and runs.agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == 9_000_000


@pytest.mark.parametrize("tile", [4, 256])
def test_numbered_blobs_of_classes(spark, tile):
    rng = random.Random(tile)
    spots = {c: {(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(150)} for c in "ab"}
    got = spatial.class_components(spark.createDataFrame([(c, y, x) for c in "ab" for y, x in spots[c]], "class string, y long, x long"), ["a", "b", "c"], tile)
    got, lift, want = {(r["class"], r.y, r.x): (r.in_class, r.number) for r in got.collect()}, 0, {}
    for c in "ab":
        left, n = set(spots[c]), 0
        for start in sorted(spots[c]):
            if start not in left:
                continue
            n += 1
            todo = [start]
            left.discard(start)
            while todo:
                y, x = todo.pop()
                want[c, y, x] = n, n + lift
                for q in itertools.product((y - 1, y, y + 1), (x - 1, x, x + 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
        lift += n
    assert got == want


def test_peaks_over_noise(spark):
    """A noisy profile with a quiet and a loud half: what stands out of its own half is picked, in either."""
    rng = np.random.default_rng(3)
    mz = np.arange(0.0, 1000.0, 1.0)
    y = np.where(mz < 500, rng.uniform(0, 1, 1000), rng.uniform(0, 20, 1000))
    for m in (100, 333, 610, 900):
        y[m] = 8 if m < 500 else 150
    points = spark.createDataFrame([(1, float(m), float(v)) for m, v in zip(mz, y, strict=True)] + [(2, 5.0, 0.0), (3, 1.0, 4.0)], "spectrum_id long, mz double, intensity double")
    got = {(r.spectrum_id, r.mz) for r in peaks.pick_peaks(points, ratio=8.0, steps=256).collect()}
    assert got == {(1, 100.0), (1, 333.0), (1, 610.0), (1, 900.0)}
    for r in peaks.local_noise(points.filter("spectrum_id = 1"), steps=256).collect():
        own = np.sort(y[(mz >= 50 * (r.window - 1)) & (mz < 50 * (r.window + 2))])
        middle = own[(len(own) - 1) // 2]  # the lower median
        assert middle <= r.noise <= middle + 2 * 150 / 256


def test_isotope_chains(spark):
    z1 = [(100.0 + k * peaks.SPACING, 50.0 - k) for k in range(4)]
    z2 = [(200.0 + k * peaks.SPACING / 2, 80.0 - 5 * k) for k in range(5)]
    shared = [(100.0 + peaks.SPACING / 3 + k * peaks.SPACING / 3, 9.0 - k) for k in range(2)]  # with 100.0 a chain of charge 3, but for the peak that charge 1 takes
    rows = [(s, i, m, v) for s in (1, 2) for i, (m, v) in enumerate(sorted(z1 + z2 + shared + [(300.0, 1.0)]))]
    got = peaks.deisotoped(spark.createDataFrame(rows, "spectrum_id long, idx int, mz double, intensity double")).collect()
    of = {(s, i): m for s, i, m, _ in rows}
    for s in (1, 2):
        chains = {}
        for r in sorted((r for r in got if r.spectrum_id == s), key=lambda r: r.place):
            chains.setdefault((r.charge, r.first), []).append(of[s, r.idx])
        assert sorted((z, c) for (z, _), c in chains.items()) == [(1, [m for m, _ in z1]), (2, [m for m, _ in z2])]


def test_isotope_chains_by_exhaustion():
    """No peak is in two chains, steps fit, later intensities do not rise, and no chain that is left could be as long as one taken before it."""
    rng = np.random.default_rng(11)
    for _ in range(30):
        mz = np.sort(rng.integers(0, 60, 25) / 6 * peaks.SPACING + 100)
        v = rng.uniform(1, 10, 25)
        taken = peaks.isotope_chains(mz, v)
        used = [i for _, c in taken for i in c]
        assert len(used) == len(set(used)) and all(len(c) > 2 for _, c in taken)
        for z, c in taken:
            assert all(abs(mz[b] - mz[a] - peaks.SPACING / z) <= 0.002 + 1e-9 for a, b in itertools.pairwise(c)) and all(v[b] <= v[a] for a, b in itertools.pairwise(c[1:]))
        assert [len(c) for _, c in taken] == sorted((len(c) for _, c in taken), reverse=True)
        free = [i for i in range(25) if i not in used]
        for z in (1, 2, 3):
            for a, b, c in itertools.permutations(free, 3):
                step = peaks.SPACING / z
                assert not (abs(mz[b] - mz[a] - step) < 1e-6 and abs(mz[c] - mz[b] - step) < 1e-6 and v[c] <= v[b] and sum(abs(mz[free] - mz[a] - step) < 0.002) == 1)
