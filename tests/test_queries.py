"""Every query with SQL against DuckDB on the smallest tables; edge cases of joins and geometry by brute force."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from spectraline import plans
from spectraline.functions import stats
from spectraline.operators import binning, spatial

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.3f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(plans.ORACLE[name])
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted(tuple(norm(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(norm(v) for v in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall())
    assert a == b


def test_shared_edge_counts_twice(spark):
    peaks = spark.createDataFrame([(1, m, 1.0) for m in (0.0, 10.0, 20.0)], "spectrum_id long, mz double, intensity double")
    bins = spark.createDataFrame([(0, 0.0, 10.0), (1, 10.0, 20.0)], "bin_idx long, lo double, hi double")
    assert {r.bin_idx: r.value for r in binning.bin_sum(peaks, bins, ["spectrum_id"]).collect()} == {0: 2.0, 1: 2.0}


def test_gap_leaks_into_next_bin(spark):
    peaks = spark.createDataFrame([(1, i, float(i), float(i)) for i in range(41)], "spectrum_id long, idx int, mz double, intensity double")
    bins = spark.createDataFrame([(0, 0.0, 10.0), (1, 20.0, 30.0)], "bin_idx long, lo double, hi double")
    leak = {r.bin_idx: r.value for r in binning.bin_integrate(peaks, bins, ["spectrum_id"]).collect()}
    clip = {r.bin_idx: r.value for r in binning.bin_integrate(peaks, bins, ["spectrum_id"], gap="clip").collect()}
    assert leak == pytest.approx({0: 50.0, 1: 400.0}) and clip == pytest.approx({0: 50.0, 1: 250.0})


def test_no_nested_loop(spark):
    plan = plans.QUERIES["J1_bin_sum"](spark, SF)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_orientation(spark):
    import numpy as np

    pattern = np.arange(35).reshape(5, 7)
    for k in range(-5, 6):
        turned = np.rot90(pattern, k)
        h, w = turned.shape
        cells = spark.createDataFrame([(y, x) for y in range(h) for x in range(w)], "y int, x int")
        oy, ox = spatial.orient(F.col("y"), F.col("x"), F.lit(k), F.lit(False), F.lit(False), F.lit(h), F.lit(w))
        assert all(pattern[r.oy, r.ox] == turned[r.y, r.x] for r in cells.select("y", "x", oy.alias("oy"), ox.alias("ox")).collect())


def test_blobs_touch_by_corners(spark):
    out = spatial.components(spark.createDataFrame([(0, 0), (1, 1), (5, 5)], "y long, x long")).collect()
    assert len({r.blob for r in out}) == 2 and len(out) == 3


def test_bh(spark):
    p = spark.createDataFrame([(i, 0.01 * (i + 1)) for i in range(5)], "channel int, p double")
    assert [round(r.adjusted, 6) for r in stats.bh_adjust(p).collect()] == [0.05] * 5


def test_t_tail():
    assert stats.incomplete_beta(5.0, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-5)


def test_every_query_has_rows(spark):
    for name in ("M4_stratified_group_kfold", "F3_u_test_fdr", "J9_label_components", "T3_fticr_bin_index", "M15_mean_roc"):
        assert not plans.QUERIES[name](spark, SF).isEmpty(), name
