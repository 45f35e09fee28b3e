"""What the findings of rounds 3 and 4 name: pairs that are not shuffled, long spectra, whole masks, memory that does not grow with the table."""

import re

import numpy as np
import pyarrow as pa
import pytest

from spectraline import plans
from spectraline.operators import binning, forests, mixture, models, peaks, selection
from spectraline.plans import signal
from spectraline.sources import proxies, sinks

SF = "/root/testdata/sf0.001"


def peaks_of(spark, rows):
    return spark.createDataFrame(rows, "y long, x long, mz double, intensity double")


def test_shared_windows_give_the_sums_of_every_bin(spark):
    rows_ = peaks_of(spark, [(y, y % 3, m / 4, float(m + y)) for y in range(5) for m in range(40)] + [(0, 0, 2.0, None), (9, 9, 3.0, None), (1, 1, 2.5, 4.0), (1, 1, None, 1.0)])
    bins = spark.createDataFrame([(i, *w) for i, w in enumerate([(1.0, 2.0), (1.0, 2.0), (1.9, 2.1), (3.0, 3.0), (0.0, 100.0), (50.0, 60.0), (None, 1.0)])], "bin_idx long, lo double, hi double")
    rows = lambda df: sorted(((r.y, r.x, r.bin_idx, r.value) for r in df.collect()), key=str)
    got = binning.window_sums(rows_, binning.shared(bins), ["y", "x"], salt=3).selectExpr("y", "x", "explode(bins) as bin_idx", "value")
    assert rows(got) == rows(binning.bin_sum(rows_, bins, ["y", "x"]))


@pytest.mark.parametrize("together", [20_000, 7])
def test_window_sums_of_crowded_strips_and_other_widths(spark, monkeypatch, together):
    monkeypatch.setattr(binning, "TOGETHER", together)
    rng = np.random.default_rng(3)
    rows_ = peaks_of(spark, [(int(i) % 11, int(i) % 3, float(m), float(i)) for i, m in enumerate([*rng.uniform(-40, 40, 300), *rng.uniform(7, 7.1, 100), *np.round(rng.uniform(-9, 9, 60))])])
    lo = [*rng.uniform(-40, 40, 60), *rng.uniform(6.9, 7.1, 30), *range(-9, 9), 5.0, -60.0]
    bins = spark.createDataFrame([(i, float(x), float(x + w)) for i, (x, w) in enumerate(zip(lo, [*[0.5, 0.001, 8.0] * 20, *[0.01, 1e-4, 2.0] * 10, *[0.0, 1.0] * 9, -1.0, 120.0], strict=True))], "bin_idx long, lo double, hi double")
    rows = lambda df: {(r.y, r.x, r.bin_idx): r.value for r in df.collect()}
    got = binning.window_sums(rows_, binning.shared(bins), ["y", "x"]).selectExpr("y", "x", "explode(bins) as bin_idx", "value").cache()
    want = rows(binning.bin_sum(rows_, bins, ["y", "x"]))
    assert got.count() == len(want) > 900 and rows(got) == pytest.approx(want)


def test_window_sums_come_window_by_window(spark):
    """Then the bins of a window follow one another again and again in what is written, which packs them. Large windows are not broadcast."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    windows = binning.shared(proxies.lipids(spark, SF).selectExpr("idx as bin_idx", "mz - width as lo", "mz + width as hi"))
    sums = binning.window_sums(proxies.peaks(spark, SF), windows, ["y", "x"])
    parts = sums.select("lo", "hi").rdd.glom().collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    runs = sum(a != b for part in parts for a, b in zip([None, *part], part, strict=False))
    assert runs == sums.select("lo", "hi").distinct().count() < sum(map(len, parts)) / 2


def test_windows_listed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(binning, "LISTED", 10)
    out = binning.shared(spark.range(100).selectExpr("id as bin_idx", "1.0D as lo", "2.0D as hi")).collect()
    assert len(out) > 5 and sorted(i for r in out for i in r.bins) == list(range(100))


def test_no_window_at_all(spark):
    none = spark.createDataFrame([], "bin_idx long, lo double, hi double")
    assert binning.window_sums(peaks_of(spark, [(0, 0, 1.0, 1.0)]), binning.shared(none), ["y", "x"]).isEmpty()


def test_lipid_images_shuffle_no_pairs(spark):
    plan = plans.QUERIES["J20_lipid_images"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bin_idx" not in plan and "keys=[bin_idx" not in plan


def test_spectra_of_more_peaks_than_the_width(spark, tmp_path):
    n = {1: 1, 2: 13, 3: 14, 4: 26, 5: 27}
    rows = [(k, i, float(i + 1), 100.0 * (i + 1)) for k, m in n.items() for i in range(m)]
    t = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    t.selectExpr("*", "1L as l_suppkey", "'F' as l_linestatus", "'N' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.spectrum_id: (r.len, r.padded, r.total) for r in plans.QUERIES["X1_pad_spectra"](spark, str(tmp_path)).collect()}
    assert got == {k: (m, 13, m * (m + 1) / 2) for k, m in n.items()}


def test_random_mask_has_every_pixel(spark):
    got = plans.QUERIES["P12_random_mask"](spark, SF)
    every = plans.QUERIES["S10_load_mask"](spark, SF).select("y", "x")
    assert got.count() == every.count() and every.join(got, ["y", "x"], "left_anti").isEmpty()
    assert 0.4 < got.filter("on_").count() / got.count() < 0.6


def test_mixture_passes_over_masses_not_peaks(spark):
    points = spark.range(2000).selectExpr("if(id % 3 = 0, 'n', 'p') as head", "double(id % 7) * 10 as mz", "double(id % 4) as intensity")
    table = mixture.masses(points, ["n", "p", "q"])
    own = points.groupBy("mz", "head").sum("intensity").collect()
    want = {(r.mz, r["head"]): r[2] for r in own}
    assert {(r.mz, h): w for r in table.collect() for h, w in zip("npq", r.weights, strict=True) if w is not None} == want
    assert table.count() == 7


def test_mixture_of_copied_peaks_is_the_same(spark):
    rows = [("n", float(10 + i % 9), 1.0 + i % 3) for i in range(60)] + [("p", float(70 + i % 11), 2.0) for i in range(50)] + [("p", None, 1.0)]
    once = spark.createDataFrame(rows, "head string, mz double, intensity double")
    start = mixture.equispaced(spark, 0.0, 100.0, 3, ("n", "none", "p"))
    a, b = (sorted(map(tuple, mixture.fit(x, start, rounds=6).collect())) for x in (once, once.unionByName(once).unionByName(once)))
    assert [r[:2] for r in a] == [r[:2] for r in b] == [(h, i) for h in "np" for i in range(3)]
    assert [x for r in a for x in r[2:]] == pytest.approx([x for r in b for x in r[2:]], rel=1e-9)


@pytest.mark.parametrize("name", ["J1_bin_sum", "J2_bin_integrate", "J4_bin_labelled", "X2_pivot_features"])
def test_tasks_grow_with_the_peaks(spark, monkeypatch, name):
    monkeypatch.setattr(binning, "TASK_GROUPS", 200)
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(spectrum_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and min(dealt) >= 6000 // 200
    if name != "J4_bin_labelled":  # so small a table is sent to the labels
        assert "bin_idx" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", plan))


def test_buckets_grow_with_the_peaks(spark, monkeypatch):
    monkeypatch.setattr(binning, "TASK_GROUPS", 400)
    assert signal.binned_store(spark, SF).buckets == 15


def test_spectra_without_a_chain_are_left_out_together():
    rng = np.random.default_rng(5)
    spectra = [np.sort(rng.uniform(0, 10, rng.integers(0, 9))) for _ in range(300)] + [np.array([1.0, 2.0, 3.0])]
    rows = pa.array([[{"mz": m, "idx": i, "intensity": 5.0 - i / 9} for i, m in enumerate(own.tolist())] for own in spectra])
    left = peaks.hopeful(rows, 3, 0.05)
    found = [i for i, own in enumerate(spectra) if peaks.isotope_chains(own, 5.0 - np.arange(len(own)) / 9, 3, tol=0.05)]
    assert set(found) <= set(left) and 300 in left and len(left) < 150
    assert peaks.hopeful(rows.slice(290), 3, 0.05) == [i - 290 for i in left if i >= 290]


def test_soft_features_are_the_sums_of_soft_bins(spark):
    p = peaks_of(spark, [(y, y % 3, 7.0 * m + y / 9, float(1 + m)) for y in range(6) for m in range(y * 8)] + [(9, 0, None, 1.0), (1, 1, 60.0, None)])
    centres = spark.range(5).selectExpr("id as bin_idx", "id * 50D + 25 as mu", "12D as sigma")
    want = {(r.y, r.x): r.features for r in binning.pivot_features(binning.soft_bin(p, centres, ["y", "x"]), ["y", "x"], 5).collect()}
    got = {(r.y, r.x): r.features for r in binning.soft_features(p, centres, ["y", "x"], 5).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_soft_bin_classifier_shuffles_peaks_once(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(sinks, "stage", lambda df, real=sinks.stage: staged.append(df) or real(df))
    monkeypatch.setattr(binning, "TASK_GROUPS", 200)
    plans.QUERIES["G16_soft_bin_classifier"](spark, SF)
    plan = staged[0]._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(spectrum_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and min(dealt) >= 6000 * 2 // 200 and "pivotfirst" not in plan and "SortMergeJoin" not in plan
    assert "bin_idx" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", plan))


def test_large_batches_are_laid_along_trees_in_parts():
    n = 2 * forests.ROWS + 5
    x = np.arange(3.0 * n)
    columns = {
        "id": pa.array(range(n)), "features": pa.FixedSizeListArray.from_arrays(pa.array(x), 3).cast(pa.list_(pa.float64())), "targets": pa.array([[i % 2] for i in range(n)]),
        "weight": pa.array([1.0] * n), "folds": pa.array([[i % 5] for i in range(n)]), "mark": pa.array(range(n)),
    }
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    parts = list(forests.blocks([batch, batch.slice(0, 0)]))
    assert [b.n for b in parts] == [forests.ROWS, forests.ROWS, 5] and [b.id[0].as_py() for b in parts] == [0, forests.ROWS, 2 * forests.ROWS]
    assert (np.concatenate([b.x for b in parts]).ravel() == x).all() and (np.concatenate([b.folds for b in parts])[:, 0] == np.arange(n) % 5).all()


def test_small_tables_need_no_python_worker(spark):
    rows = [(1, None, [1, 2], "a"), (2, 0.5, [], None)]
    out = models.few(spark, rows, "i int, x double, l array<int>, s string")
    assert [tuple(r) for r in out.collect()] == rows and out.schema.simpleString() == "struct<i:int,x:double,l:array<int>,s:string>"
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    assert models.few(spark, [], "i int, x double").count() == 0


def test_vectors_are_read_without_dealing_out_their_values(spark):
    got = proxies.vectors(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
    rows = lambda df: sorted(df.select("id", "features", "target", "grp", "region").collect())
    assert rows(got) == rows(models.wide(proxies.dense(spark, SF)))


@pytest.fixture(scope="module")
def spread(spark):
    """Spectra of five peaks with folds: what class 1 has more of lies at 61."""
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.uniform(0, 100)), float(rng.integers(1, 9))) for i in range(300) for _ in range(5)] + [(i, float(rng.uniform(60, 62)), 6.0) for i in range(0, 300, 2)]
    p = spark.createDataFrame(rows, "id long, mz double, intensity double").cache()
    t = spark.createDataFrame([(i, 1 - i % 2, i % 4, i % 3) for i in range(300)], "id long, target int, grp int, fold int").cache()
    return p, t


def test_extra_trees_are_the_same_from_bits_and_compact_rows(spark, spread, monkeypatch):
    p, t = spread
    bins = [(i * 12.5, i * 12.5 + 12.5) for i in range(8)]
    rows = forests.table(models.binned(p, t.withColumn("region", t.grp), bins, vector=False), folds=("fold",)).cache()
    growths = [forests.Growth(trees=6, depth=5, out=((0, f),), test=((0, f),), use=use, seed=f) for f in range(3) for use in (None, (1, 4, 5, 6))]
    grown = {}
    for name, few, table in (("ranks", 0, rows), ("bits", 64, rows), ("compact", 64, forests.compact(rows)), ("compact ranks", 0, forests.compact(rows)), ("extremes", 64, forests.compact(rows))):
        monkeypatch.setattr(forests, "FEW", few)
        monkeypatch.setattr(forests, "EXTREMES", 3 if name == "extremes" else 128)
        grown[name] = forests.grow(table.cache(), growths)
    assert sum(len(tree.feature) for f in grown["ranks"] for tree in f) > 300
    assert all(x == grown["ranks"] for x in grown.values())
    one = {r.growth: r.accuracy for r in forests.settings_scores(rows, growths, grown["ranks"]).collect()}
    own = forests.tested(forests.compact(rows), growths, grown["ranks"]).toPandas()
    assert own.groupby("growth")["hit"].mean().to_dict() == pytest.approx(one) and own.groupby("growth").size().tolist() == [100] * 6
    score = forests.predicted(rows, grown["ranks"]).join(t, "id").filter("growth div 2 = fold").toPandas()
    assert sorted(zip(score.growth, score.target, score.score)) == sorted(zip(own.growth, own.target, own.score))


def test_steps_of_progressive_binning_share_tables_and_growths(spread, monkeypatch):
    p, t = spread
    t = t.withColumn("region", t.grp)
    tables, grown = [], []
    monkeypatch.setattr(models, "binned", lambda *a, real=models.binned, **k: tables.append(a) or real(*a, **k))
    monkeypatch.setattr(forests, "grow", lambda *a, real=forests.grow: grown.append(a) or real(*a))
    start = [(i * 25.0, i * 25.0 + 25) for i in range(4)]
    steps, scores = selection.progressive_binning(p, t, start, 3.2, 3)
    assert [len(x) for x in steps] == [3] * 3 and sorted(x[:2] for x in scores) == [(f, k) for f in range(3) for k in range(3)]
    assert len(tables) == 1 and len(grown) == 4
    monkeypatch.setattr(selection, "COLUMNS", 1)
    again = selection.progressive_binning(p, t, start, 3.2, 3)
    assert len(tables) == 4 and again[0] == steps and sorted(again[1]) == sorted(scores)
    assert all(len(x) == 4 and sum(k for *_, k in x) == 2 for own in steps for x in own)
