"""Rules on hand-made cases and against plain loops, errors, invariants of the learnt queries, and plans."""

import bisect
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spectraline import plans
from spectraline.functions import stats
from spectraline.operators import binning, mixture, models, spatial
from spectraline.sources import proxies, sinks, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def peaks(spark):
    return [r.asDict() for r in proxies.peaks(spark, SF).collect()]


@pytest.fixture(scope="module")
def table(spark):
    """A feature table of 300 rows in which feature 2 tells the target, feature 5 does so weakly, the others don't."""
    rng, rows = np.random.default_rng(1), []
    for i in range(300):
        y = i % 2
        x = rng.normal(size=8)
        x[2] += 3 * y
        x[5] += 0.8 * y
        rows.append((i, x.tolist(), y, i % 12, i % 3))
    return spark.createDataFrame(rows, "id long, features array<double>, target int, grp int, region int").withColumn("v", array_to_vector("features")).cache()


def test_leading_share_keeps_rows_within_the_share(spark):
    imp = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.2), (3, 0.1)], "channel int, v double")
    assert sorted(r.channel for r in stats.leading_share(imp, 0.8).collect()) == [0, 1]
    assert sorted(r.channel for r in stats.leading_share(imp, 1.0).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_upper_half_rounds_up(spark, n):
    imp = spark.createDataFrame([(i, float(i)) for i in range(n)], "channel int, v double")
    assert sorted(r.channel for r in stats.upper_half(imp).collect()) == list(range(n // 2, n))


def test_nearest_to_one(spark, peaks):
    best = {p["spectrum_id"]: None for p in peaks}
    for p in peaks:
        if 300 <= p["mz"] <= 400 and (best[p["spectrum_id"]] is None or abs(p["intensity"] - 1) < abs(best[p["spectrum_id"]] - 1)):
            best[p["spectrum_id"]] = p["intensity"]
    assert {r.spectrum_id: r.nearest for r in plans.QUERIES["J18_nearest_to_one"](spark, SF).collect()} == best


def test_bins_by_loops(spark, peaks):
    """Sums and areas over bins of some spectra, one peak and one bin at a time."""
    few = [p for p in peaks if p["spectrum_id"] < 60]
    bins = [(i, 40.0 * i, 40.0 * i + (40 if i % 3 else 25)) for i in range(26)]
    rows = spark.createDataFrame([(p["spectrum_id"], p["idx"], p["mz"], p["intensity"]) for p in few], "spectrum_id long, idx int, mz double, intensity double")
    table = spark.createDataFrame(bins, "bin_idx long, lo double, hi double")
    total, area, spectra = Counter(), defaultdict(float), defaultdict(list)
    for p in few:
        spectra[p["spectrum_id"]].append((p["mz"], p["intensity"]))
        for b, lo, hi in bins:
            if lo <= p["mz"] <= hi:
                total[p["spectrum_id"], b] += p["intensity"]
    for k, points in spectra.items():
        points.sort()
        for b, lo, hi in bins:
            for (m0, i0), (m1, i1) in zip(points, points[1:], strict=False):
                a, z = max(m0, lo), min(m1, hi)
                if z > a:
                    at = lambda x, m0=m0, i0=i0, m1=m1, i1=i1: i0 + (i1 - i0) * (x - m0) / (m1 - m0)
                    area[k, b] += (at(a) + at(z)) / 2 * (z - a)
    assert {(r.spectrum_id, r.bin_idx): r.value for r in binning.bin_sum(rows, table, ["spectrum_id"]).collect()} == pytest.approx(dict(total))
    assert {(r.spectrum_id, r.bin_idx): r.value for r in binning.bin_integrate(rows, table, ["spectrum_id"], gap="clip").collect()} == pytest.approx(dict(area))


def test_merge_above_by_loop(spark):
    ok = [True, True, False, True, False, False, True, True, True]
    flags = spark.createDataFrame([(i, 1.0 * i, i + 1.0, x) for i, x in enumerate(ok)], "bin_idx int, lo double, hi double, ok boolean")
    want, start = [], None
    for i, x in enumerate([*ok, False]):
        if x and start is None:
            start = i
        elif not x and start is not None:
            want.append((float(start), float(i)))
            start = None
    assert sorted((r.lo, r.hi) for r in binning.merge_above(flags).collect()) == want


def test_max_pool_by_loop(spark):
    got = {(r.vec_id, r.channel): r.value for r in plans.QUERIES["W3_max_pool"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(20).collect():
        x = [0.0, *map(float, r.embedding), 0.0]
        assert [got[r.vec_id, i] for i in range(64)] == [max(x[i : i + 3]) for i in range(64)]


def test_monotone_stops(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.1, 0.3, 0.2, None, 0.9])] + [(1, 0, 0.5), (1, 1, 0.4)], "g int, k int, v double")
    assert [r.v for r in stats.monotone(rows, ["g"], "k", "v").orderBy("g", "k").collect()] == [0.1, 0.3, 0.3, None, None, 0.5, 0.5]


def test_isotope_followers(spark):
    rows = [(1, 0, 100.0, 9.0), (1, 1, 101.0, 5.0), (1, 2, 102.0, 3.0), (1, 3, 103.0, 1.0), (1, 4, 200.0, 9.0), (1, 5, 201.0, 5.0), (1, 6, 300.0, 1.0), (1, 7, 301.0, 2.0), (1, 8, 302.0, 3.0), (2, 0, 101.0, 1.0)]
    got = binning.isotope_followers(spark.createDataFrame(rows, "spectrum_id long, idx int, mz double, intensity double"), 1.0, 0.01)
    assert sorted((r.spectrum_id, r.idx) for r in got.collect()) == [(1, 1), (1, 2), (1, 3)]  # two members only, and rising intensities, are no chain


@pytest.mark.parametrize("n", [1, 2, 3, 7, 500])
def test_fticr_bins_reach_the_end(spark, n):
    lo, hi = 8.0, 1051.0
    f = spatial.fticr_factor(lo, hi, n)
    edges = [lo]
    for _ in range(n):
        edges.append(edges[-1] + f * edges[-1] * edges[-1])
    assert hi <= edges[-1] <= hi * (1 + 1e-6)
    mz = [7.9, 8.0, 8.1, 100.0, 700.0, 1050.9, 1051.0, 1060.0]
    out = spatial.fticr_index(spark.createDataFrame([(m,) for m in mz], "mz double"), lo, hi, n).collect()
    assert {r.mz: r.bin_idx for r in out} == {m: bisect.bisect_right(edges, m) - 1 for m in mz if edges[0] <= m < edges[-1]}


def test_annotation_offsets(spark):
    parts = [spark.createDataFrame([(r, a) for a in range(1, k + 1)], "region int, ann_idx long") for r, k in enumerate((12, 3, 5))]
    bins = spark.createDataFrame([(0, 1.0, 2.0)], "bin_idx int, lo double, hi double")
    out = spatial.merge_regions(parts, [bins] * 3).collect()
    assert sorted(r.ann_idx for r in out) == list(range(1, 21)) and {r.ann_idx for r in out if r.region == 2} == set(range(16, 21))
    with pytest.raises(ValueError):
        spatial.merge_regions(parts[:2], [bins, bins.withColumn("hi", F.lit(3.0))])


def test_errors_in_place_of_drops(spark):
    pixels = spark.createDataFrame([("a", 1, 1), ("b", 5, 9)], "class string, y long, x long")
    with pytest.raises(ValueError):
        spatial.background(pixels.select("y", "x"), pixels, "a")
    with pytest.raises(ValueError):
        spatial.registered(pixels, (0, 0), 1.0, (6, 9))
    with pytest.raises(ValueError):
        spatial.registered(pixels, (2, 0), 1.0, (6, 10))
    assert spatial.registered(pixels, (0, 0), 1.0, (6, 10)).count() == 2
    ann = spark.createDataFrame([(1, "u"), (2, "w")], "ann_id int, term string")
    with pytest.raises(ValueError):
        spatial.first_class(ann, spark.createDataFrame([("u", 1)], "term string, class int"))
    sets = spark.createDataFrame([("u", 3), ("u", 2), ("w", 3)], "term string, class int")
    assert {r.term: r["class"] for r in spatial.first_class(ann, sets).collect()} == {"u": 2, "w": 3}
    with pytest.raises(ValueError):
        spatial.onehot(pixels.withColumnRenamed("class", "term"), ann, ["u"])
    p = spark.createDataFrame([("a", 150.0, 30.0), ("b", 600.0, 30.0)], "flag string, mz double, intensity double")
    with pytest.raises(ValueError):
        binning.mass_filter(p, 100, 500, 20, "flag")
    assert binning.mass_filter(p, 100, 700, 20, "flag").count() == 2


def test_ranks(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 2)) for i in rng.sample(range(-5000, 100_000), 700)]
    df = spark.createDataFrame(rows, "id long, target int")
    assert {r.id: r.k for r in models.id_rank(df).collect()} == {i: k for k, i in enumerate(sorted(i for i, _ in rows), 1)}
    import hashlib

    digest = lambda i: hashlib.md5(f"{i}|7".encode()).hexdigest()
    want = {}
    for t in range(3):
        want |= {i: k for k, i in enumerate(sorted((i for i, y in rows if y == t), key=digest), 1)}
    assert {r.id: r.k for r in models.dealt_rank(df, seed=7, by=("target",)).collect()} == want
    dealt = models.shuffled_labels(df, 3).collect()
    assert Counter(r.target for r in dealt) == Counter(y for _, y in rows) and {r.id for r in dealt} == {i for i, _ in rows}
    assert models.dealt_rank(df.limit(0)).count() == 0 == models.id_rank(df.limit(0)).count()


@pytest.mark.parametrize("name", ["M1_train_test_split", "M2_random_split", "M3_stratified_kfold", "M7_shuffle_labels"])
def test_no_task_ranks_all_rows(spark, name):
    """What reaches a single partition is aggregated first: the sizes of buckets or of classes."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString().split("\n")
    for i, line in enumerate(plan):
        if "Window" in line and "row_number" in line:
            assert "_bucket" in line, line
        elif "Window" in line:
            assert "Aggregate" in "".join(plan[i + 1 : i + 4]), plan[i : i + 4]


def test_quantiles(spark):
    rng = np.random.default_rng(6)
    for x in (rng.normal(size=1000), rng.integers(0, 5, 300).astype(float), np.array([4.0])):
        got = stats.quantiles(spark.createDataFrame([(float(v),) for v in x], "e double"), "e", [0.0, 0.1, 0.5, 0.77, 1.0], 16)
        assert got == pytest.approx(np.quantile(x, [0.0, 0.1, 0.5, 0.77, 1.0]).tolist())


def test_normal_tail(spark):
    z = [0.0, 0.5, -1.0, 1.96, 5.0, 12.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(stats.normal_two_sided(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in z], rel=1e-6)


def test_weighted_auc_by_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 6)), rng.choice([0.5, 1.0, 3.0])) for _ in range(80)]
    auc = stats.roc_auc(spark.createDataFrame(rows, "target int, score double, w double").withColumn("g", F.lit(1)), "g", weight="w").first().auc
    pairs = [(a * b, (s > t) + 0.5 * (s == t)) for y, s, a in rows if y for z, t, b in rows if not z]
    assert auc == pytest.approx(sum(w * x for w, x in pairs) / sum(w for w, _ in pairs))


def test_blobs_by_flood_fill(spark):
    rng = random.Random(8)
    spots = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(600)}
    want, left = {}, set(spots)
    while left:
        todo, blob = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            blob.add((y, x))
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        name = min(y * (1 << 32) + x for y, x in blob)
        want |= dict.fromkeys(blob, name)
    for tile in (4, 256):
        out = spatial.components(spark.createDataFrame(sorted(spots), "y long, x long"), tile)
        assert {(r.y, r.x): r.blob for r in out.collect()} == want


def test_template_matrix_step_by_step():
    for turns in range(4):
        for lr, ud in ((False, False), (True, False), (False, True)):
            m = spatial.template_matrix((5, 7), 2.0, (60, 40), turns, lr, ud, (4, 3))
            for px, py in ((5, 7), (65, 47), (20, 30)):
                x, y = (px - 5) / 2 - 15, (py - 7) / 2 - 10
                for _ in range(turns):
                    x, y = -y, x
                x, y = (-x if lr else x), (-y if ud else y)
                half = (15, 10) if turns % 2 == 0 else (10, 15)
                want = (x + 4 + half[0], y + 3 + half[1])
                assert (m[0][0] * px + m[0][1] * py + m[0][2], m[1][0] * px + m[1][1] * py + m[1][2]) == pytest.approx(want)
    sy, sx, m = spatial.box_registration((0, 10, 5, 25), (2, 22, 1, 31))
    assert (sy, sx) == (2.0, 1.5) and m == ((1.5, 0.0, 1 - 7.5), (0.0, 1.5, 2.0))


def test_run_logs(spark, tmp_path):
    line = "2022-05-01 10:00:00,123 [root] [INFO] : "
    for name, occ, scores in (("ls_p_vs_n_norm_tic_gcv.log", 0.6, "0.7 0.8  0.9"), ("ls_p_vs_n_no_norm_cv.log", 0.95, "0.7 0.8"), ("notes.txt", 0.1, "0.1")):
        (tmp_path / name).write_text(f"{line}max rel. occurrence = {occ}\n{line}scores: [{scores}]\n{line}feature importances:\n{line}  3 ( 700.1-700.2 ) :  0.25\n{line}  1 ( a b ) : 0.125\n")
    logs = text.scan_logs(spark, str(tmp_path)).cache()
    got = {(r.problem, r.normalization, r.grouped): (r.score, r.max_occ) for r in text.run_scores(logs).collect()}
    assert got == {("ls+_vs-", "tic", True): (pytest.approx(0.8), 0.6), ("ls+_vs-", "none", False): (pytest.approx(0.75), 0.95)}
    assert {(r.id, r.name, r.importance) for r in text.run_importances(logs).collect()} == {(3, "700.1-700.2", 0.25), (1, "a b", 0.125)}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "lipids.csv").write_text("mz|width|name\n700.5|0.01|one\n701.5|0.02|two\n")
    assert [(r.mz, r.width, r.name) for r in text.scan_lipids(spark, str(tmp_path / "lipids.csv")).collect()] == [(700.5, 0.01, "one"), (701.5, 0.02, "two")]
    (tmp_path / "c.csv").write_text("# head\n1;2.5;a#b\n#2;3.5;c\n3;4.5;\n")
    assert [tuple(r) for r in text.scan_commented(spark, str(tmp_path / "c.csv"), "idx long, mz double, name string", ";").collect()] == [(1, 2.5, "a#b"), (3, 4.5, "")]


def test_mask_image(spark, tmp_path):
    image = np.array([[0, 100, 200], [90, 101, 10]], np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in image)
    (tmp_path / "m.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    on = {(r.y, r.x): r.on_ for r in text.load_mask(spark, str(tmp_path)).collect()}
    assert on == {(y, x): bool(image[y, x] > 100) for y in range(2) for x in range(3)}


def test_sinks_need_a_shared_folder_on_clusters():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        sinks.shared_root(Session())


def test_mixture_by_numpy(spark):
    comps = mixture.equispaced(spark, 0.0, 100.0, 70)
    mz = np.linspace(-3, 104, 40)
    got = {(r.mz, r["head"]): r.p for r in mixture.mixture_prob(spark.createDataFrame([(float(m),) for m in mz], "mz double"), comps).collect()}
    mu, sd = np.arange(70) * 100 / 69, 100 / 140
    want = [float((np.exp(-0.5 * ((m - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)) / 70).sum()) for m in mz]
    assert all(got[float(m), h] == pytest.approx(w, rel=1e-9) for m, w in zip(mz, want, strict=True) for h in "np")
    plan = mixture.mixture_prob(spark.createDataFrame([(1.0,)], "mz double"), comps)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "lambda" not in plan


def test_em_finds_two_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("n", float(x), 1.0) for x in np.concatenate([rng.normal(20, 2, 300), rng.normal(80, 4, 100)])]
    out = mixture.fit(spark.createDataFrame(rows, "head string, mz double, intensity double").cache(), mixture.equispaced(spark, 0.0, 100.0, 2, ("n",)), rounds=50)
    a, b = sorted((r.mu, r.pi) for r in out.collect())
    assert a == pytest.approx((20, 0.75), rel=0.05) and b == pytest.approx((80, 0.25), rel=0.05)


def test_learnt_invariants(spark, table):
    groups = defaultdict(set)
    for r in models.group_folds(table, 3).collect():
        groups[r.grp].add(r.fold)
    assert all(len(f) == 1 for f in groups.values()) and len(set.union(*groups.values())) == 3
    folds = models.stratified_folds(table, 3)
    assert all(r["count"] == 50 for r in folds.groupBy("fold", "target").count().collect())
    auc = lambda t: models.cv_scores(models.stratified_folds(t, 3).cache()).agg(F.avg("auc")).first()[0]
    assert auc(table) > 0.8 and abs(auc(models.shuffled_labels(table, 1)) - 0.5) < 0.15


@pytest.mark.parametrize("most", [10, 1 << 20])
def test_groups_stay_whole_and_even(spark, monkeypatch, most):
    """Placed one by one or dealt in the cluster, groups are in one fold, and folds are even in rows and classes."""
    monkeypatch.setattr(models, "MOST_GROUPS", most)
    rng = random.Random(2)
    rows = [(i, g, int(rng.random() < 0.4)) for i, g in enumerate(g for g in range(300) for _ in range(1 + g % 3))]
    out = models.group_folds(spark.createDataFrame(rows, "id long, grp long, target int"), 4).collect()
    folds = defaultdict(set)
    for r in out:
        folds[r.grp].add(r.fold)
    assert len(out) == len(rows) and all(len(f) == 1 for f in folds.values())
    for y in (0, 1):
        n = Counter(r.fold for r in out if r.target == y)
        assert len(n) == 4 and max(n.values()) - min(n.values()) <= 25


def test_lipids_are_numbered_by_lines(spark, tmp_path):
    path = tmp_path / "lipids.csv"
    path.write_text("m/z;Interval Width (+/- Da);Name\n" + "".join(f"{500 + i}.5;0.{i % 9 + 1};lipid {i}\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        lipids = text.scan_lipids(spark, str(path))
        got = sorted((r.idx, r.name) for r in lipids.collect())
        assert got == [(i, f"lipid {i}") for i in range(2000)] and spark.read.text(str(path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_forward_selection_by_loop(spark, table):
    folds = models.stratified_folds(table, 3).cache()
    got = [(r.channel, r.score) for r in models.forward_selection(folds).orderBy("step").collect()]
    rows = [(np.array(r.features), r.target, r.fold) for r in folds.collect()]

    def score(chosen):
        out = []
        for k in range(3):
            train, test = [r for r in rows if r[2] != k], [r for r in rows if r[2] == k]
            of = {y: np.array([x[chosen] for x, t, _ in train if t == y]) for y in (0, 1)}
            log = {y: lambda x, a=a: math.log(len(a)) + float((-0.5 * (np.log(a.var(0)) + (x - a.mean(0)) ** 2 / a.var(0))).sum()) for y, a in of.items()}
            out.append(np.mean([(log[1](x[chosen]) > log[0](x[chosen])) == (y == 1) for x, y, _ in test]))
        return float(np.mean(out))

    want = []
    while True:
        tries = {c: score([*[w for w, _ in want], c]) for c in range(8) if c not in [w for w, _ in want]}
        best = min(tries, key=lambda c: (-tries[c], c))
        if tries[best] < (want[-1][1] if want else 0) + 0.01:
            break
        want.append((best, tries[best]))
    assert [c for c, _ in got] == [c for c, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])


def test_bonferroni_is_not_clipped(spark):
    out = plans.QUERIES["F1_welch_p"](spark, SF).collect()
    assert all(r.bonferroni == pytest.approx(64 * r.p) for r in out) and any(r.bonferroni > 1 for r in out)
