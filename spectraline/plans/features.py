"""Queries over feature tables: statistics, splits, models and mixtures."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from spectraline.functions import stats
from spectraline.operators import binning as B
from spectraline.operators import forests as T
from spectraline.operators import mixture as X
from spectraline.operators import models as M
from spectraline.operators import selection as S
from spectraline.plans.registry import op
from spectraline.sources import proxies as P
from spectraline.sources import sinks

C = F.col


def rows(s, d):
    return M.wide(P.dense(s, d))


def long(s, d):
    return P.dense(s, d).select("vec_id", "channel", "target", F.round("value", 2).alias("value"))


DL = ", dl AS (SELECT vec_id, channel, target, round(value, 2) AS value FROM dn)\n"


@op("F1_welch_t", DL + """, g AS (SELECT channel, avg(value) FILTER (target = 0) AS m0, avg(value) FILTER (target = 1) AS m1, var_samp(value) FILTER (target = 0) / count(*) FILTER (target = 0) AS e0, var_samp(value) FILTER (target = 1) / count(*) FILTER (target = 1) AS e1,
count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM dl GROUP BY 1) SELECT channel, round((m0 - m1) / sqrt(e0 + e1), 4) AS t, round((e0 + e1) ** 2 / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1)), 3) AS dof FROM g""")
def f1(s, d):
    return stats.welch_t(long(s, d)).select("channel", F.round("t", 4).alias("t"), F.round("dof", 3).alias("dof"))


@op("F1_welch_p")
def f1p(s, d):
    """Two-sided p of Welch's t, as it is and times the number of features (Bonferroni, not clipped)."""
    x = long(s, d)
    both = (
        stats.welch_t(x)
        .select("channel", "t", "dof", "p")
        .join(stats.welch_t(x, bonferroni=True).select("channel", C("p").alias("bonferroni")), "channel")
    )
    return both


MW = DL + """, k AS (SELECT channel, target, rank() OVER (PARTITION BY channel ORDER BY value) + (count(*) OVER (PARTITION BY channel, value) - 1) / 2 AS r FROM dl),
tie AS (SELECT channel, sum(t * t * t - t) AS tie FROM (SELECT channel, value, count(*) AS t FROM dl GROUP BY ALL) GROUP BY 1),
u AS (SELECT channel, sum(r) FILTER (target = 0) - count(*) FILTER (target = 0) * (count(*) FILTER (target = 0) + 1) / 2 AS u, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM k GROUP BY 1)
"""


@op(
    "F2_mann_whitney",
    MW + "SELECT channel, u, round((greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - tie / ((n0 + n1) * (n0 + n1 - 1)))), 4) AS z FROM u JOIN tie USING (channel)",
)
def f2(s, d):
    """Values other than 0 are ranked; zeros count as the rest of the rows of a class."""
    rows = P.table(s, d, "embeddings").groupBy((C("label") % 2).alias("target")).agg(F.count("*").alias("n"))
    return stats.mann_whitney(long(s, d).filter("value <> 0"), totals=rows).select("channel", "u", F.round("z", 4).alias("z"))


@op("F3_u_test_fdr", MW + f""", zz AS (SELECT channel, (greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - tie / ((n0 + n1) * (n0 + n1 - 1)))) AS z FROM u JOIN tie USING (channel)),
pp AS (SELECT channel, least(1.0, {stats.normal_two_sided_sql('z')}) AS p FROM zz), rk AS (SELECT *, row_number() OVER (ORDER BY p, channel) AS r, count(*) OVER () AS m FROM pp),
ad AS (SELECT channel, r, p, least(1.0, min(p * m / r) OVER (ORDER BY r DESC)) AS a FROM rk) SELECT channel, channel + 0.5::DOUBLE AS centre, round(p, 6) AS p, round(a, 6) AS adjusted, a < 0.05 AS by_fdr, r <= 8 AS by_count FROM ad""")
def f3(s, d):
    """Features by U test, picked by false discovery rate or by count."""
    p = stats.bh_adjust(stats.mann_whitney(long(s, d)).select("channel", "p"))
    return p.select(
        "channel", (C("channel") + 0.5).alias("centre"), F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"),
        (C("adjusted") < 0.05).alias("by_fdr"), (C("rank") <= 8).alias("by_count"),
    )


@op("F4_mdi_importance")
def f4(s, d):
    """Impurity importances of extra-trees."""
    return S.importances(rows(s, d))


@op("F5_mda_importance")
def f5(s, d):
    return S.permutation_importance(rows(s, d))


@op("F6_mprobes_fwer")
def f6(s, d):
    return S.mprobes(rows(s, d))


PERMUTED = """, v0 AS (SELECT DISTINCT vec_id, target FROM dn), v1 AS (SELECT vec_id, target, CAST('0x' || substr(md5(vec_id || '|block'), 1, 8) AS BIGINT) % greatest(1, (count(*) OVER () + 4095) // 4096) AS block FROM v0),
ow AS (SELECT vec_id, target, block, row_number() OVER (PARTITION BY block ORDER BY vec_id) AS k FROM v1),
ot AS (SELECT b, block, target, row_number() OVER (PARTITION BY b, block ORDER BY md5(vec_id || '|' || b), vec_id) AS k FROM v1, range(1, 101) t(b)),
lb AS (SELECT vec_id, 0 AS b, target FROM ow UNION ALL SELECT ow.vec_id, ot.b, ot.target FROM ow JOIN ot USING (block, k)),
sc AS (SELECT channel, b, round(abs(avg(value) FILTER (lb.target = 1) - avg(value) FILTER (lb.target = 0)), 9) AS v FROM dn JOIN lb USING (vec_id) GROUP BY ALL)
"""


@op(
    "F7_perm_fdr",
    PERMUTED + ", q AS (SELECT a.channel, a.v, row_number() OVER (ORDER BY a.v DESC, a.channel) AS r, (SELECT count(*) FROM sc b WHERE b.b > 0 AND b.v >= a.v) AS above FROM sc a WHERE b = 0) SELECT channel, round(v, 6) AS score, round(max(least(1.0, above / 100 / r)) OVER (ORDER BY r), 4) AS fdr FROM q",
)
def f7(s, d):
    """100 permutations of the targets, all features and permutations scored in one pass."""
    out = S.permutation_fdr(S.permuted_scores(rows(s, d), 100), 100)
    return out.select("channel", F.round("score", 6).alias("score"), F.round("fdr", 4).alias("fdr"))


@op("F8_cer_efdr")
def f8(s, d):
    """Conditional error rate and eFDR of all features, up to where both rates went beyond one half."""
    return S.conditional_errors(rows(s, d), permutations=5)


@op("F9_forward_selection")
def f9(s, d):
    return M.forward_selection(M.stratified_folds(rows(s, d), 5))


@op("F9_selection_with_trees")
def f9_trees(s, d):
    """Forward selection whose candidates are scored by extra-trees on held-out folds."""
    return S.forward_selection(M.stratified_folds(rows(s, d), 3))


def labelled(s, d):
    """Peaks and labels of spectra of two classes, for feature tables."""
    t = (
        P.labels(s, d)
        .filter(C("target").isin("F", "O"))
        .select(C("spectrum_id").alias("id"), (C("target") == "F").cast("int").alias("target"), C("region").alias("grp"), "region")
    )
    return P.peaks(s, d).select(C("spectrum_id").alias("id"), "mz", "intensity"), t


START = [(i * 131.25, (i + 1) * 131.25) for i in range(8)]
LIMIT = 20.0


@op("F10_progressive_binning")
def f10(s, d):
    """Bins halved where the more important half is, until they are narrow: (step, bin_idx, lo, hi, importance, kept)."""
    steps, _ = S.progressive_binning(*labelled(s, d), START, LIMIT)
    return s.createDataFrame(
        [(k, i, *b) for k, step in enumerate(steps[0]) for i, b in enumerate(step)],
        "step int, bin_idx int, lo double, hi double, importance double, kept boolean",
    )


NOISE = "CAST('0x' || substr(md5(vec_id || '|' || channel || '|{}'), 1, 8) AS BIGINT)"


@op(
    "F12_add_input_noise",
    f"SELECT vec_id, channel, round(value + 0.1 * avg(abs(value)) OVER (PARTITION BY vec_id) * sqrt(-2 * ln(({NOISE.format('r')} + 1) / 4294967296.0::DOUBLE)) * cos(2 * pi() * {NOISE.format('a')} / 4294967296.0::DOUBLE), 6) AS value FROM dn",
)
def f12(s, d):
    """Normal noise by Box and Muller from md5 numbers of the cell, a tenth of the row's mean as its deviation; the same under any partitioning."""
    x, key = P.dense(s, d), F.concat_ws("|", C("vec_id").cast("string"), C("channel").cast("string"))
    number = lambda name: F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 8), 16, 10).cast("double")
    normal = F.sqrt(-2 * F.log((number("r") + 1) / 4294967296)) * F.cos(2 * math.pi * number("a") / 4294967296)
    mean = F.avg(F.abs("value")).over(Window.partitionBy("vec_id"))
    return x.select("vec_id", "channel", F.round(C("value") + 0.1 * mean * normal, 6).alias("value"))


@op("F13_add_features", """SELECT vec_id, channel, value FROM dn UNION ALL SELECT vec_id, channel + 64 AS channel, 2 * value AS value FROM dn WHERE channel < 4 UNION ALL SELECT vec_id, 68 AS channel, round(sum(value * channel), 4) AS value FROM dn WHERE channel < 4 GROUP BY 1
UNION ALL SELECT vec_id, 69 AS channel, round(CAST('0x' || substr(md5(vec_id || '|noise'), 1, 8) AS BIGINT) / 4294967296, 6) AS value FROM dn WHERE channel = 0 UNION ALL SELECT vec_id, 70 AS channel, CASE WHEN substr(md5(vec_id || '|drop'), 1, 1) < '4' THEN 0 ELSE value END AS value FROM dn WHERE channel = 0""")
def f13(s, d):
    """Redundant copies, a linear combination, seeded noise, and a copy that is dropped to 0 in a quarter of the rows."""
    x = P.dense(s, d).select("vec_id", "channel", "value")
    few = x.filter("channel < 4")
    seeded = lambda name: F.md5(F.concat(C("vec_id").cast("string"), F.lit(f"|{name}")))
    first = x.filter("channel = 0")
    mixed = (
        few.groupBy("vec_id")
        .agg(F.round(F.sum(C("value") * C("channel")), 4).alias("value"))
        .select("vec_id", F.lit(68).alias("channel"), "value")
    )
    noise = (
        first
        .select("vec_id", F.lit(69).alias("channel"), F.round(F.conv(F.substring(seeded("noise"), 1, 8), 16, 10).cast("double") / 4294967296, 6).alias("value"))
    )
    dropped = (
        first
        .select("vec_id", F.lit(70).alias("channel"), F.when(F.substring(seeded("drop"), 1, 1) < "4", 0.0).otherwise(C("value")).alias("value"))
    )
    doubled = few.withColumns({"channel": C("channel") + 64, "value": 2 * C("value")})
    return x.unionByName(doubled).unionByName(mixed).unionByName(noise).unionByName(dropped)


@op("F14_compare_importances")
def f14(s, d):
    """Importances with and without redundant copies of four features, both forests grown together."""
    r = rows(s, d)
    n = len(r.first().features)
    t = T.table(r.withColumn("features", F.concat("features", F.transform(F.slice("features", 1, 4), lambda x: 2 * x))))
    before, after = (T.importances(f, n + 4)[0] for f in T.grow(t, [T.Growth(use=tuple(range(n))), T.Growth()]))
    return s.createDataFrame([(i, float(before[i]) if i < n else None, float(a)) for i, a in enumerate(after)], "channel int, before double, after double")


@op("F15_importance_from_weights")
def f15(s, d):
    w = M.estimator("l1").fit(rows(s, d)).coefficients.toArray()
    return s.createDataFrame([(i, abs(float(v))) for i, v in enumerate(w)], "channel int, importance double")


ORD = "row_number() OVER ({} ORDER BY md5(CAST(vec_id AS VARCHAR) || '|11'), vec_id)"
V = ", v AS (SELECT DISTINCT vec_id, label, target, region FROM dn)\n"


def each(s, d):
    return P.table(s, d, "embeddings").select("vec_id", "label", (C("label") % 2).alias("target"), (C("vec_id") % 3).alias("region"))


def placed(s, d, *by):
    """Label rows with their rank `k` in md5 order and the number `n` of rows, within `by`."""
    v = each(s, d)
    n = v.groupBy(*by).agg(F.count("*").alias("n"))
    k = M.dealt_rank(v, "vec_id", by=by)
    return k.join(F.broadcast(n), list(by)) if by else k.join(F.broadcast(n))  # a row for each class, or one


@op(
    "M1_train_test_split",
    V + f"SELECT vec_id, target, {ORD.format('PARTITION BY target')} <= round(0.7 * count(*) OVER (PARTITION BY target)) AS train FROM v",
)
def m1(s, d):
    return placed(s, d, "target").select("vec_id", "target", (C("k") <= F.round(0.7 * C("n"))).alias("train"))


@op("M2_random_split", V + f"SELECT vec_id, {ORD.format('')} <= round(0.7 * count(*) OVER ()) AS train FROM v")
def m2(s, d):
    return placed(s, d).select("vec_id", (C("k") <= F.round(0.7 * C("n"))).alias("train"))


@op("M3_stratified_kfold", V + f"SELECT vec_id, target, CAST(({ORD.format('PARTITION BY target')} - 1) % 5 AS INTEGER) AS fold FROM v")
def m3(s, d):
    return placed(s, d, "target").select("vec_id", "target", ((C("k") - 1) % 5).cast("int").alias("fold"))


@op("M4_stratified_group_kfold")
def m4(s, d):
    return M.group_folds(rows(s, d), 5).select("id", "grp", "target", "fold")


@op("M5_leave_one_group_out", V + "SELECT vec_id, label AS fold FROM v")
def m5(s, d):
    return each(s, d).select("vec_id", C("label").alias("fold"))


@op("M6_region_folds")
def m6(s, d):
    """Region by region: learn from one, score on each; the trees of all regions are grown together."""
    r = rows(s, d)
    regions = sorted(x.region for x in r.select("region").distinct().collect())
    t = sinks.stage(T.table(r, folds=("region",)))
    forests = T.grow(t, [T.Growth("tree", out=tuple((0, b) for b in regions if b != a)) for a in regions])
    truth = t.select("id", C("folds")[0].alias("region"), C("targets")[0].alias("target"))
    hit = T.predicted(t, forests).join(truth, "id").withColumn("trained_on", F.element_at(F.array(*map(F.lit, regions)), C("growth") + 1))
    return hit.groupBy("region", "trained_on").agg(stats.accuracy((C("score") > 0.5) == (C("target") == 1)).alias("accuracy"))


@op(
    "M7_shuffle_labels",
    V + ", a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM v), b AS (SELECT target, " + ORD.format("") + " AS k FROM v) SELECT vec_id, target FROM a JOIN b USING (k)",
)
def m7(s, d):
    return M.shuffled_labels(each(s, d).withColumnRenamed("vec_id", "id")).select(C("id").alias("vec_id"), "target")


@op("M8_fit_forest")
def m8(s, d):
    """Extra-trees, a random forest and a decision tree, grown together: (model, id, target, score, prediction)."""
    t = T.table(rows(s, d))
    kinds = ("extra", "forest", "tree")
    out = T.predicted(t, T.grow(t, [T.Growth(k, depth=1 if k == "tree" else 4) for k in kinds]))
    model = F.element_at(F.array(*map(F.lit, kinds)), C("growth") + 1).alias("model")
    return out.join(t.select("id", C("targets")[0].alias("target")), "id").select(model, "id", "target", "score", (C("score") > 0.5).cast("int").alias("prediction"))


@op("M9_fit_l1_logistic")
def m9(s, d):
    r, out = sinks.stage(rows(s, d)), None
    n = r.count()
    for c in (0.1, 1.0):
        one = (
            M.scored(M.estimator("l1", reg=1 / (c * n)).fit(r), r)
            .agg(F.avg((C("prediction") == C("target")).cast("double")).alias("accuracy"))
            .withColumn("c", F.lit(c))
        )
        out = one if out is None else out.unionByName(one)
    return out


@op("M10_grid_search")
def m10(s, d):
    """Kinds of trees, features a node tries, numbers of trees and depths over five folds, and coefficients of an L1 logistic model."""
    r = rows(s, d)
    trees = S.grid_search(r, 5, (5, 10, 20), (2, 4))
    l1 = [M.cv_scores(M.stratified_folds(r, 5), "l1", reg=reg).agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("std")).withColumn("coefficient", F.lit(reg)) for reg in (0.1, 0.01)]
    return trees.unionByName(l1[0].unionByName(l1[1]).withColumn("kind", F.lit("l1")), allowMissingColumns=True).orderBy(F.desc("accuracy"))


@op("M11_nested_cv")
def m11(s, d):
    """Five outer folds score what five inner folds select of extra-trees, forests and trees; outer = -1 is the choice for all rows."""
    return S.nested_cv(P.vectors(s, d), 5, (5, 10), (2, 4))


@op("M12_cv_score")
def m12(s, d):
    return S.cv_scores(M.stratified_folds(rows(s, d), 3))


@op(
    "M13_accuracy",
    "SELECT user_id % 5 AS fold, round(avg(CASE WHEN (value > 245) = (event_id % 2 = 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(sum(CASE WHEN (value > 245) = (event_id % 2 = 0) THEN 1.0 + event_id % 3 ELSE 0.0 END) / sum(1.0 + event_id % 3), 6) AS weighted FROM events GROUP BY 1",
)
def m13(s, d):
    hit, w = (C("value") > 245) == (C("event_id") % 2 == 0), 1.0 + C("event_id") % 3
    return (
        P.table(s, d, "events")
        .groupBy((C("user_id") % 5).alias("fold"))
        .agg(F.round(stats.accuracy(hit), 6).alias("accuracy"), F.round(stats.accuracy(hit, w), 6).alias("weighted"))
    )


@op("M14_roc_auc", """, e AS (SELECT event_type, event_id % 2 AS t, round(value) AS v, 1.0 + event_id % 3 AS w FROM events), k AS (SELECT event_type, t, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2 AS r FROM e),
un AS (SELECT event_type, round((sum(r) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1) / 2) / (count(*) FILTER (t = 1) * count(*) FILTER (t = 0)), 6) AS auc FROM k GROUP BY 1),
g AS (SELECT event_type, v, coalesce(sum(w) FILTER (t = 1), 0) AS p, coalesce(sum(w) FILTER (t = 0), 0) AS q FROM e GROUP BY ALL), c AS (SELECT *, p * (coalesce(sum(q) OVER (PARTITION BY event_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS won FROM g),
we AS (SELECT event_type, round(sum(won) / (sum(p) * sum(q)), 6) AS weighted FROM c GROUP BY 1) SELECT event_type, auc, weighted FROM un JOIN we USING (event_type)""")
def m14(s, d):
    e = (
        P.table(s, d, "events")
        .select("event_type", (C("event_id") % 2).alias("target"), F.round("value").alias("score"), (1.0 + C("event_id") % 3).alias("w"))
    )
    weighted = stats.roc_auc(e, "event_type", weight="w").select("event_type", F.round("auc", 6).alias("weighted"))
    return stats.roc_auc(e, "event_type").select("event_type", F.round("auc", 6).alias("auc")).join(weighted, "event_type")


@op("M15_mean_roc", """, e AS (SELECT user_id % 5 AS fold, event_id % 2 AS t, value FROM events), gr AS (SELECT fold, value, sum(t) AS p, sum(1 - t) AS q FROM e GROUP BY ALL),
cu AS (SELECT fold, value, sum(q) OVER w / sum(q) OVER (PARTITION BY fold) AS f1, sum(p) OVER w / sum(p) OVER (PARTITION BY fold) AS t1 FROM gr WINDOW w AS (PARTITION BY fold ORDER BY value DESC)),
st AS (SELECT fold, f1, t1, coalesce(lag(f1) OVER w, 0) AS f0, coalesce(lag(t1) OVER w, 0) AS t0 FROM cu WINDOW w AS (PARTITION BY fold ORDER BY value DESC)),
ap AS (SELECT fold, k, t0 + (t1 - t0) * (k / 99 - f0) / (f1 - f0) AS tpr FROM st, (SELECT range AS k FROM range(100)) WHERE f1 > f0 AND k / 99 <= f1 AND (k / 99 > f0 OR k = 0 AND f0 = 0))
SELECT k, round(avg(tpr), 6) AS mean, round(stddev_pop(tpr), 6) AS std FROM ap GROUP BY 1""")
def m15(s, d):
    """Mean and deviation over folds of the true-positive rate, interpolated on 100 false-positive rates."""
    e = P.table(s, d, "events").select((C("user_id") % 5).alias("fold"), (C("event_id") % 2).alias("target"), "value")
    return stats.mean_roc(e, "fold", "value").select("k", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@op(
    "M16_score_vs_imbalance",
    "SELECT event_type, avg(CASE WHEN value > 245 THEN 1.0 ELSE 0.0 END) >= 1.5 * greatest(avg(CAST(event_id % 2 AS DOUBLE)), 1 - avg(CAST(event_id % 2 AS DOUBLE))) AS good FROM events GROUP BY 1",
)
def m16(s, d):
    share = F.avg((C("event_id") % 2).cast("double"))
    return (
        P.table(s, d, "events")
        .groupBy("event_type")
        .agg((F.avg((C("value") > 245).cast("double")) >= 1.5 * F.greatest(share, 1 - share)).alias("good"))
    )


@op("M17_learning_curve")
def m17(s, d):
    """Accuracy on a fold left out after learning from 5 %, 10 %, ... of the other rows, in five orders."""
    return S.learning_curve(rows(s, d))


@op("M18_fold_detail")
def m18(s, d):
    r = sinks.stage(M.stratified_folds(rows(s, d), 2))
    return (
        S.cv_scores(r)
        .join(r.select("id", "grp", "region", "target", "fold"), "fold")
        .select("id", "fold", "grp", "region", F.when(C("target") == 1, 1).otherwise(-1).alias("sign"), "accuracy")
    )


@op("M19_predict_image")
def m19(s, d):
    """A tree learnt from one region predicts the pixels of all."""
    t = T.table(rows(s, d), folds=("region",))
    tree = T.grow(t, [T.Growth("tree", out=((0, 1), (0, 2)))])
    score = C("score")
    return T.predicted(t, tree).select((C("id") % 25).alias("y"), F.floor(C("id") / 25).alias("x"), (score > 0.5).cast("double").alias("prediction"), "score")


@op("M20_weight_usefulness")
def m20(s, d):
    """Learn from rows of weight 0.5 to 1, with their weights, what a grid over five folds selects; AUC on rows of weight 1."""
    r = sinks.stage(rows(s, d).withColumn("w", (C("id") % 10) / 9))
    part = r.filter("w >= 0.5 and w < 1")
    best = S.grid_search(part, 5, (5, 10), (2, 4)).first()
    t = T.table(part, weight="w")
    forest = T.grow(t, [T.Growth(best.kind, best.trees, best.depth, best.features)])
    test = r.filter("w = 1")
    own = T.predicted(T.table(test), forest).join(test.select("id", "target"), "id")
    return stats.roc_auc(own, "growth").select("auc")


@op("M22_selection_assessment")
def m22(s, d):
    """Per outer fold: select features by U test on the rest, refit, score."""
    return S.selection_assessment(rows(s, d))


CP = """, cp AS (SELECT h AS head, range AS comp_idx, 1.0 / 20 AS pi, range * (1050.0::DOUBLE / 19) + CASE WHEN h = 'p' THEN 5 ELSE 0 END AS mu, 2 * ln(1050.0::DOUBLE / 40) AS lv FROM range(20), (VALUES ('n'), ('p')) t(h)),
mr AS (SELECT min(mz) AS a, max(mz) AS b FROM pk),
gm AS (SELECT DISTINCT mz FROM pk),
pr AS (SELECT mz, head, sum(pi * exp(-0.5 * (mz - mu) ** 2 / exp(lv)) / sqrt(2 * pi() * exp(lv))) AS p FROM gm, cp GROUP BY ALL)
"""
CP = CP.replace("sum(pi * exp", "sum(cp.pi * exp")


def comps(s):
    return X.equispaced(s, 0.0, 1050.0, 20).withColumn("mu", C("mu") + F.when(C("head") == "p", 5).otherwise(0))


def grid(s, lo=0.0, hi=1050.0):
    return s.range(200).select(C("id").alias("k"), (lo + C("id") * ((hi - lo) / 199)).alias("mz"))


def masses(s, d):
    return P.peaks(s, d).select("mz").distinct()


def mass_range(s, d):
    return P.peaks(s, d).agg(F.min("mz").alias("lo"), F.max("mz").alias("hi"))


def heads(s, d):
    """Distinct masses of the peaks with the two heads' NLL."""
    p = X.mixture_prob(masses(s, d), comps(s)).withColumn("nll", X.nll(C("p")))
    return p.groupBy("mz").agg(*[F.max(F.when(C("head") == h, C("nll"))).alias(h) for h in ("n", "p")])


DENSITY = "sum(cp.pi * exp(-0.5 * (mz - mu) ** 2 / exp(lv)) / sqrt(2 * pi() * exp(lv)))"


@op(
    "G1_gmm_prob",
    CP + f"SELECT spectrum_id, idx, h.head, round((SELECT {DENSITY} FROM cp WHERE cp.head = h.head), 8) AS p FROM pk, (VALUES ('n'), ('p')) h(head)",
)
def g1(s, d):
    return X.mixture_prob(P.peaks(s, d), comps(s)).select("spectrum_id", "idx", "head", F.round("p", 8).alias("p"))


@op("G2_gmm_nll", CP + "SELECT mz, head, round(-ln(1e-6 + p), 6) AS nll FROM pr")
def g2(s, d):
    return X.mixture_prob(masses(s, d), comps(s)).select("mz", "head", F.round(X.nll(C("p")), 6).alias("nll"))


PN = ", pn AS (SELECT spectrum_id, mz, intensity, CASE WHEN target = 'F' THEN 'n' ELSE 'p' END AS head FROM pk JOIN lab USING (spectrum_id) WHERE target IN ('F', 'O'))\n"


def headed(s, d):
    t = (
        P.labels(s, d)
        .filter(C("target").isin("F", "O"))
        .select("spectrum_id", F.when(C("target") == "F", "n").otherwise("p").alias("head"))
    )
    return P.peaks(s, d).join(t, "spectrum_id").select("spectrum_id", "mz", "intensity", "head")


@op(
    "G3_gmm_weighted_nll",
    PN + CP + ", q AS (SELECT head, intensity, (SELECT sum(cp.pi * exp(-0.5 * (pn.mz - mu) ** 2 / exp(lv)) / sqrt(2 * pi() * exp(lv))) FROM cp WHERE cp.head = pn.head) AS p FROM pn) SELECT head, round(sum(intensity * -ln(1e-6 + p)) / sum(intensity), 4) AS nll FROM q GROUP BY 1",
)
def g3(s, d):
    p = X.mixture_prob(headed(s, d).withColumnRenamed("head", "own"), comps(s)).filter("own = head")
    return p.groupBy("head").agg(F.round(F.sum(C("intensity") * X.nll(C("p"))) / F.sum("intensity"), 4).alias("nll"))


@op(
    "G4_gmm_init",
    CP + "SELECT h.head, range AS comp_idx, round(a + range * ((b - a) / 19), 6) AS mu, round(2 * ln((b - a) / 40), 6) AS lv FROM mr, range(20), (VALUES ('n'), ('p')) h(head)",
)
def g4(s, d):
    """Starting components on the mass range of the table."""
    lo, hi = mass_range(s, d).first()
    return X.equispaced(s, lo, hi, 20).select("head", "comp_idx", F.round("mu", 6).alias("mu"), F.round("lv", 6).alias("lv"))


@op("G5_gmm_fit")
def g5(s, d):
    return X.fit(headed(s, d), X.equispaced(s, 0.0, 1050.0, 5))


G6 = f", q AS (SELECT spectrum_id, head AS own, intensity, (SELECT {DENSITY} FROM cp WHERE cp.head = 'n') AS a, (SELECT {DENSITY} FROM cp WHERE cp.head = 'p') AS b FROM pn), " + """
t AS (SELECT spectrum_id, own, sum(ln(1e-6 + a) * intensity) AS n, sum(ln(1e-6 + b) * intensity) AS p FROM q GROUP BY ALL)
SELECT spectrum_id, own, round(exp(p - greatest(n, p)) / (exp(p - greatest(n, p)) + exp(n - greatest(n, p)) + 1e-6), 4) AS posterior FROM t"""


@op("G6_gmm_posterior", PN + CP.rstrip() + G6)
def g6(s, d):
    """P(head p | spectrum): intensity-weighted log likelihoods, shifted by the larger one."""
    p = X.mixture_prob(headed(s, d).withColumnRenamed("head", "own"), comps(s))
    ll = p.groupBy("spectrum_id", "own", "head").agg(F.sum(-X.nll(C("p")) * C("intensity")).alias("l"))
    two = ll.groupBy("spectrum_id", "own").agg(*[F.max(F.when(C("head") == h, C("l"))).alias(h) for h in ("n", "p")])
    top = F.greatest("n", "p")
    return two.select("spectrum_id", "own", F.round(F.exp(C("p") - top) / (F.exp(C("p") - top) + F.exp(C("n") - top) + 1e-6), 4).alias("posterior"))


@op("G7_gmm_shared", CP + "SELECT mz, round(max(p) FILTER (head = 'n'), 8) AS n, round(max(p) FILTER (head = 'p'), 8) AS p FROM pr GROUP BY 1")
def g7(s, d):
    p = X.mixture_prob(masses(s, d), comps(s))
    return p.groupBy("mz").agg(*[F.round(F.max(F.when(C("head") == h, C("p"))), 8).alias(h) for h in ("n", "p")])


@op("G8_class_ratio", PN + "SELECT round(sum(intensity) FILTER (head = 'n') / sum(intensity) FILTER (head = 'p'), 6) AS ratio FROM pn")
def g8(s, d):
    return (
        headed(s, d)
        .agg(F.round(F.sum(F.when(C("head") == "n", C("intensity"))) / F.sum(F.when(C("head") == "p", C("intensity"))), 6).alias("ratio"))
    )


H2 = CP + ", hd AS (SELECT mz, max(-ln(1e-6 + p)) FILTER (head = 'n') AS n, max(-ln(1e-6 + p)) FILTER (head = 'p') AS p FROM pr GROUP BY ALL)\n"


@op("G9_mass_class_prob", H2 + "SELECT mz, round(1 / (1 + exp(p - n) * 1.25), 6) AS prob FROM hd")
def g9(s, d):
    return heads(s, d).select("mz", F.round(1 / (1 + F.exp(C("p") - C("n")) * 1.25), 6).alias("prob"))


@op("G10_ratio_min_max", H2 + "SELECT mz, round(greatest(exp(n - p), exp(p - n)), 6) AS hi, round(1 - least(exp(n - p), exp(p - n)), 6) AS lo FROM hd")
def g10(s, d):
    r = F.exp(C("n") - C("p"))
    return heads(s, d).select("mz", F.round(F.greatest(r, 1 / r), 6).alias("hi"), F.round(1 - F.least(r, 1 / r), 6).alias("lo"))


@op("G11_head_ratios", H2 + "SELECT mz, round(exp(abs(n - p)), 6) AS up, round(1 - exp(-abs(n - p)), 6) AS off FROM hd")
def g11(s, d):
    g = F.abs(C("n") - C("p"))
    return heads(s, d).select("mz", F.round(F.exp(g), 6).alias("up"), F.round(1 - F.exp(-g), 6).alias("off"))


@op(
    "G12_mass_grid",
    CP + f", g12 AS (SELECT range AS k, a + range * ((b - a) / 199) AS mz FROM mr, range(200)) SELECT k, h.head, round((SELECT {DENSITY} FROM cp WHERE cp.head = h.head), 8) AS p FROM g12, (VALUES ('n'), ('p')) h(head) WHERE mz BETWEEN 100 AND 500",
)
def g12(s, d):
    """Densities on a grid over the mass range of the table, of which a window is shown."""
    lo, hi = mass_range(s, d).first()
    return X.mixture_prob(grid(s, lo, hi).filter(C("mz").between(100, 500)), comps(s)).select("k", "head", F.round("p", 8).alias("p"))


def fpr(s, d, shuffles: int = 5):
    """Share of label-shuffled fits whose head difference on the grid reaches the observed one. All fits go through the same EM passes, as heads of their own,
    over masses whose intensities are summed once for each of them."""
    label = (
        P.labels(s, d)
        .filter(C("target").isin("F", "O"))
        .select(C("spectrum_id").alias("id"), F.when(C("target") == "F", "n").otherwise("p").alias("target"))
    )
    dealt = M.id_rank(label)
    for i in range(1, shuffles + 1):
        dealt = dealt.join(M.dealt_rank(label, seed=i).select("k", C("target").alias(f"target{i}")), "k")
    runs = dealt.select(C("id").alias("spectrum_id"), *[C(f"target{i}" if i else "target").alias(f"target{i}") for i in range(shuffles + 1)])
    lo, hi = mass_range(s, d).first()
    peaks = P.peaks(s, d).filter("mz is not null").select("spectrum_id", "mz", "intensity").join(runs, "spectrum_id")
    heads_ = tuple(sorted(f"{i}{h}" for i in range(shuffles + 1) for h in "np"))
    weight = [F.sum(F.when(C(f"target{h[:-1]}") == h[-1], C("intensity"))) for h in heads_]
    table = sinks.stage(peaks.groupBy("mz").agg(F.array(*weight).alias("weights")))
    at = X.mixture_prob(grid(s, lo, hi), X.fit_masses(table, X.equispaced(s, lo, hi, 4, heads_), tol=1e-3)).withColumn("l", X.nll(C("p")))
    at = at.withColumns({"run": F.expr("substr(head, 1, length(head) - 1)").cast("int"), "h": F.substring("head", -1, 1)})
    two = (
        at.groupBy("k", "mz", "run")
        .agg(*[F.max(F.when(C("h") == h, C("l"))).alias(h) for h in ("n", "p")])
        .withColumn("gap", F.abs(C("n") - C("p")))
    )
    real = two.filter("run = 0").select("k", "mz", "gap")
    other = two.filter("run > 0").select("k", C("gap").alias("other"))
    return real.join(other, "k").groupBy("k", "mz", "gap").agg(F.avg((C("other") >= C("gap")).cast("double")).alias("fpr"))


op("G13_permutation_fpr")(fpr)


@op("S16_write_fpr")
def s16(s, d):
    return sinks.written(fpr(s, d).select("mz", "gap", "fpr"), "csv")


SB = ", ce AS (SELECT range AS bin_idx, range * 50.0::DOUBLE + 25 AS mu, 12.0::DOUBLE AS sigma FROM range(21))\n"


def centres(s):
    return s.range(21).select(C("id").alias("bin_idx"), (C("id") * 50.0 + 25).alias("mu"), F.lit(12.0).alias("sigma"))


@op(
    "G14_soft_bin",
    SB + "SELECT spectrum_id, bin_idx, round(sum(exp(-0.5 * ((mz - mu) / sigma) * ((mz - mu) / sigma)) * intensity), 4) AS value FROM pk JOIN ce ON -0.5 * ((mz - mu) / sigma) * ((mz - mu) / sigma) >= -10 GROUP BY ALL",
)
def g14(s, d):
    return B.soft_bin(P.peaks(s, d), centres(s), ["spectrum_id"]).withColumn("value", F.round("value", 4))


@op(
    "G15_soft_bin_init",
    ", mr AS (SELECT min(mz) AS a, max(mz) AS b FROM pk) SELECT range AS bin_idx, round(a + range * ((b - a) / 20), 6) AS mu, round((b - a) / 42, 6) AS sigma FROM mr, range(21)",
)
def g15(s, d):
    """21 peaks spread evenly over the mass range of the table."""
    x = (
        mass_range(s, d)
        .select("lo", (C("hi") - C("lo")).alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))).alias("bin_idx"))
    )
    return x.select("bin_idx", F.round(C("lo") + C("bin_idx") * (C("w") / 20), 6).alias("mu"), F.round(C("w") / 42, 6).alias("sigma"))


@op("G16_soft_bin_classifier")
def g16(s, d):
    """Soft bins of log intensities, standardised or counted by a threshold, before a linear head fitted with the labels' weights: (norm, id, target, score)."""
    peaks = P.peaks(s, d).select("spectrum_id", "mz", F.log1p("intensity").alias("intensity"))
    t = (
        P.labels(s, d)
        .filter(C("target").isin("F", "O"))
        .select(C("spectrum_id"), (C("target") == "F").cast("int").alias("target"), "region", "weight")
    )
    r = sinks.stage(
        B.soft_features(peaks, centres(s), ["spectrum_id"], 21)
        .join(t.hint("shuffle_hash"), "spectrum_id")  # as many parts as the peaks are dealt to
        .select(C("spectrum_id").alias("id"), "features", "target", C("region").alias("grp"), "region", "weight")
    )
    _, mean, deviation = stats.moments(r, "features")
    each = lambda of: F.array(*[of(C("features")[i], F.lit(float(m)), F.lit(float(v or 1.0))) for i, (m, v) in enumerate(zip(mean, deviation, strict=True))])
    norms = {
        "standardise": each(lambda x, m, v: (x - m) / v),
        "threshold": each(lambda x, m, v: 1 / (1 + F.exp(m - x))),
    }
    out = []
    for name, of in norms.items():
        table = r.withColumn("v", M.array_to_vector(of))
        out.append(M.scored(M.estimator("l1", reg=0.001).setWeightCol("weight").fit(table), table).select(F.lit(name).alias("norm"), "id", "target", "score"))
    return out[0].unionByName(out[1])


@op("F11_eval_progressive")
def f11(s, d):
    """Progressive binning inside five folds: the bins of each step are found on the other folds and scored on the fold: (fold, step, accuracy, auc)."""
    p, t = labelled(s, d)
    _, scores = S.progressive_binning(p, M.stratified_folds(t, 5), START, LIMIT, 5)
    return M.few(s, scores, "fold int, step int, accuracy double, auc double")