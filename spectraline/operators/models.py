"""Feature tables, folds and single fits of Spark ML's models.

A feature table has id, features (array), target (0/1) and group. Folds and permutations come from md5 order, so they are the
same in every engine; ranks are made in parallel by buckets (functions/stats.py). Many trees at once, and extra-trees, are grown by
operators/forests.py.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spectraline.functions.stats import accuracy, ranked, roc_auc
from spectraline.operators import binning
from spectraline.sources import sinks

SEED = 11


def few(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A table of some rows that the driver has, sent as Arrow: lists would be read by Python workers of another kind, kept beside those of the other jobs."""
    kind = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.table({f.name: pa.array([v[i] for v in values]) for i, f in enumerate(kind)}), kind)


def order_key(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def wide(dense: DataFrame) -> DataFrame:
    """id, features, target, grp, region from channel rows."""
    rows = dense.groupBy("vec_id", "target", "label", "region").agg(F.sort_array(F.collect_list(F.struct("channel", "value"))).alias("f"))
    return (
        rows.select(F.col("vec_id").alias("id"), F.col("f.value").alias("features"), "target", F.col("label").alias("grp"), "region")
        .withColumn("v", array_to_vector("features"))
    )


def dealt_rank(rows: DataFrame, key: str = "id", seed: int = SEED, by: tuple = (), name: str = "k") -> DataFrame:
    """rows with their rank from 1 in the order of md5(key|seed) within `by`; the first three digits of md5 are the buckets."""
    h = order_key(key, seed)
    return ranked(rows, F.substring(h, 1, 3), [h, key], by, name)


def id_rank(rows: DataFrame, key: str = "id", name: str = "k", buckets: int = 1024) -> DataFrame:
    """rows with their rank from 1 by a number; ranges of equal width are the buckets."""
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    width = 1 if lo is None else (hi - lo) // buckets + 1
    return ranked(rows, F.floor((F.col(key) - (lo or 0)) / width), [key], (), name)


def stratified_folds(rows: DataFrame, k: int) -> DataFrame:
    return dealt_rank(rows, by=("target",), name="_rank").withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


#: Groups that are placed one by one on the driver, some tens of MB.
MOST_GROUPS = 200_000


def group_folds(rows: DataFrame, k: int) -> DataFrame:
    """Groups unsplit, largest first to the fold with fewest rows of the group's classes.

    Up to MOST_GROUPS groups are placed one by one. More of them are small against a fold, so groups of equal size and class counts are dealt in
    turn, in md5 order, each such kind of group beginning where the one before ended; that is done in the cluster.
    """
    groups = sinks.stage(rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("target").alias("pos")))
    if groups.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        return rows.join(dealt_groups(groups, k), "grp")
    load, place = [[0, 0] for _ in range(k)], []
    for g in groups.orderBy(F.desc("n"), "grp").collect():
        best = min(range(k), key=lambda i: (max(load[i][0] + g.n - g.pos, load[i][1] + g.pos), sum(load[i]), i))
        load[best][0] += g.n - g.pos
        load[best][1] += g.pos
        place.append((g.grp, best))
    at = rows.sparkSession.createDataFrame(place, f"grp {rows.schema['grp'].dataType.simpleString()}, fold int")
    return rows.join(F.broadcast(at), "grp")


def dealt_groups(groups: DataFrame, k: int) -> DataFrame:
    """grp, fold of groups (grp, n, pos), dealt in turn inside each kind (n, pos); kinds are far fewer than groups."""
    kinds = groups.groupBy("n", "pos").agg(F.count("*").alias("m"))
    before = Window.orderBy(F.desc("n"), "pos").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.select("n", "pos", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    ranks = dealt_rank(groups, "grp", by=("n", "pos"), name="_k")
    return ranks.join(kinds, ["n", "pos"]).select("grp", ((F.col("first") + F.col("_k") - 1) % k).cast("int").alias("fold"))


def estimator(kind: str, **options):
    base = {"featuresCol": "v", "labelCol": "target"}
    if kind == "forest":
        return RandomForestClassifier(**base, numTrees=options.get("trees", 10), maxDepth=options.get("depth", 4), seed=SEED)
    if kind == "tree":
        return DecisionTreeClassifier(**base, maxDepth=options.get("depth", 4), seed=SEED)
    return LogisticRegression(**base, elasticNetParam=1.0, regParam=options.get("reg", 0.01), standardization=False, maxIter=30)


def scored(model, rows: DataFrame) -> DataFrame:
    return (
        model.transform(rows)
        .select("id", "target", "grp", "region", F.col("prediction"), vector_to_array("probability")[1].alias("score"))
    )


def cv_scores(rows: DataFrame, kind: str = "tree", **options) -> DataFrame:
    """fold, accuracy, auc: fit on the other folds, score on the fold."""
    out = None
    for (fold,) in sorted(rows.select("fold").distinct().collect()):
        model = estimator(kind, **options).fit(rows.filter(F.col("fold") != fold))
        s = scored(model, rows.filter(F.col("fold") == fold)).withColumn("fold", F.lit(int(fold)))
        part = (
            s.groupBy("fold")
            .agg(F.avg((F.col("prediction") == F.col("target")).cast("double")).alias("accuracy"))
            .join(roc_auc(s, "fold"), "fold")
        )
        out = part if out is None else out.unionByName(part)
    return out


def shuffled_labels(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with targets dealt out anew."""
    new = dealt_rank(rows.select("id", "target"), seed=seed).select("k", F.col("target").alias("new"))
    return id_rank(rows).join(new, "k").withColumn("target", F.col("new")).drop("k", "new")


def kept_features(rows: DataFrame, channels: list[int]) -> DataFrame:
    pick = F.transform(F.array(*[F.lit(c + 1) for c in channels]), lambda i: F.element_at("features", i))
    return rows.withColumn("features", pick).withColumn("v", array_to_vector("features"))


def forward_selection(rows: DataFrame, gain: float = 0.01) -> DataFrame:
    """step, channel, score: the feature, of all, that adds most to the mean accuracy over folds (column `fold`), until the gain is too small.

    Candidates are scored with Gaussian naive Bayes, whose fit on all folds but one is a difference of sums and whose log odds are a sum over
    features. So one pass fits every feature, and a step scores all candidates in one job, whatever their number.
    """
    spark = rows.sparkSession
    long = rows.select("id", "fold", "target", F.posexplode("features").alias("channel", "x"))
    part = (
        long.groupBy("channel", "fold", "target")
        .agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    )
    whole = part.groupBy("channel", "target").agg(*[F.sum(c).alias(f"{c}_all") for c in "nsq"])
    rest = (
        part.join(whole, ["channel", "target"])
        .select("channel", "fold", "target", *[(F.col(f"{c}_all") - F.col(c)).alias(c) for c in "nsq"])
    )
    mean = F.col("s") / F.col("n")
    fit = (
        rest
        .select(
            "channel", "fold", "target", F.log("n").alias("prior"), mean.alias("mu"),
            F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(1e-9)).alias("var"),
        )
    )
    of = lambda c, y: F.max(F.when(F.col("target") == y, F.col(c))).alias(f"{c}{y}")
    fit = fit.groupBy("channel", "fold").agg(*[of(c, y) for c in ("prior", "mu", "var") for y in (0, 1)])
    log = lambda y: -0.5 * (F.log(f"var{y}") + (F.col("x") - F.col(f"mu{y}")) ** 2 / F.col(f"var{y}"))
    odds = (
        sinks
        .stage(long.join(fit, ["channel", "fold"]).select("id", "fold", "target", "channel", (log(1) - log(0)).alias("odds"), (F.col("prior1") - F.col("prior0")).alias("prior")))
    )
    chosen: list[tuple[int, int, float]] = []
    while True:
        have = [c for _, c, _ in chosen]
        total = F.col("odds") + F.col("prior")
        tries = odds
        if have:
            tries = (
                odds.filter(~F.col("channel").isin(have))
                .join(odds.filter(F.col("channel").isin(have)).groupBy("id").agg(F.sum("odds").alias("base")), "id")
            )
            total = total + F.col("base")
        each = (
            tries.groupBy("channel", "fold")
            .agg(accuracy((total > 0) == (F.col("target") == 1)).alias("a"))
            .groupBy("channel")
            .agg(F.avg("a").alias("score"))
        )
        best = each.orderBy(F.desc("score"), "channel").first()
        if best is None or best.score < (chosen[-1][2] if chosen else 0.0) + gain:
            return few(spark, chosen, "step int, channel int, score double")
        chosen.append((len(chosen), best.channel, best.score))


def binned(peaks: DataFrame, labels: DataFrame, bins: list[tuple[float, float]], vector: bool = True) -> DataFrame:
    """A feature table of labels (id, target, grp, region), with the sums of peaks (id, mz, intensity) in each bin. A spectrum's sums are added up at once, for some tens of bins."""
    fan = -int(-sum(hi - lo for lo, hi in bins) // (max(hi for _, hi in bins) - min(lo for lo, _ in bins)))  # bins over a mass, on average
    own = [F.sum(F.when(F.col("mz").between(lo, hi), F.col("intensity"))).alias(f"_{i}") for i, (lo, hi) in enumerate(bins)]
    sums = binning.dealt(peaks, ["id"], fan).groupBy("id").agg(*own)
    value = sums.select("id", F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i in range(len(bins))]).alias("features"))
    none = F.array_repeat(F.lit(0.0), len(bins))
    out = labels.join(value, "id", "left").withColumn("features", F.coalesce("features", none))
    return out.withColumn("v", array_to_vector("features")) if vector else out
