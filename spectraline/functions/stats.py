"""Per-feature statistics: ranks, Welch t, Mann-Whitney U, Benjamini-Hochberg, AUC."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Coefficients of a published Chebyshev fit to erfc, relative error below 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal Z."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    inner = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        inner = c + t * inner
    return t * F.exp(-x * x + inner)


def normal_two_sided_sql(z: str) -> str:
    """The same in SQL."""
    x = f"(abs({z}) / sqrt(2::DOUBLE))"
    t, inner = f"(1 / (1 + 0.5::DOUBLE * {x}))", f"{ERFC[-1]}::DOUBLE"
    for c in ERFC[-2::-1]:
        inner = f"({c}::DOUBLE + {t} * {inner})"
    return f"({t} * exp(-{x} * {x} + {inner}))"


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([incomplete_beta(n / 2, 0.5, n / (n + x * x)) if x == x and n == n else float("nan") for x, n in zip(t, dof, strict=True)])


def value_buckets(rows: DataFrame, value: str, buckets: int = 256) -> Column:
    """The number of approximate quantiles (fewer than `buckets`, found in one pass over rows) that are below the value: every 16th first, then those between."""
    found = rows.agg(F.percentile_approx(F.col(value).cast("double"), [i / buckets for i in range(1, buckets)], 1000)).first()[0]
    cuts = sorted({c for c in found or [] if c == c})
    lists = [cuts[16 * k : 16 * k + 15] for k in range(len(cuts) // 16 + 1)]
    array = lambda few: F.array(*map(F.lit, few)).cast("array<double>")
    above = lambda few: F.size(F.filter(few, lambda c: F.col(value) > c))
    coarse = above(array(cuts[15::16]))
    return coarse * 16 + above(F.element_at(F.array(*map(array, lists)), coarse + 1))


def prefix_sums(counts: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """counts with `<c>_before` for each of `sums`: the sum of c over smaller values of the group. Groups and values must be distinct.

    Values are cut into buckets by their quantiles; sums run inside a bucket and are lifted by those of the buckets before, of which a group has
    some hundreds. So a table of one group is worked on by as many tasks, and none sorts a group. Nulls and NaN stand as Spark orders them.
    """
    rows = counts.withColumn("_bucket", F.when(F.col(value).isNull(), -1).otherwise(value_buckets(counts, value)))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    sizes = rows.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(c) for c in sums])
    sizes = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(c).over(before), none).alias(f"_lift{i}") for i, c in enumerate(sums)])
    placed = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), none) for c in sums})
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = placed.join(sizes, same).withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_lift{i}") for i, c in enumerate(sums)})
    return out.select(*counts.columns, *[f"{c}_before" for c in sums])


def average_ranks(rows: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """rows with the rank of value within `by`, ties sharing their mean rank. Ranks are made for distinct values, which rows look up."""
    counts = prefix_sums(rows.groupBy(*by, value).agg(F.count("*").alias("_n")), by, value, ["_n"])
    keys = [*by, value]
    ranks = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(ranks, same).select(*rows.columns, name)


def next_in_order(rows: DataFrame, order: list[str], take: list[str]) -> DataFrame:
    """rows with `next_<c>` of the row that follows in the order of some columns, the first of which is a number; null for the last row.

    Inside buckets of the first column by a window, across them from the first row of the next bucket that has one.
    """
    rows = rows.withColumn("_bucket", F.when(F.col(order[0]).isNull(), -1).otherwise(value_buckets(rows, order[0])))
    inside, across = Window.partitionBy("_bucket").orderBy(*order), Window.orderBy("_bucket")
    head = F.struct(*order, *[F.col(c).alias(f"_take{i}") for i, c in enumerate(take)])
    firsts = rows.groupBy("_bucket").agg(F.min(head).alias("_head")).select("_bucket", F.lead("_head").over(across).alias("_head"))
    own = rows.withColumns({f"next_{c}": F.lead(c).over(inside) for c in take} | {"_last": F.row_number().over(inside) == F.count("*").over(Window.partitionBy("_bucket"))})
    out = own.join(firsts, "_bucket").withColumns({f"next_{c}": F.when(F.col("_last"), F.col("_head")[f"_take{i}"]).otherwise(F.col(f"next_{c}")) for i, c in enumerate(take)})
    return out.drop("_bucket", "_last", "_head")


def welch_t(long: DataFrame, bonferroni: bool = False) -> DataFrame:
    """channel, t, dof, p from rows (channel, target 0/1, value); Bonferroni's p is not clipped."""
    side = lambda y: F.when(F.col("target") == y, F.col("value"))
    a = (
        long.groupBy("channel")
        .agg(*[f(side(y)).alias(f"{n}{y}") for y in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    )
    e0, e1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    out = a.select(
        "channel", ((F.col("m0") - F.col("m1")) / F.sqrt(e0 + e1)).alias("t"),
        ((e0 + e1) ** 2 / (e0 * e0 / (F.col("n0") - 1) + e1 * e1 / (F.col("n1") - 1))).alias("dof"),
    )
    p = t_two_sided("t", "dof")
    return out.withColumn("p", p * long.select("channel").distinct().count() if bonferroni else p)


def mann_whitney(long: DataFrame, *by: str, totals: DataFrame | None = None) -> DataFrame:
    """by, channel, u, z, p: U of target 0, normal approximation with tie correction and continuity.

    With totals (by, target, n: rows of a class, also those left out) long may lack its zeros: they are one block of ties, whose size is what is
    missing, so only other values are grouped and shuffled. Channels without any other value then have no row.
    """
    keys = [*by, "channel"]
    ties = long.groupBy(*keys, "value").agg(F.count("*").alias("t"), F.sum((F.col("target") == 0).cast("long")).alias("t0"))
    if totals is not None:
        of = F.sum(F.when(F.col("target") == 0, F.col("n")).otherwise(0))
        whole = totals.groupBy(*by).agg(F.sum("n").alias("_n"), of.alias("_n0"))
        seen = ties.groupBy(*keys).agg(F.sum("t").alias("_t"), F.sum("t0").alias("_t0"))
        seen = seen.join(whole, list(by)) if by else seen.join(F.broadcast(whole))  # one row
        zeros = seen.select(*keys, F.lit(0).cast(long.schema["value"].dataType).alias("value"), (F.col("_n") - F.col("_t")).alias("t"), (F.col("_n0") - F.col("_t0")).alias("t0"))
        ties = ties.unionByName(zeros.filter("t > 0")).groupBy(*keys, "value").agg(F.sum("t").alias("t"), F.sum("t0").alias("t0"))
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ties.withColumn("r", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    s = (
        ranked.groupBy(*keys)
        .agg(F.sum(F.col("r") * F.col("t0")).alias("r0"), F.sum("t0").alias("n0"), F.sum("t").alias("n"), F.sum(F.col("t") ** 3 - F.col("t")).alias("tie"))
    )
    n0, n = F.col("n0"), F.col("n")
    u = F.col("r0") - n0 * (n0 + 1) / 2
    mean, var = n0 * (n - n0) / 2, n0 * (n - n0) / 12 * ((n + 1) - F.col("tie") / (n * (n - 1)))
    out = s.select(*keys, u.alias("u"), ((F.greatest(u, n0 * (n - n0) - u) - mean - 0.5) / F.sqrt(var)).alias("z"))
    return out.withColumn("p", F.least(F.lit(1.0), normal_two_sided(F.col("z"))))


def bh_adjust(p: DataFrame) -> DataFrame:
    """Adjusted p: least of p * m / rank over equal or higher ranks. One row per feature, so the ordered pass is over features."""
    w = Window.orderBy("p", "channel")
    ranked = p.withColumn("rank", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy()))
    back = Window.orderBy(F.desc("rank"))
    return ranked.withColumn("adjusted", F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("rank")).over(back))).drop("m")


def roc_auc(scored: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve of (target 0/1, score), ties counted half; sums run over distinct scores, in buckets (prefix_sums)."""
    w = F.col(weight) if weight else F.lit(1)
    t = scored.groupBy(*by, "score").agg(F.sum(F.col("target") * w).alias("pos"), F.sum((1 - F.col("target")) * w).alias("neg"))
    s = prefix_sums(t, list(by), "score", ["neg"]).withColumn("won", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return s.groupBy(*by).agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def mean_roc(scored: DataFrame, fold: str, score: str, steps: int = 99) -> DataFrame:
    """k, mean, std over folds of the true-positive rate of (target 0/1, score), interpolated at the false-positive rates k / steps."""
    g = scored.groupBy(fold, score).agg(F.sum("target").alias("p"), F.sum(1 - F.col("target")).alias("q"))
    all_ = g.groupBy(F.col(fold).alias("_fold")).agg(F.sum("p").alias("p_all"), F.sum("q").alias("q_all"))
    # from the highest score down: what is left after the scores below and the own one, and with the own one
    up = lambda c, own: (F.col(f"{c}_all") - F.col(f"{c}_before") - own) / F.col(f"{c}_all")
    step = prefix_sums(g, [fold], score, ["p", "q"]).join(all_, F.col(fold).eqNullSafe(F.col("_fold"))).select(
        fold, up("q", F.lit(0)).alias("f1"), up("p", F.lit(0)).alias("t1"), up("q", F.col("q")).alias("f0"), up("p", F.col("p")).alias("t0"),
    )
    places = F.sequence(F.floor(F.col("f0") * steps), F.least(F.lit(steps).cast("long"), F.ceil(F.col("f1") * steps)))
    grid = step.filter("f1 > f0").withColumn("k", F.explode(places)).withColumn("x", F.col("k") / steps)
    rise = (F.col("t1") - F.col("t0")) * (F.col("x") - F.col("f0")) / (F.col("f1") - F.col("f0"))
    at = grid.filter("x <= f1 and (x > f0 or k = 0 and f0 = 0)").select(fold, "k", (F.col("t0") + rise).alias("tpr"))
    return at.groupBy("k").agg(F.avg("tpr").alias("mean"), F.stddev_pop("tpr").alias("std"))


def accuracy(hit: Column, weight: Column | None = None) -> Column:
    """Share, or share of weight, of the rows for which `hit` is true."""
    right = hit.cast("double")
    return F.avg(right) if weight is None else F.sum(right * weight) / F.sum(weight)


def moments(rows: DataFrame, features: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means and deviations of an array column: three numbers a feature on the driver, from sums and then squares about the means."""

    def summed(about: np.ndarray | None) -> tuple[int, np.ndarray]:
        def sums(batches):
            total, n = 0.0, 0
            for batch in batches:
                x = grid(batch, 0)
                total, n = total + (x.sum(0) if about is None else ((x - about) ** 2).sum(0)), n + len(x)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], names=["f", "s", "n"])

        found = rows.select(features).mapInArrow(sums, "f long, s double, n long").groupBy("f").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("f").collect()
        return (found[0].n if found else 0), np.array([r.s for r in found])

    n, total = summed(None)
    mean = total / max(n, 1)
    return n, mean, np.sqrt(summed(mean)[1] / max(n, 1)) if n else mean


def grid(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """An array column, all of whose arrays have one length, as rows x features."""
    flat = batch.column(column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(flat) // max(1, batch.num_rows))


def correlations(rows: DataFrame, method: str = "pearson", features: str = "features", key: str = "id", width: int = 256, at_once: int = 128) -> DataFrame:
    """f, g, r of all pairs of features, as a distributed table; r of a constant feature is null.

    Features are cut into blocks of `width`; tasks sum the products of standardised blocks, the sums of a pair of blocks meet in one group, which
    answers with its rows. A task holds the sums of `at_once` pairs of blocks (64 MB), further pairs take another job. Spearman's are those of average ranks.
    """
    if method == "spearman":
        long = rows.select(key, F.posexplode(features).alias("channel", "x"))
        rows = average_ranks(long, "x", ["channel"], "r").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("channel", "r"))).alias("c")).select(F.col("c.r").alias(features))
    n, mean, deviation = moments(rows, features)
    blocks = range(-(-len(mean) // width))
    pairs = [(i, j) for i in blocks for j in blocks if i <= j]
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = np.where(deviation > 0, 1 / (deviation * math.sqrt(max(n, 1))), np.nan)
    held = rows.sparkSession.sparkContext.broadcast((mean, scale))

    def products(some: list):
        def sums(batches):
            centre, by = held.value
            found = {}
            for batch in batches:
                x = (grid(batch, 0) - centre) * by
                for i, j in some if len(x) else ():
                    found[i, j] = found.get((i, j), 0.0) + x[:, i * width : (i + 1) * width].T @ x[:, j * width : (j + 1) * width]
            for (i, j), product in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([product.tobytes()], pa.binary())], names=["i", "j", "data"])

        return sums

    def pairs_of(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        f, g = np.arange(i * width, min(len(mean), (i + 1) * width)), np.arange(j * width, min(len(mean), (j + 1) * width))
        r = np.sum([np.frombuffer(x) for x in group["data"]], axis=0)
        out = pd.DataFrame({"f": np.repeat(f, len(g)), "g": np.tile(g, len(f)), "r": r})
        return out if i == j else pd.concat([out, out.rename(columns={"f": "g", "g": "f"})])

    out = rows.sparkSession.createDataFrame([], "f int, g int, r double")
    for k in range(0, len(pairs), at_once):
        parts = rows.select(features).mapInArrow(products(pairs[k : k + at_once]), "i long, j long, data binary")
        out = out.unionByName(parts.groupBy("i", "j").applyInPandas(pairs_of, "f int, g int, r double"))
    return out


def monotone(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Running maximum of `value` up to the first null of a sequence; null from there on."""
    w = Window.partitionBy(*by).orderBy(order)
    ended = F.max(F.col(value).isNull()).over(w)
    return rows.withColumn(value, F.when(~ended, F.max(value).over(w)))


def leading_share(importances: DataFrame, share: float) -> DataFrame:
    """Features (channel, v) from the top whose running sum, their own included, is at most a share of the total."""
    w = Window.orderBy(F.desc("v"), "channel").rowsBetween(Window.unboundedPreceding, 0)
    out = importances.select("*", F.sum("v").over(w).alias("run"), F.sum("v").over(Window.partitionBy()).alias("total"))
    return out.filter(F.col("run") <= share * F.col("total")).drop("run", "total")


def upper_half(importances: DataFrame) -> DataFrame:
    """The n - n // 2 most important of n features."""
    r, n = F.row_number().over(Window.orderBy(F.desc("v"), "channel")), F.count("*").over(Window.partitionBy())
    return importances.withColumns({"r": r, "n": n}).filter("r <= n - n div 2").drop("r", "n")


def ranked(rows: DataFrame, bucket: Column, order: list, by: tuple = (), name: str = "k") -> DataFrame:
    """rows with their exact rank from 1 by (bucket, order) within `by`.

    Rows are numbered inside their bucket, in parallel, and lifted by the sizes of the buckets before. Callers keep
    the number of buckets below some thousands, so the table of sizes is small enough to broadcast.
    """
    rows = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    sizes = sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(sizes), [*by, "_bucket"])
        .withColumn(name, F.col("_first") + F.col("_place"))
        .drop("_bucket", "_first", "_place")
    )


def quantiles(rows: DataFrame, value: str, shares: list[float], buckets: int = 64) -> list[float]:
    """Exact quantiles with linear interpolation. Approximate ones cut the values into buckets, whose sizes tell where the exact ones are."""
    at = F.col(value)
    rows = rows.filter(at.isNotNull()).select(at.cast("double").alias("v"))
    cuts = sorted(set(rows.agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)])).first()[0] or []))
    bucket = sum((F.col("v") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    counted = rows.groupBy("v").agg(F.count("*").alias("n")).withColumn("bucket", bucket)
    sizes = {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return [float("nan")] * len(shares)
    places = sorted({p for q in shares for p in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
    first, want = 0, []
    for b in sorted(sizes):
        want += [(b, p - first, p) for p in places if first <= p < first + sizes[b]]
        first += sizes[b]
    w = Window.partitionBy("bucket").orderBy("v")
    inside = counted.filter(F.col("bucket").isin({b for b, _, _ in want})).withColumn("upto", F.sum("n").over(w))
    keys = rows.sparkSession.createDataFrame(want, "b int, place long, p long")  # two places a share at most
    on = (F.col("bucket") == F.col("b")) & (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))
    found = {r.p: r.v for r in inside.join(F.broadcast(keys), on).select("p", "v").collect()}
    out = []
    for q in shares:
        place = q * (total - 1)
        lo, hi = found[math.floor(place)], found[math.ceil(place)]
        out.append(lo + (hi - lo) * (place - math.floor(place)))
    return out
