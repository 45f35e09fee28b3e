"""Range joins of peaks and bins: sums, trapezoid areas, kernels and nearest bins.

All go through cells: an equi-join on the cell with the exact predicate on top replaces the nested loop. A bin is stored at the dyadic
level of its own width, whose cells are at least as wide, so it has two cells at most; a peak probes one cell a level that any bin has.
Bins of one width are one level, so peaks stay one row each; a bin over the whole range beside narrow ones adds a level, not cells.
Spark broadcasts the stored bins if they are small; else a hot cell is dealt to several tasks by `salt` or by adaptive execution.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Groups that a task holds at a time, about.
TASK_GROUPS = 500_000


def dealt(peaks: DataFrame, keys: list[str], fan: int = 1) -> DataFrame:
    """peaks dealt by keys of a spectrum or pixel to so many tasks that none makes more than about TASK_GROUPS groups, of `fan` a peak.

    Sums by these keys and a bin, windows and joins on the keys then need no other exchange, and a task's memory is the same whatever the
    number of peaks. Not for keys of few values, such as classes.
    """
    n = max(-(-peaks.count() * fan // TASK_GROUPS), peaks.sparkSession.sparkContext.defaultParallelism)
    return peaks.repartition(n, *keys)


def cell_width(bins: DataFrame) -> float:
    """Median bin width; 1 if there is none."""
    w = bins.agg(F.percentile_approx(F.col("hi") - F.col("lo"), 0.5)).first()[0]
    return w if w and w > 0 else 1.0


def cells(lo: Column, hi: Column, width: float | Column) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def level(lo: Column, hi: Column) -> Column:
    """The exponent of the least power of two that is no less than the width, a millionth at least."""
    return F.ceil(F.log2(F.greatest(hi - lo, F.lit(1e-6)) * (1 - 1e-12))).cast("int")


def range_join(peaks: DataFrame, bins: DataFrame, value: str = "mz", how: str = "inner", salt: int = 1, small: bool = False) -> DataFrame:
    """Pairs with lo <= value <= hi, both ends closed; a peak on a shared edge meets both bins.

    The levels that occur are collected, some tens at most. With salt, bins are stored that many times, and the peaks of each cell dealt to these;
    `small` says that bins are few enough to be sent to every task.
    """
    stored = bins.withColumn("_level", level(F.col("lo"), F.col("hi")))
    levels = sorted(r[0] for r in stored.filter("_level is not null").select("_level").distinct().collect()) or [0]
    stored = stored.withColumn("_cell", F.explode(cells(F.col("lo"), F.col("hi"), F.pow(F.lit(2.0), F.col("_level")))))
    p = peaks if len(levels) == 1 else peaks.withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    p = p.withColumn("_cell", F.floor(F.col(value) / (F.lit(2.0 ** levels[0]) if len(levels) == 1 else F.pow(F.lit(2.0), F.col("_level")))))
    on = (p["_cell"] == stored["_cell"]) & p[value].between(stored["lo"], stored["hi"])
    if len(levels) > 1:
        on = on & (p["_level"] == stored["_level"])
    if salt > 1:
        p = p.withColumn("_salt", F.pmod(F.xxhash64(*peaks.columns), F.lit(salt)).cast("int"))
        stored = stored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on = on & (p["_salt"] == stored["_salt"])
    return p.join(F.broadcast(stored) if small else stored, on, how).drop("_cell", "_level", "_salt")


def bin_sum(peaks: DataFrame, bins: DataFrame, keys: list[str], salt: int = 1) -> DataFrame:
    """Sum of intensity for each key and bin that has a peak."""
    return range_join(peaks, bins, salt=salt).groupBy(*keys, "bin_idx").agg(F.sum("intensity").alias("value"))


#: Bins of one window that a row lists at most, about.
LISTED = 10_000


def shared(bins: DataFrame) -> DataFrame:
    """lo, hi, bins: the bins of each window in arrays of about LISTED at most, so that what holds for a window is found once for all of them."""
    same = bins.groupBy("lo", "hi").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    part = F.pmod(F.xxhash64("bin_idx"), F.lit(-(-same // LISTED)))
    return bins.groupBy("lo", "hi", part.alias("_part")).agg(F.sort_array(F.collect_list("bin_idx")).alias("bins")).drop("_part")


#: Powers of two of width that windows of a tier may differ by, and peaks of a strip that stay together, about.
TIER, TOGETHER = 6, 20_000


def window_sums(peaks: DataFrame, windows: DataFrame, keys: list[str], salt: int = 1) -> DataFrame:
    """keys, value and the columns of windows (lo, hi, ...): the sum of intensity for each key and window that has a peak, as in `bin_sum`.

    For windows so many and overlapping that pairs of keys and windows are far more than peaks. The masses are cut into strips twice as wide as the
    widest window (much narrower windows are a tier with strips of its own). A window is in the strip of its lo, a peak in the one or two strips
    whose windows can hold it; the keys of a strip of many peaks are dealt to parts, `salt` at least, which have all its windows. In a part a peak learns
    the peak before it and those up to the largest width after it; then the first peak in a window has the window's sum, so pairs are neither
    shuffled nor kept. Rows come window by window, in each by keys: what is written of them repeats itself at short distances and packs well.
    """
    mz, windows = F.col("mz"), windows.filter("lo <= hi")
    width = level(F.col("lo"), F.col("hi"))
    lo, hi, wide, widths = windows.agg(F.min("lo"), F.max("hi"), F.max(F.col("hi") - F.col("lo")), F.collect_set(width)).first()  # some tens of widths
    if wide is None:
        lo, hi, wide, widths = 0.0, -1.0, 0.0, [0]
    top, tiers = max(widths), sorted({(max(widths) - w) // TIER for w in widths})
    several = tiers[-1] + 1

    def strips(t: int) -> Column:
        size = 2.0 ** (top - TIER * t)
        least = mz - F.abs(mz) * 1e-12 - size * (1 + 1e-9)
        return F.transform(F.sequence(F.floor(least / (2 * size)), F.floor(mz / (2 * size))), lambda k: k * several + t)

    inside = peaks.filter(mz.between(lo, hi)).select(*keys, mz.cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity"))
    spread = inside.withColumn("_strip", F.explode(F.concat(*map(strips, tiers))))
    tier = F.floor((F.lit(top) - width) / TIER)
    stored = windows.withColumn("_strip", F.floor(F.col("lo") / F.pow(F.lit(2.0), top + 1 - TIER * tier)) * several + tier)
    crowded = F.when(F.col("n") > TOGETHER * salt, F.struct("_strip", F.ceil(F.col("n") / TOGETHER).alias("_parts")))
    total, hot = spread.groupBy("_strip").agg(F.count("*").alias("n")).agg(F.sum("n"), F.collect_list(crowded)).first()  # hot: total / TOGETHER at most
    most, parts = max([salt, *(r["_parts"] for r in hot)]), F.lit(salt)
    if hot:
        table = F.broadcast(peaks.sparkSession.createDataFrame(pa.table({c: pa.array([r[c] for r in hot]) for c in ("_strip", "_parts")})))
        spread, stored, parts = spread.join(table, "_strip", "left"), stored.join(table, "_strip", "left"), F.coalesce("_parts", F.lit(salt))
    spread = spread.select(*keys, "mz", "intensity", (F.col("_strip") * most + F.pmod(F.xxhash64(*keys), parts)).alias("_cell"))
    stored = stored.select(*windows.columns, F.explode(F.sequence(F.col("_strip") * most, F.col("_strip") * most + parts - 1)).alias("_cell"))
    over = f"OVER (PARTITION BY _cell, {', '.join(keys)} ORDER BY mz"
    known = spread.repartition(max(2 * (total or 0) // TOGETHER, 4 * peaks.sparkSession.sparkContext.defaultParallelism), "_cell").selectExpr(
        "_cell", *keys, "mz", "intensity", f"lag(mz) {over}) AS _before", f"lead(mz) {over}) AS _after",
        f"collect_list(struct(mz, intensity)) {over} RANGE BETWEEN CURRENT ROW AND {wide * (1 + 1e-9) + 1e-9!r}D FOLLOWING) AS _near",
    )
    met = stored.hint("merge").join(known, "_cell").filter("mz between lo and hi and (_before is null or _before < lo)")
    more = F.transform(F.filter("_near", lambda x: (x["mz"] <= F.col("hi")) & x["intensity"].isNotNull()), lambda x: x["intensity"])
    added = F.when(F.size(more) > 0, F.aggregate(more, F.lit(0.0), lambda a, x: a + x))
    alone = F.col("_after").isNull() | (F.col("_after") > F.col("hi"))
    return met.select(*keys, *windows.columns, F.when(alone, F.col("intensity")).otherwise(added).alias("value"))


def zero_filled(sums: DataFrame, rows: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """sums (keys, bin_idx, value) with a row for every row of keys and bin, 0.0 where there is no peak.

    The sums of a key are gathered, as many as bins at most, and spread over the list of bins, which is one row; keys must be distinct and not null.
    """
    every = bins.agg(F.sort_array(F.collect_list("bin_idx")).alias("_bins"))
    own = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin_idx", "value"))).alias("_own"))
    out = rows.select(*keys).join(own, keys, "left").join(F.broadcast(every))  # one row
    return out.select(*keys, F.explode("_bins").alias("bin_idx"), "_own").select(*keys, "bin_idx", F.coalesce(F.element_at("_own", F.col("bin_idx")), F.lit(0.0)).alias("value"))


def counted(filled: DataFrame, rows: DataFrame, bins: DataFrame) -> DataFrame:
    """filled as it is; an error if its rows are not as many as rows x bins."""
    n, want = filled.count(), rows.count() * bins.count()
    if n != want:
        raise ValueError(f"{n} values for {want} places")
    return filled


def mass_filter(peaks: DataFrame, lo: float, hi: float, least: float, label: str) -> DataFrame:
    """Peaks with lo < mz < hi and intensity > least; an error if a class of `label` loses all its peaks."""
    keep = (F.col("mz") > lo) & (F.col("mz") < hi) & (F.col("intensity") > least)
    lost = [r[0] for r in peaks.groupBy(label).agg(F.max(keep).alias("some")).filter("not some").select(label).collect()]  # classes
    if lost:
        raise ValueError(f"no peak is left of {sorted(map(str, lost))}")
    return peaks.filter(keep)


def isotope_followers(peaks: DataFrame, spacing: float = 1.00335, tol: float = 0.002) -> DataFrame:
    """Peaks (spectrum_id, idx) that are second or later in a chain of at least three, a spacing apart, with intensities that fall from the second on.

    Followers are met through cells of m/z inside a spectrum. Chains overlap, so the last two of each three name all followers.
    """
    p = peaks.select("spectrum_id", "idx", "mz", "intensity")
    width = 2 * tol
    to = p.select(
        "spectrum_id", F.col("idx").alias("i"), F.col("intensity").alias("ia"), (F.col("mz") + spacing - tol).alias("lo"),
        (F.col("mz") + spacing + tol).alias("hi"),
    )
    to = to.withColumn("_cell", F.explode(cells(F.col("lo"), F.col("hi"), width)))
    steps = p.withColumn("_cell", F.floor(F.col("mz") / width)).join(to, ["spectrum_id", "_cell"]).filter("mz between lo and hi")
    steps = steps.select("spectrum_id", "i", F.col("idx").alias("j"), "ia", F.col("intensity").alias("ib"))
    first, then = steps.select("spectrum_id", F.col("j").alias("second")), steps.select("spectrum_id", F.col("i").alias("second"), F.col("j").alias("third"), "ia", "ib")
    chains = first.distinct().join(then.filter("ib <= ia"), ["spectrum_id", "second"])
    return chains.select("spectrum_id", F.explode(F.array("second", "third")).alias("idx")).distinct()


def segments(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring peaks of a spectrum as (m0, i0, m1, i1)."""
    w = Window.partitionBy(*keys).orderBy("mz", "intensity", "idx")
    out = (
        peaks
        .select(*keys, F.col("mz").alias("m0"), F.col("intensity").alias("i0"), F.lead("mz").over(w).alias("m1"), F.lead("intensity").over(w).alias("i1"))
    )
    return out.filter("m1 > m0")


def bin_integrate(peaks: DataFrame, bins: DataFrame, keys: list[str], gap: str = "leak", width: float | None = None) -> DataFrame:
    """Area of the piecewise linear spectrum over bins. gap='leak': a bin starts where the one before it ends; 'clip': at its own lo."""
    if gap == "leak":
        bins = bins.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("bin_idx")), F.col("lo")))
    width = width or cell_width(bins)
    seg = (
        segments(peaks, keys)
        .withColumn("c0", F.floor(F.col("m0") / width))
        .withColumn("_cell", F.explode(cells(F.col("m0"), F.col("m1"), width)))
    )
    b = bins.withColumn("b0", F.floor(F.col("lo") / width)).withColumn("_cell", F.explode(cells(F.col("lo"), F.col("hi"), width)))
    met = seg.join(b, "_cell").filter("_cell = greatest(c0, b0) and least(m1, hi) > greatest(m0, lo)")
    a, z = F.greatest("m0", "lo"), F.least("m1", "hi")
    at = lambda x: F.col("i0") + (F.col("i1") - F.col("i0")) * (x - F.col("m0")) / (F.col("m1") - F.col("m0"))
    return met.groupBy(*keys, "bin_idx").agg(F.sum((at(a) + at(z)) / 2 * (z - a)).alias("value"))


def nearest_bin(targets: DataFrame, bins: DataFrame, reach: float) -> DataFrame:
    """For each target (mz) the bin whose centre is nearest, within reach; ties to the smaller bin."""
    centre = bins.select("bin_idx", ((F.col("lo") + F.col("hi")) / 2).alias("centre"))
    near = centre.select("bin_idx", "centre", (F.col("centre") - reach).alias("lo"), (F.col("centre") + reach).alias("hi"))
    met = range_join(targets, near)
    best = F.min(F.struct(F.abs(F.col("centre") - F.col("mz")).alias("d"), "bin_idx")).alias("m")
    return met.groupBy("idx", "mz").agg(best).select("idx", F.col("m.bin_idx").alias("bin_idx"), F.col("m.d").alias("distance"))


def soft_terms(peaks: DataFrame, centres: DataFrame) -> DataFrame:
    """The columns of peaks, bin_idx and value: exp(-((mz - mu) / sigma)^2 / 2) * intensity; terms with an exponent below -10 are dropped, which bounds the range."""
    reach = (20.0**0.5) * F.col("sigma")
    spans = centres.select("bin_idx", "mu", "sigma", (F.col("mu") - reach).alias("lo"), (F.col("mu") + reach).alias("hi"))
    d = (F.col("mz") - F.col("mu")) / F.col("sigma")
    met = range_join(peaks, spans)
    return met.filter(-0.5 * d * d >= -10).select(*peaks.columns, "bin_idx", (F.exp(-0.5 * d * d) * F.col("intensity")).alias("value"))


def soft_bin(peaks: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the terms of each key and bin that has one."""
    return soft_terms(peaks, centres).groupBy(*keys, "bin_idx").agg(F.sum("value").alias("value"))


def soft_features(peaks: DataFrame, centres: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The soft bins 0 to n - 1 as one array per key that has a term, zeros where there is none. A key's sums are added up at once, for some tens of bins."""
    sums = soft_terms(dealt(peaks, keys, 2), centres).groupBy(*keys).agg(*[F.sum(F.when(F.col("bin_idx") == i, F.col("value"))).alias(f"_{i}") for i in range(n)])
    return sums.select(*keys, F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i in range(n)]).alias("features"))


def merge_above(flags: DataFrame) -> DataFrame:
    """Bins (bin_idx, lo, hi, ok) whose flag holds, runs of neighbours merged into one (lo, hi)."""
    w = Window.orderBy("bin_idx")
    out = (
        flags.withColumn("_new", F.when(F.col("ok") & ~F.coalesce(F.lag("ok").over(w), F.lit(False)), 1).otherwise(0))
        .withColumn("island", F.sum("_new").over(w))
    )
    return out.filter("ok").groupBy("island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def pivot_features(long: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, bin_idx, value) as one array per key, zeros where there is no value."""
    wide = long.groupBy(*keys).pivot("bin_idx", list(range(n))).agg(F.first("value"))
    return wide.select(*keys, F.array(*[F.coalesce(F.col(f"`{i}`"), F.lit(0.0)) for i in range(n)]).alias("features"))
