"""Operations inside a spectrum: picking peaks over local noise, and isotope chains with charges.

A spectrum's peaks are as many as its instrument has points, so one spectrum fits a task; spectra are grouped and dealt out by Spark.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACING = 1.00335


def local_noise(points: DataFrame, key: str = "spectrum_id", width: float = 50.0, steps: int = 32) -> DataFrame:
    """key, window, noise: the median intensity over an m/z window and the windows beside it, read off a histogram of `steps` steps.

    Histograms are sums (a row for each window and step that occurs), so they merge before they are shuffled; no window is sorted. A step is a
    share of the spectrum's largest intensity; the noise is the upper edge of the step that holds the median.
    """
    top = points.groupBy(key).agg(F.max("intensity").alias("_top"))
    cell = F.floor(F.col("mz") / width)
    step = F.least(F.lit(steps - 1), F.floor(F.col("intensity") * steps / F.col("_top")).cast("int"))
    counts = points.join(top.filter("_top > 0"), key).groupBy(key, cell.alias("window"), step.alias("step"), "_top").agg(F.count("*").alias("n"))
    near = counts.select(key, "_top", "step", "n", F.explode(F.array(*[F.col("window") + k for k in (-1, 0, 1)])).alias("window"))
    own = counts.select(key, "window").distinct()
    merged = near.join(own, [key, "window"], "left_semi").groupBy(key, "window", "_top", "step").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(key, "window")
    upto = merged.withColumns({"upto": F.sum("n").over(w.orderBy("step")), "all": F.sum("n").over(w)})
    return upto.filter(2 * F.col("upto") >= F.col("all")).groupBy(key, "window").agg((F.min((F.col("step") + 1) * F.col("_top")) / steps).alias("noise"))


def pick_peaks(points: DataFrame, key: str = "spectrum_id", ratio: float = 3.0, width: float = 50.0, steps: int = 32) -> DataFrame:
    """Points (key, mz, intensity, ...) with noise, that are above both neighbours and at least `ratio` times the noise of their window.

    Of equal neighbours the first in m/z counts; the ends of a spectrum have one neighbour. Points without intensity are never peaks.
    """
    w = Window.partitionBy(key).orderBy("mz", "intensity")
    before, after = F.coalesce(F.lag("intensity").over(w), F.lit(0.0)), F.coalesce(F.lead("intensity").over(w), F.lit(0.0))
    top = points.withColumn("_top", (F.col("intensity") > before) & (F.col("intensity") >= after)).filter("_top").drop("_top")
    out = top.withColumn("window", F.floor(F.col("mz") / width)).join(local_noise(points, key, width, steps), [key, "window"])
    return out.filter(F.col("intensity") >= ratio * F.col("noise")).drop("window")


def followed(mz: np.ndarray, step: float, tol: float) -> np.ndarray:
    """Whether a peak stands `step` within `tol` after each one, in m/z ascending."""
    return np.searchsorted(mz, mz + step - tol) < np.searchsorted(mz, mz + step + tol, side="right")


def isotope_chains(mz: np.ndarray, intensity: np.ndarray, charges: int = 3, spacing: float = SPACING, tol: float = 0.002) -> list[tuple[int, list[int]]]:
    """(charge, places) of the chains in one spectrum, its peaks ordered by m/z.

    A chain has three peaks or more, each `spacing` / charge after the one before within `tol` (the nearest of several), with intensities
    that do not rise from the second on. Every peak may begin a chain of every charge; each peak goes to one chain: chains are taken by
    length, then summed intensity, then charge, then place, without the peaks that are taken; what is left of a chain counts if it is three peaks still.
    """
    at, height = mz.tolist(), intensity.tolist()

    def chain(start: int, z: int, free: list[bool]) -> list[int]:
        out = [start]
        while True:
            want = at[out[-1]] + spacing / z
            lo, hi = bisect_left(at, want - tol), bisect_right(at, want + tol)
            near = [i for i in range(max(lo, out[-1] + 1), hi) if free[i] and (len(out) < 2 or height[i] <= height[out[-1]])]
            if not near:
                return out
            out.append(near[0] if len(near) == 1 else min(near, key=lambda i: (abs(at[i] - want), i)))

    free = [True] * len(at)
    starts = [(i, z) for z in range(1, charges + 1) for i in np.flatnonzero(followed(mz, spacing / z, tol)).tolist()]
    rank = lambda c, i, z: (-len(c), -float(intensity[c].sum()), z, i)
    tries = {}
    for k in starts:
        c = chain(*k, free)
        if len(c) > 2:
            tries[k] = c, rank(c, *k)
    taken = []
    while tries:
        best = min(tries, key=lambda k: tries[k][1])
        taken.append((best[1], tries.pop(best)[0]))
        for i in taken[-1][1]:
            free[i] = False
        for k in [k for k, (c, _) in tries.items() if not all(free[i] for i in c)]:
            c = chain(*k, free) if free[k[0]] else []
            if len(c) > 2:
                tries[k] = c, rank(c, *k)
            else:
                del tries[k]
    return taken


def hopeful(rows: pa.ListArray, charges: int, tol: float, spacing: float = SPACING) -> list[int]:
    """The spectra of a batch that can have a chain: for some charge two peaks at least are followed by another.

    Masses of a batch are laid behind one another, each spectrum beyond the reach of the one before, so all are looked up at once. Places
    so far out are rounded, so the tolerance is a little wider here; what is not a chain is left to `isotope_chains`.
    """
    sizes = np.diff(rows.offsets.to_numpy())
    mz = rows.flatten().field("mz").to_numpy(zero_copy_only=False)
    if not len(mz) or not np.isfinite(mz).all():
        return list(range(len(rows)))
    of = np.repeat(np.arange(len(rows)), sizes)
    lo = mz.min()
    apart = mz.max() - lo + 2 * (spacing + tol) + 1.0
    laid = mz - lo + of * apart
    slack = tol + 4 * np.spacing(laid[-1] + apart) + 4 * np.spacing(np.abs(mz).max() + spacing)
    some = np.zeros(len(rows), bool)
    for z in range(1, charges + 1):
        some |= np.bincount(of[followed(laid, spacing / z, slack)], minlength=len(rows)) > 1
    return np.flatnonzero(some).tolist()


def deisotoped(peaks: DataFrame, key: str = "spectrum_id", charges: int = 3, tol: float = 0.002) -> DataFrame:
    """key, idx, charge, first (idx of the chain's first peak), place (0 for the first) of the peaks that are in a chain (isotope_chains).

    A spectrum is gathered to one row, of which a task works on many at a time.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.column("peaks"), []
            for i in hopeful(rows, charges, tol):
                own = rows[i].values
                mz, idx, intensity = (own.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                out += [(i, idx[at], z, idx[c[0]], place) for z, c in isotope_chains(mz, intensity, charges, tol=tol) for place, at in enumerate(c)]
            at, *columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True))],
                names=[key, "idx", "charge", "first", "place"],
            )

    kind = peaks.schema[key].dataType.simpleString()
    rows = peaks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("mz", F.col("idx").cast("long").alias("idx"), "intensity"))).alias("peaks"))
    return rows.filter(F.size("peaks") > 2).mapInArrow(found, f"{key} {kind}, idx long, charge int, first long, place int")
