"""Pixels and polygons: slices, boxes, rasters, coverage, blobs, coordinates."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraline.functions import stats
from spectraline.sources import sinks

Matrix = tuple[tuple[float, float, float], tuple[float, float, float]]


def region_slice(pixels: DataFrame, y: tuple[int, int], x: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """Pixels in half-open ranges; negative ends count from the far edge; an empty range is an error."""
    for name, (lo, hi), size in (("y", y, shape[0]), ("x", x, shape[1])):
        lo, hi = (v + size if v < 0 else v for v in (lo, hi))
        if lo >= min(hi, size):
            raise ValueError(f"empty slice of {name}: {lo}..{hi}")
        pixels = pixels.filter(F.col(name).between(lo, hi - 1))
    return pixels


def bounding_box(pixels: DataFrame) -> DataFrame:
    return pixels.agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


def above_share(image: DataFrame, share: float) -> DataFrame:
    """on_: whether v exceeds a share of the image's maximum (one row, broadcast)."""
    top = image.agg(F.max("v").alias("_top"))
    return image.join(F.broadcast(top)).withColumn("on_", F.col("v") > F.col("_top") * share)


def presence(image: DataFrame, divisor: float = 100) -> DataFrame:
    mean = image.agg((F.avg(F.abs("v")) / divisor).alias("_limit"))
    return image.join(F.broadcast(mean)).filter("abs(v) > _limit").drop("_limit")


def ion_image(peaks: DataFrame, mz: float, tol: float) -> DataFrame:
    """Sum of intensity in [mz - tol, mz + tol] for every pixel with a spectrum; 0 where no peak is in the window."""
    return (
        peaks.groupBy("y", "x")
        .agg(F.coalesce(F.sum(F.when(F.col("mz").between(mz - tol, mz + tol), F.col("intensity"))), F.lit(0.0)).alias("value"))
    )


def points(ring: Column) -> Column:
    return F.transform(
        F.split(ring, r"\s*,\s*"),
        lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")),
    )


def wkt_polygon(column: str) -> Column:
    """Vertices of a POLYGON with a single ring."""
    return points(F.regexp_extract(F.col(column), r"\(\(([^()]*)\)\)", 1))


def wkt_rings(column: str) -> Column:
    """All rings of a POLYGON or MULTIPOLYGON, holes among them, each as its vertices; none of an empty geometry."""
    return F.transform(F.regexp_extract_all(F.col(column), F.lit(r"\(([^()]+)\)"), F.lit(1)), points)


def affine(geometry: Column, m: Matrix) -> Column:
    (a, b, c), (d, e, f) = m
    return F.transform(geometry, lambda p: F.struct((a * p["x"] + b * p["y"] + c).alias("x"), (d * p["x"] + e * p["y"] + f).alias("y")))


def compose(*steps: Matrix) -> Matrix:
    """One matrix that applies the steps in order."""
    total: Matrix = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0))
    for (a, b, c), (d, e, f) in steps:
        (p, q, r), (s, t, u) = total
        total = ((a * p + b * s, a * q + b * t, a * r + b * u + c), (d * p + e * s, d * q + e * t, d * r + e * u + f))
    return total


def raster_runs(annotations: DataFrame, keys: list[str], scale: int = 1) -> DataFrame:
    """(keys, y, x0, x1): the pixels x0 <= x < x1 of row y whose centre is inside, by the even-odd rule over all edges.

    Column rings (so holes and several parts are right), or geometry for one ring. Edges are rows; an edge meets the scan lines it spans, the
    crossings of a line are sorted, and the pixels between the first and the second, the third and the fourth, and so on are a run. So the cost
    is edges x lines, no pixel is tested, and the lines of a large polygon are work for many tasks. With scale, pixels are that many times finer.
    """
    rings = F.col("rings") if "rings" in annotations.columns else F.array("geometry")
    ring = annotations.select(*keys, F.explode(rings).alias("ring"))
    edge = ring.select(*keys, F.explode(F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    to = lambda p, c: (F.col(f"e.{p}.{c}") * scale).alias(p + c)
    edge = edge.select(*keys, *[to(p, c) for p in "ab" for c in "xy"]).filter("ay <> by")
    first = lambda v: F.ceil(v - 0.5).cast("long")
    lines = edge.withColumns({"y": first(F.least("ay", "by")), "_end": first(F.greatest("ay", "by"))}).filter("y < _end")
    lines = lines.withColumn("y", F.explode(F.sequence("y", F.col("_end") - 1)))
    crossing = (F.col("bx") - F.col("ax")) * (F.col("y") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    row = lines.select(*keys, "y", crossing.alias("c")).groupBy(*keys, "y").agg(F.sort_array(F.collect_list("c")).alias("c"))
    pair = F.transform(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2)), lambda i: F.struct(first(F.get("c", i)).alias("x0"), first(F.get("c", i + 1)).alias("x1")))
    return row.filter(F.size("c") > 1).select(*keys, "y", F.explode(pair).alias("r")).select(*keys, "y", "r.x0", "r.x1").filter("x0 < x1")


def rasterize(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x) of the pixels whose centre is inside the polygon (raster_runs)."""
    return raster_runs(annotations, keys).select(*keys, "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))


def coverage(annotations: DataFrame, keys: list[str], s: int = 16) -> DataFrame:
    """Share of each pixel's s * s sub-pixels that lie inside the polygon; runs of sub-pixels are cut at pixels, not spread."""
    pixel = lambda c: F.floor(c / s)
    part = raster_runs(annotations, keys, s).withColumn("x", F.explode(F.sequence(pixel(F.col("x0")), pixel(F.col("x1") - 1))))
    inside = F.least("x1", (F.col("x") + 1) * s) - F.greatest("x0", F.col("x") * s)
    return part.groupBy(*keys, pixel(F.col("y")).alias("y"), "x").agg((F.sum(inside) / (s * s)).alias("share"))


def onehot(rasters: DataFrame, annotations: DataFrame, terms: list) -> DataFrame:
    """term, its place in `terms`, y, x of all pixels under a term; an error if the annotations' terms are not those asked for."""
    found = {r.term for r in annotations.select("term").distinct().collect()}  # a vocabulary
    if found != set(terms):
        raise ValueError(f"terms differ: {sorted(map(str, found ^ set(terms)))}")
    place = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term")) - 1
    return rasters.select("term", place.cast("int").alias("pos"), "y", "x").distinct()


def first_class(annotations: DataFrame, sets: DataFrame) -> DataFrame:
    """annotations (ann_id, term) with the first class whose set holds the term; sets: (term, class). An unknown term is an error."""
    best = sets.groupBy("term").agg(F.min("class").alias("class"))
    out = annotations.join(best, "term", "left")
    unknown = out.filter("class is null").select("term").first()
    if unknown:
        raise ValueError(f"no class for term {unknown.term}")
    return out


def background(region: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """Pixels of the region under no class, as class `name`, which no class may have."""
    if classes.filter(F.col("class") == name).first():
        raise ValueError(f"there is a class {name} already")
    return region.join(classes.select("y", "x").distinct(), ["y", "x"], "left_anti").withColumn("class", F.lit(name))


def registered(pixels: DataFrame, start: tuple[float, float], scale: float, shape: tuple[int, int]) -> DataFrame:
    """pixels at (y - start) / scale; an error if one falls outside the shape."""
    out = pixels.withColumns({"y": map_index(F.col("y"), start[0], scale), "x": map_index(F.col("x"), start[1], scale)})
    box = bounding_box(out).first()
    if box.y0 is not None and (box.y0 < 0 or box.x0 < 0 or box.y1 > shape[0] or box.x1 > shape[1]):
        raise ValueError(f"pixels fall outside {shape}: {tuple(box)}")
    return out


def _local_blobs(tile: int):
    """Blobs inside one tile, which holds tile * tile pixels at most."""

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        code = (rows.y.to_numpy() * (1 << 32) + rows.x.to_numpy()).tolist()
        up = {c: c for c in code}

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for c in code:
            for step in (1, (1 << 32) - 1, 1 << 32, (1 << 32) + 1):
                if c + step in up:
                    a, b = root(c), root(c + step)
                    up[max(a, b)] = min(a, b)
        return pd.DataFrame({"y": rows.y, "x": rows.x, "blob": [root(c) for c in code]})

    return label


def connected(links: DataFrame) -> DataFrame:
    """(id, least): the least id reachable over links (a, b), by least labels and label jumps: the rounds grow with the logarithm of a component."""
    edges = sinks.stage(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = sinks.stage(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("least")))
    while True:
        seen = edges.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("least").alias("m"))
        near = label.join(seen, "id").select("id", F.col("least").alias("old"), F.least("least", "m").alias("c"))
        step = (
            near.join(label.select(F.col("id").alias("c"), F.col("least").alias("j")), "c", "left")
            .select("id", F.least("c", F.coalesce("j", "c")).alias("least"), "old")
        )
        step = sinks.stage(step)
        label = step.select("id", "least")
        if step.filter("least <> old").isEmpty():
            return label


def components(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """8-connected blobs: (y, x, blob), blob being the least y * 2^32 + x in it.

    Blobs are found inside tiles; where pixels touch across a border their tiles' blobs are linked, and the links' components name the whole blobs.
    """
    spot = pixels.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    by = [F.floor(F.col(c) / tile) for c in ("y", "x")]
    local = sinks.stage(spot.groupBy(*by).applyInPandas(_local_blobs(tile), "y long, x long, blob long"))
    rim = local.filter(" or ".join(f"pmod({c}, {tile}) in (0, {tile - 1})" for c in ("y", "x")))
    around = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    to = (
        rim.select(F.col("blob").alias("a"), F.explode(around).alias("o"), "y", "x")
        .select("a", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    )
    links = to.join(rim.select("y", "x", F.col("blob").alias("b")), ["y", "x"]).filter("a <> b").select("a", "b")
    whole = connected(links)
    return local.join(whole.withColumnRenamed("id", "blob"), "blob", "left").select("y", "x", F.coalesce("least", "blob").alias("blob"))


def class_components(pixels: DataFrame, classes: list[str], tile: int = 256) -> DataFrame:
    """8-connected blobs of each class of pixels (class, y, x): (class, y, x, in_class, number), blobs numbered from 1 in a class and over all classes in turn.

    A pixel may be of several classes. Classes are laid side by side, far apart, so one search serves all. Blobs follow their least pixel, by
    y, then x, and are numbered by running sums over value buckets (functions/stats.py), so no task has all of them.
    """
    far = 1 << 24
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    laid = pixels.select((F.col("y") + (place - 1) * far).alias("y"), "x")
    blobs = components(laid, tile)
    place = F.floor(F.col("y") / far)
    blobs = sinks.stage(blobs.select(place.cast("int").alias("place"), (F.col("y") - place * far).alias("y"), "x", "blob"))
    each = blobs.groupBy("place", "blob").agg(F.lit(1).alias("n"))
    own = stats.prefix_sums(each, ["place"], "blob", ["n"])
    before = each.groupBy("place").agg(F.count("*").alias("m"))
    before = before.select("place", F.coalesce(F.sum("m").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lift"))  # over classes
    names = own.join(before, "place").select("blob", (F.col("n_before") + 1).alias("in_class"), (F.col("n_before") + 1 + F.col("lift")).alias("number"))
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("place") + 1)
    return blobs.join(names, "blob").select(name.alias("class"), "y", "x", F.col("in_class").cast("long").alias("in_class"), F.col("number").cast("long").alias("number"))


def template_matrix(top_left: tuple[float, float], scale: float, size: tuple[float, float], turns: int, flip_lr: bool = False, flip_ud: bool = False, crop: tuple[float, float] = (0, 0)) -> Matrix:
    """From overlay to template coordinates: to the match's top left (x, y), down by scale, about the centre of the match of size (width, height)
    by quarter turns and flips, and to the crop's start (x, y)."""
    cx, cy = size[0] / scale / 2, size[1] / scale / 2
    cos, sin = ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))[turns % 4]
    half = (cx, cy) if turns % 2 == 0 else (cy, cx)
    return compose(
        offset(-top_left[0], -top_left[1]), ((1 / scale, 0.0, 0.0), (0.0, 1 / scale, 0.0)), offset(-cx, -cy), ((cos, -sin, 0.0), (sin, cos, 0.0)),
        ((-1.0 if flip_lr else 1.0, 0.0, 0.0), (0.0, -1.0 if flip_ud else 1.0, 0.0)), offset(crop[0] + half[0], crop[1] + half[1]))


def offset(x: float, y: float) -> Matrix:
    return ((1.0, 0.0, float(x)), (0.0, 1.0, float(y)))


def box_registration(src: tuple, dst: tuple) -> tuple[float, float, Matrix]:
    """Scales in y and x between two boxes (y0, y1, x0, x1), and the matrix that lays src on dst with the scale of dst's longer side."""
    sy, sx = (dst[1] - dst[0]) / (src[1] - src[0]), (dst[3] - dst[2]) / (src[3] - src[2])
    f = sx if dst[3] - dst[2] > dst[1] - dst[0] else sy
    return sy, sx, compose(offset(-src[2], -src[0]), ((f, 0.0, 0.0), (0.0, f, 0.0)), offset(dst[2], dst[0]))


def map_index(v: Column, start: float, scale: float) -> Column:
    return F.floor((v - start) / scale)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def orient(y: Column, x: Column, k: Column, flip_ud: Column, flip_lr: Column, height: Column, width: Column) -> tuple[Column, Column]:
    """Source coordinates of (y, x) in an image that was turned k quarter turns, then flipped; height and width are the turned image's."""
    y, x = F.when(flip_ud, height - 1 - y).otherwise(y), F.when(flip_lr, width - 1 - x).otherwise(x)
    q = F.pmod(k, F.lit(4))
    oy = F.when(q == 0, y).when(q == 1, x).when(q == 2, height - 1 - y).otherwise(width - 1 - x)
    ox = F.when(q == 0, x).when(q == 1, height - 1 - y).when(q == 2, width - 1 - x).otherwise(y)
    return oy, ox


def merge(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts with their number as `dataset`; different columns are an error."""
    out = None
    for i, p in enumerate(parts):
        if p.columns != parts[0].columns:
            raise ValueError("datasets with different attributes")
        p = p.withColumn("dataset", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def merge_regions(labels: list[DataFrame], bins: list[DataFrame]) -> DataFrame:
    """Label tables (region, ann_idx from 1, ...) as one, annotations numbered after those of the regions before; different bins are an error."""
    for b in bins[1:]:
        if b.count() != bins[0].count() or not b.exceptAll(bins[0]).isEmpty():
            raise ValueError("regions with different bins")
    out = merge(labels).drop("dataset")
    w = Window.orderBy("region").rowsBetween(Window.unboundedPreceding, -1)  # over regions
    first = out.groupBy("region").agg(F.max("ann_idx").alias("m")).select("region", F.coalesce(F.sum("m").over(w), F.lit(0)).alias("first"))
    return out.join(first, "region").withColumn("ann_idx", F.col("ann_idx") + F.col("first")).drop("first").select(*out.columns)


def fticr_last(lo: float, n: int, f: float, stop: float) -> float:
    """The last of n bins' upper edges, or the first edge above `stop`."""
    at = lo
    for _ in range(n):
        at += f * at * at
        if at > stop:
            break
    return at


def fticr_factor(lo: float, hi: float, n: int, tol: float = 1e-9) -> float:
    """The least f, but for rounding, such that n bins with widths f * mz^2 lead from lo to at least hi.

    A closed-form guess is widened until it brackets f, so few passes over the n edges are needed.
    """
    guess, spread = (1 / lo - 1 / hi) / max(n - math.log(hi / lo), 0.5), 1e-6
    low, high = guess * (1 - spread), guess * (1 + spread)
    while fticr_last(lo, n, low, hi) >= hi:
        spread *= 8
        high, low = low, guess / (1 + spread)
    while fticr_last(lo, n, high, hi) < hi:
        spread *= 8
        low, high = high, guess * (1 + spread)
    while high - low > tol * 1e-3 * high:
        f = (low + high) / 2
        low, high = (low, f) if fticr_last(lo, n, f, hi) >= hi else (f, high)
    return high


@lru_cache(8)
def fticr_edges(lo: float, f: float, n: int) -> np.ndarray:
    edges, at = np.empty(n + 1), lo
    for i in range(n):
        edges[i] = at
        at += f * at * at
    edges[n] = at
    return edges


def fticr_index(peaks: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """bin_idx of each peak among n bins whose widths grow with mz^2. Each worker makes the edges from three numbers and looks peaks up in them."""
    f = fticr_factor(lo, hi, n)

    @F.pandas_udf("long")
    def index(mz: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(fticr_edges(lo, f, n), mz.to_numpy(), side="right") - 1)

    return peaks.withColumn("bin_idx", index("mz")).filter(F.col("bin_idx").between(0, n - 1))


def pad_image(image: DataFrame, height: int, width: int, fill: float, spark: SparkSession) -> DataFrame:
    grid = (
        spark.range(height)
        .select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"))
    )
    return grid.join(image, ["y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(fill)))
