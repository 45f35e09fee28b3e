"""Trees of many models, grown together level by level: extra-trees, random forests and decision trees for targets 0/1.

A row has id, features (array), targets (array of 0/1; a model learns one of them), weight, and folds (array; a model leaves out the
rows of some). Whatever is to be fitted, all trees of all forests, folds, settings and permuted targets, takes its next level in the
same two jobs: tasks lay the rows of a block along all trees and sum, for each tree and open node, what decides its cut; the sums of
some trees meet in one group, which answers with a cut a node. Jobs are as many as levels, not as fits.

Extra-trees draw, for each of some features of a node, a cut uniformly between its least and greatest value there (first job), and
keep the best (second job). Forests and single trees take the best of at most `BINS` cuts a feature, its quantiles over all rows (one
job). Forests weigh rows by Poisson numbers of mean 1, made from the row's id. Cuts are best by the decrease of the Gini impurity;
of equal ones the first feature's first. Sums are added in the order of partitions, so reruns agree.

The driver holds and broadcasts the trees, whose size is a parameter (`trees`, `depth`) and checked (`MOST_NODES`); rows stay in their
tasks. A forest holds its smaller settings: fewer trees are its first ones, lower depths its upper levels, so a grid over both is
grown once. Null features are not supported; a null target or weight leaves a row out of learning and scoring; a node without a cut
that helps is a leaf; without any row to learn from, scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 16
MOST_NODES = 1 << 23
#: Numbers that the sums of one job may have in a task.
MOST_SUMS = 1 << 25
#: Numbers of one task, and tasks, that meet in one group: its trees' sums.
MOST_MERGED, MERGED = 1 << 15, 128
#: Rows that are laid along the trees at a time: ROWS, or those that have VALUES values, if they are fewer.
ROWS, VALUES = 10_000, 640_000
#: Rows whose counts of 4 bits fit when added up, where the bytes of such counts are in a word, and the rank that no value has.
RUN, NIBBLES, BEYOND = 15, np.uint64(0x0F0F0F0F0F0F0F0F), (1 << 16) - 1
#: Whole weights below this are counted, others are added up as doubles.
MOST_COUNTED = 1 << 20
#: Cuts a feature up to which extra-trees of rows without weights are grown on bits: sorting all features costs more. Rows at either end of a feature, in
#: which the ends of most nodes are found.
FEW, EXTREMES = 64, 128


@dataclass(frozen=True)
class Growth:
    """A forest to grow. `out` and `test` are (slot, value) pairs of folds: rows with one of `out` are not learnt from, those with all of `test` are scored."""

    kind: str = "extra"
    trees: int = 10
    depth: int = 4
    features: str = "sqrt"
    out: tuple = ()
    test: tuple = ()
    use: tuple | None = None
    target: int = 0
    seed: int = 11


@dataclass
class Tree:
    """Nodes in the order they were made: feature (-1: leaf), cut, first of the two children, weights of both classes, gain, depth."""

    growth: int
    number: int
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    weight: list = field(default_factory=lambda: [(0.0, 0.0)])
    gain: list = field(default_factory=lambda: [0.0])
    depth: list = field(default_factory=lambda: [0])
    open: list = field(default_factory=lambda: [0])


@dataclass
class Packed:
    """All trees in arrays, with the open nodes of this level and the features that each of them tries."""

    first: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    place: np.ndarray
    tries: list
    cuts: list


def table(rows: DataFrame, targets: tuple = ("target",), folds: tuple = (), weight: str | None = None) -> DataFrame:
    """The columns that growing reads, from id, features and the columns named."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return rows.select(
        "id", F.col("features").cast("array<double>").alias("features"), F.array(*[F.col(t).cast("int") for t in targets]).alias("targets"),
        w.alias("weight"), F.array(*[F.col(f).cast("int") for f in folds]).cast("array<int>").alias("folds"), F.xxhash64("id").alias("mark"),
    )


def compact(rows: DataFrame) -> DataFrame:
    """rows of table(), a block of them a row, for grow() of extra-trees and tested(): each value is its rank among those of its feature in the block, in 16
    bits. What each pass over the rows reads is small then, and need not be taken apart and sorted again."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            values, ranks = zip(*(np.unique(x, return_inverse=True) for x in b.x.T), strict=True)
            ranks = np.stack(ranks).astype(np.uint16)
            order = ranks.argsort(axis=1, kind="stable")
            arrays = {
                "ranks": ranks, "extremes": np.stack([order[:, :EXTREMES], order[:, ::-1][:, :EXTREMES]]).astype(np.uint16), "sizes": np.array([len(x) for x in values], np.int32), "values": np.concatenate(values),
                "targets": b.y.astype(np.int32), "weight": b.w.astype(float), "folds": b.folds.astype(np.int32), "mark": b.mark,
            }
            columns = [pa.array([n], pa.int32()) for n in (b.n, b.wide)] + [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays.values()]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "wide", *arrays])

    return rows.mapInArrow(put, "n int, wide int, " + ", ".join(f"{c} binary" for c in ("ranks", "extremes", "sizes", "values", "targets", "weight", "folds", "mark")))


class Block:
    """Rows of an Arrow batch as arrays, or those that a row of compact() holds, of which x is made when it is asked for."""

    ranks, extremes, values = None, None, None

    def __init__(self, batch: pa.RecordBatch) -> None:
        def grid(name: str, kind: type) -> np.ndarray:
            column = batch.column(name)
            flat = column.flatten()
            return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, len(flat) // max(1, batch.num_rows))

        self.n, self.id = batch.num_rows, batch.column("id")
        self.x = grid("features", float)
        self.wide = self.x.shape[1]
        y = batch.column("targets")
        self.y = y.flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(self.n, len(y.flatten()) // max(1, self.n))
        self.w = batch.column("weight").fill_null(0.0).to_numpy(zero_copy_only=False)
        f = batch.column("folds").flatten().fill_null(-1)
        self.folds = f.to_numpy(zero_copy_only=False).reshape(self.n, len(f) // max(1, self.n))
        self.mark = batch.column("mark").to_numpy().view(np.uint64)

    @classmethod
    def compacted(cls, batch: pa.RecordBatch, row: int) -> Block:
        b = cls.__new__(cls)
        get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
        b.n, b.wide = batch.column("n")[row].as_py(), batch.column("wide")[row].as_py()
        b.ranks, b.values = get("ranks", np.uint16).reshape(b.wide, b.n), np.split(get("values", float), np.cumsum(get("sizes", np.int32))[:-1])
        b.extremes = get("extremes", np.uint16).reshape(2, b.wide, -1)
        b.y, b.folds = (get(name, np.int32).reshape(b.n, -1) for name in ("targets", "folds"))
        b.w, b.mark = get("weight", float), get("mark", np.uint64)
        return b

    @cached_property
    def x(self) -> np.ndarray:
        return np.stack([own[at] for own, at in zip(self.values, self.ranks, strict=True)]).T

    def having(self, pairs: tuple, every: bool) -> np.ndarray:
        out = np.full(self.n, every)
        for slot, value in pairs:
            out = (out & (self.folds[:, slot] == value)) if every else (out | (self.folds[:, slot] == value))
        return out

    def learnt(self, g: Growth) -> np.ndarray:
        return np.where(self.having(g.out, False) | (self.y[:, g.target] < 0), 0.0, self.w)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The rows of all batches, ROWS at most at a time, so that what a task holds does not grow with its batches."""
    for batch in batches:
        if "ranks" in batch.schema.names:
            yield from (Block.compacted(batch, row) for row in range(batch.num_rows))
            continue
        wide = len(batch.column("features").flatten()) // max(1, batch.num_rows)
        size = max(1, min(ROWS, VALUES // max(1, wide)))
        for first in range(0, batch.num_rows, size):
            yield Block(batch.slice(first, size))


def poisson(mark: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Poisson numbers of mean 1, one for each row and tree."""
    x = mark ^ np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    rates = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 12)]))
    return np.searchsorted(rates, u, side="right").astype(float)


def walked(x: np.ndarray, p: Packed, t: int, levels: int, rows: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The node of each row (or of some) in tree t at depth 0, 1, ... as far as levels."""
    rows = np.arange(len(x)) if rows is None else rows
    at = np.full(len(rows), p.first[t])
    yield at
    for _ in range(levels):
        f = p.feature[at]
        if (f < 0).all():
            yield at
            continue
        at = np.where(f < 0, at, p.left[at] + (x[rows, np.maximum(f, 0)] > p.cut[at]))
        yield at


def packed(trees: list[Tree], n: int = 0, growths: list[Growth] = ()) -> Packed:
    """The arrays of all trees; with the number of features, also what open nodes try."""
    first = np.cumsum([0, *(len(t.feature) for t in trees)])
    if first[-1] > MOST_NODES:
        raise ValueError(f"{first[-1]} nodes are more than trees that every task has may hold; grow fewer or lower trees")
    lift = np.repeat(first[:-1], np.diff(first))
    join = lambda name, kind: np.concatenate([np.asarray(getattr(t, name), kind) for t in trees]) if trees else np.zeros(0, kind)
    place = np.full(first[-1], -1)
    tries = []
    for k, t in enumerate(trees):
        place[first[k] + np.asarray(t.open, int)] = np.arange(len(t.open))
        tries.append(tried(growths[t.growth], t, n) if n else np.zeros((0, 0), int))
    return Packed(first, join("feature", int), join("cut", float), join("left", int) + lift, place, tries, [None] * len(trees))


def tried(g: Growth, t: Tree, n: int) -> np.ndarray:
    """The features that each open node tries: all, or about the root of their number, drawn anew for each node."""
    use = np.arange(n) if g.use is None else np.asarray(g.use)
    if g.features == "all" or g.kind == "tree":
        return np.tile(use, (len(t.open), 1))
    k = max(1, int(np.sqrt(len(use))))
    drawn = [np.random.default_rng((g.seed, t.number, node)).permutation(len(use))[:k] for node in t.open]
    return use[np.sort(np.array(drawn, int).reshape(len(t.open), k), axis=1)]


def quantile_cuts(rows: DataFrame, n: int) -> np.ndarray:
    """At most BINS - 1 cuts for each feature, padded with infinity: features x cuts numbers on the driver."""
    at = [i / BINS for i in range(1, BINS)]
    found = rows.select(F.posexplode("features").alias("f", "x")).groupBy("f").agg(F.percentile_approx("x", at, 1000).alias("q")).collect()
    out = np.full((n, BINS - 1), np.inf)
    for f, q in found:
        own = np.unique(q)
        out[f, : len(own)] = own
    return out


def best_cuts(left: np.ndarray, total: np.ndarray, tries: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each node feature, cut, gain and the weights of both classes left and right, from sums left of every cut (node, feature, cut, class)."""
    right = total[:, None, None, :] - left
    with np.errstate(invalid="ignore", divide="ignore"):
        side = lambda s: (s**2).sum(-1) / s.sum(-1)
        gain = side(left) + side(right) - side(total)[:, None, None]
    gain = np.where((left.sum(-1) > 0) & (right.sum(-1) > 0), gain, -np.inf).reshape(len(total), -1)
    best = gain.argmax(1)
    node, k, c = np.arange(len(total)), best // cuts.shape[2], best % cuts.shape[2]
    return np.column_stack([tries[node, k], cuts[node, k, c], gain[node, best], left[node, k, c], right[node, k, c]]).astype(float)


class Ordered:
    """The values of a block as their ranks in it, which 16 bits hold: a cut asks for no more. A last row is beyond every cut."""

    def __init__(self, x: np.ndarray) -> None:
        by = np.ascontiguousarray(x.T)
        order = by.argsort(axis=1)
        self.values = np.take_along_axis(by, order, 1)
        places = np.tile(np.arange(len(x)), (len(by), 1))
        places[:, 1:][self.values[:, 1:] == self.values[:, :-1]] = 0
        np.put_along_axis(by_rank := np.empty_like(order), order, np.maximum.accumulate(places, axis=1), 1)
        self.ranks = np.full((len(x) + 1, len(by)), BEYOND, np.uint16)
        self.ranks[:-1] = by_rank.T

    def below(self, asked: list[tuple], size: int) -> np.ndarray:
        """For cuts as by_feature() sorts them, the number of values that are not above: ranks less than it are left of the cut."""
        out = np.full(size, BEYOND, np.uint16)
        for f, at, cuts in asked:
            out[at] = np.searchsorted(self.values[f], cuts, side="right")
        return out


class Bits:
    """Rows of a block that are not above cuts, or that nodes have, as bits, 64 rows a word."""

    def __init__(self, b: Block) -> None:
        self.n, self.words, self.values, self.extremes = b.n, -(-b.n // 64), b.values, b.extremes
        self.columns = np.ascontiguousarray(b.x.T) if b.ranks is None else b.ranks

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.words * 64), bool)
        out[:, : self.n] = rows
        return np.packbits(out, axis=1).view(np.uint64)

    def below(self, asked: list[tuple], size: int) -> np.ndarray:
        """For cuts as by_feature() sorts them, the rows that are not above."""
        out = np.zeros((size, self.words), np.uint64)
        for f, at, cuts in asked:
            if self.values is not None:  # the last rank that is not above
                cuts = np.searchsorted(self.values[f], cuts, side="right").astype(np.int32) - 1
                cuts, at = cuts.clip(0).astype(np.uint16)[cuts >= 0], at[cuts >= 0]
            for i in range(0, len(at), 64):
                out[at[i : i + 64]] = self.of(self.columns[f] <= cuts[i : i + 64, None])
        return out

    def ends(self, f: int, rows: np.ndarray) -> tuple[float, float]:
        """The least and the greatest value of a feature in some rows."""
        some = self.columns[f].take(rows)
        if not len(some):
            return np.inf, -np.inf
        return (some.min(), some.max()) if self.values is None else tuple(self.values[f][[some.min(), some.max()]])

    def ranges(self, nodes: np.ndarray, tries: np.ndarray, known: dict | None) -> np.ndarray:
        """The least and the greatest value, in the rows of each node, of the features that it tries; known: those of features, if nodes are the same again."""
        out, there = np.empty((2, *tries.shape)), np.unpackbits(nodes.view(np.uint8), axis=1).view(bool)
        left = np.ones(tries.shape, bool)
        if self.extremes is not None and known is None:
            rows = self.extremes[:, tries]
            own = there.ravel().take(rows + (np.arange(len(nodes)) * there.shape[1])[:, None, None])
            at = np.arange(own.size // own.shape[-1]) * own.shape[-1] + own.argmax(axis=-1).ravel()
            left = ~own.ravel().take(at).reshape(out.shape).all(axis=0)
            out[:] = self.joined.take(self.lift[tries] + self.columns[tries, rows.ravel().take(at).reshape(out.shape)])
        of: dict[int, np.ndarray] = {}
        for k, j in zip(*(x.tolist() for x in left.nonzero()), strict=True):
            f = int(tries[k, j])
            if known is None or f not in known:
                if k not in of:
                    of[k] = np.flatnonzero(there[k])
                found = self.ends(f, of[k])
                if known is not None:
                    known[f] = found
            out[:, k, j] = found if known is None else known[f]
        out[0] = np.where(np.isnan(out[1]), out[1], out[0])
        return out

    @cached_property
    def joined(self) -> np.ndarray:
        return np.concatenate(self.values)

    @cached_property
    def lift(self) -> np.ndarray:
        return np.cumsum([0, *map(len, self.values)])[:-1]


def open_bits(p: Packed, t: int, below: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The rows of each open node of tree t, from those that the tree learns from, for both classes: node, class, word."""
    here = {p.first[t]: classes}
    for node in range(p.first[t], p.first[t + 1]):
        if p.feature[node] >= 0:
            own, left = here.pop(node), p.left[node]
            here[left], here[left + 1] = own & below[node], own & ~below[node]
    return np.stack([here[node] for node in np.flatnonzero(p.place[p.first[t] : p.first[t + 1]] >= 0) + p.first[t]])


def by_feature(features: np.ndarray, cuts: np.ndarray) -> list[tuple]:
    """Feature, places and values of the cuts of each feature; of -1 there are none."""
    order = np.argsort(features, kind="stable")
    ends = np.flatnonzero(np.diff(features[order], append=-2)) + 1
    each = [order[a:z] for a, z in zip([0, *ends], ends, strict=False)]
    return [(int(features[at[0]]), at, cuts[at]) for at in each if features[at[0]] >= 0]


def dealt(rows: np.ndarray, group: np.ndarray, weight: np.ndarray | None, groups: int, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of whole weights as columns of RUN rows of one group, the columns' groups, and the weight of each group.

    A row is there as often as its weight says, or, if weights are large, in the columns of its group for each binary digit of its weight;
    those of digit d are numbered d * groups + group. What is left of a column is the row `none`; without weights, each row is there once
    and a row of the group fills the column.
    """
    digits = 1 if weight is None else int(weight.max()).bit_length()
    if digits > 1 and weight.sum() <= 2 * len(rows):
        digits, often = 1, weight.astype(int)
        rows, group = np.repeat(rows, often), np.repeat(group, often)
    if digits > 1:
        exact = weight.astype(int)
        having = [np.flatnonzero(exact >> d & 1) for d in range(digits)]
        rows, group = np.concatenate([rows[i] for i in having]), np.concatenate([group[i] + d * groups for d, i in enumerate(having)])
    few = group.astype(np.uint8 if groups * digits <= 1 << 8 else np.uint16 if groups * digits <= 1 << 16 else int)
    size = np.bincount(few, minlength=groups * digits)
    columns = -(-size // RUN)
    first, before = np.cumsum(columns) - columns, np.cumsum(size) - size
    rows = rows.take(np.argsort(few, kind="stable"))
    of = np.repeat(np.arange(len(size)), columns)
    out = np.full(columns.sum() * RUN, none) if weight is not None else np.repeat(rows.take(before, mode="clip"), columns * RUN)
    out[np.arange(len(rows)) + np.repeat(first * RUN - before, size)] = rows
    return out.reshape(-1, RUN).T, of, (size.reshape(digits, groups) << np.arange(digits)[:, None]).sum(0)


def laid(table: np.ndarray, columns: np.ndarray, tries: np.ndarray, of: np.ndarray, whole: bool) -> np.ndarray:
    """What a table has for the rows of columns: row, column, feature; if nodes (of: the columns') try different features row, feature, column."""
    if whole:
        return table.take(columns, axis=0)
    return table.ravel().take((columns * table.shape[1])[:, None, :] + tries.T.take(of, axis=1))


def met(each: np.ndarray, of: np.ndarray, groups: int) -> np.ndarray:
    """Sums of columns (column, ...) added up by group, those of digit d times 2^d."""
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    sums, of = np.add.reduceat(each.reshape(len(of), -1).astype(float), starts, axis=0), of[starts]
    out = np.zeros((groups, sums.shape[1]))
    for d in range(of[-1] // groups + 1):
        own = of // groups == d
        out[of[own] - d * groups] += sums[own] * (1 << d)
    return out


def histograms(sums: np.ndarray, of: np.ndarray, groups: int) -> np.ndarray:
    """Counts for each group, feature and bin (the even ones, then the odd ones) from sums of columns, words with 4 bits a bin."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    nth = np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))
    starts = np.flatnonzero(nth % (RUN + 2) == 0)  # a byte holds the sums of RUN + 2 columns
    halves = np.stack([np.add.reduceat(sums & NIBBLES, starts, axis=0), np.add.reduceat((sums >> np.uint64(4)) & NIBBLES, starts, axis=0)], axis=-1)
    return met(halves.astype("<u8", copy=False).view(np.uint8), of[starts], groups)


def partial(growths: list[Growth], owners: list[tuple[int, int]], part: np.ndarray, held, bins: np.ndarray | None, drawn: bool, level: int):
    """Sums of one task: for extra-trees ranges, or, once cuts are drawn, weights left of them; for others histograms of weights."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, found, pid = held.value, {}, TaskContext.get().partitionId()
        asked = [t for t, (g, _) in enumerate(owners) if len(p.tries[t]) and (not drawn or growths[g].kind == "extra")]
        inner, leaf = by_feature(p.feature, p.cut), p.feature < 0
        feature, after = np.where(leaf, 0, p.feature), np.where(leaf, np.arange(len(leaf)), p.left)
        ends = dict(zip(asked, np.cumsum([p.tries[t].size for t in asked]).tolist(), strict=True))
        join = lambda each, kind: np.concatenate([each[t].ravel() for t in asked]) if asked else np.zeros(0, kind)
        cuts = by_feature(join(p.tries, int), join(p.cuts, float)) if drawn else []
        whole: dict[int, bool] = {}
        growing = np.zeros(len(leaf), bool)
        for t in asked:
            growing[p.first[t] : p.first[t + 1]] = True
        inside = by_feature(np.where(growing, p.feature, -1), p.cut)
        many = (growing & ~leaf).sum() + sum(p.tries[t].size for t in asked)
        bitwise = all(growths[owners[t][0]].kind == "extra" for t in asked)
        # trees with the same rows and weights share their root, if they try as many features as there are
        root_of = lambda t: ((own := growths[owners[t][0]]).kind == "extra", own.target, own.out, (own.seed, owners[t][1]) if own.kind == "forest" else None)
        tried_at: dict[tuple, int] = {}
        for t in asked if not level and not drawn else []:
            tried_at[root_of(t)] = tried_at.get(root_of(t), 0) + p.tries[t].size

        def put(t: int, own: Growth, shape: tuple, tries: np.ndarray | None, k, value: np.ndarray) -> None:
            """Add ranges of nodes k, or histograms, to those of tree t; of a root's, which are of all features, those that it tries."""
            value = value if tries is None else value[:, :, tries[0]] if own.kind == "extra" else value[:, tries[0]]
            if own.kind == "extra":
                new = found.setdefault(t, np.stack([np.full(shape, np.inf), np.full(shape, -np.inf)]))
                new[0, k], new[1, k] = np.minimum(new[0, k], value[0]), np.maximum(new[1, k], value[1])
            else:
                new = found.setdefault(t, np.zeros((shape[0] * 2, shape[1], BINS)))
                new += value

        def put_bits(b: Block) -> None:
            """What the trees ask of a block, from bits of its rows: counts of bits left of cuts, or values of the rows whose bits are set."""
            bits, learnt, roots = Bits(b), {}, {}
            below, left = bits.below(inside, len(leaf)), bits.below(cuts, max(ends.values(), default=0))
            for t in asked:
                g, tries = owners[t][0], p.tries[t]
                own = growths[g]
                if (own.target, own.out) not in learnt:
                    rows, y = b.learnt(own) > 0, b.y[:, own.target]
                    learnt[own.target, own.out] = bits.of(np.stack([rows & (y == 0), rows & (y == 1)]))
                nodes = open_bits(p, t, below, learnt[own.target, own.out])
                if not nodes.any():
                    continue
                if drawn:
                    new = found.setdefault(t, np.zeros((tries.shape[0], tries.shape[1] + 1, 2)))
                    under = left[ends[t] - tries.size : ends[t]].reshape(*tries.shape, 1, -1)
                    new[:, :-1] += np.bitwise_count(nodes[:, None] & under).sum(axis=-1, dtype=float)
                    new[:, -1] += np.bitwise_count(nodes).sum(axis=-1, dtype=float)
                    continue
                new = found.setdefault(t, np.stack([np.full(tries.shape, np.inf), np.full(tries.shape, -np.inf)]))
                # the root's are the same for all trees of a target and fold
                ends_ = bits.ranges(nodes[:, 0] | nodes[:, 1], tries, None if level else roots.setdefault((own.target, own.out), {}))
                new[0], new[1] = np.minimum(new[0], ends_[0]), np.maximum(new[1], ends_[1])

        for b in blocks(batches):
            n = b.wide
            if bitwise and many <= FEW * n and bool(((b.w == 0) | (b.w == 1)).all()):
                put_bits(b)
                continue
            ordered = Ordered(b.x)
            flat, beyond = ordered.ranks.ravel(), ordered.below(inner, len(leaf))
            left = ordered.below(cuts, max(ends.values(), default=0)) if drawn else None
            counted = bool((b.w == np.floor(b.w)).all() and (b.w < MOST_COUNTED).all())
            # the bin of a row's value of each feature, and a word with a one in the bin's 4 bits
            codes = None if bins is None or drawn else np.column_stack([np.searchsorted(bins[f], b.x[:, f]) for f in range(n)])
            if codes is not None:
                words, places = np.zeros((b.n + 1, n), np.uint64), codes % 2 * (BINS // 2) + codes // 2
                words[:-1] = np.uint64(1) << (codes * 4).astype(np.uint64)
            learnt: dict[int, np.ndarray] = {}
            numbers: dict[tuple[int, int], np.ndarray] = {}
            roots: dict[tuple, list] = {}  # what all features give at the root, for trees with the same rows and weights
            for t in asked:
                (g, number), tries = owners[t], p.tries[t]
                own, shape = growths[g], tries.shape
                root = root_of(t)
                shared = counted and tried_at.get(root, 0) >= n
                if shared and root in roots:
                    put(t, own, shape, tries, *roots[root])
                    continue
                if g not in learnt:
                    learnt[g] = b.learnt(own)
                w = learnt[g]
                if own.kind == "forest":
                    if (own.seed, number) not in numbers:
                        numbers[own.seed, number] = poisson(b.mark, own.seed, number)
                    w = w * numbers[own.seed, number]
                rows = np.flatnonzero(w > 0)
                at, base = np.full(len(rows), p.first[t]), rows * n
                for _ in range(level):
                    at = after.take(at) + (flat.take(base + feature.take(at)) >= beyond.take(at))
                node = p.place.take(at)
                if (node < 0).any():
                    rows, node = rows[node >= 0], node[node >= 0]
                if not len(rows):
                    continue
                if shared:
                    tries = np.arange(n)[None]
                if t not in whole:
                    whole[t] = tries.shape[1] == n and bool((tries == np.arange(n)).all())
                y, w = b.y.take(rows * b.y.shape[1] + own.target), w.take(rows)
                if own.kind == "extra" and not drawn:
                    columns, of, _ = dealt(rows, node, None, shape[0], b.n)
                    x = laid(ordered.ranks, columns, tries, of, whole[t])
                    starts = np.flatnonzero(np.diff(of, prepend=-1))
                    k = of[starts]
                    lo, hi = (op.reduceat(m if whole[t] else m.T, starts, axis=0) for op, m in ((np.minimum, x.min(axis=0)), (np.maximum, x.max(axis=0))))
                    lo, hi = ordered.values[tries[k], lo], ordered.values[tries[k], hi]
                    value = k, np.stack([np.where(np.isnan(hi), hi, lo), hi])
                elif own.kind == "extra":
                    new = found.setdefault(t, np.zeros((shape[0], shape[1] + 1, 2)))
                    under = left[ends[t] - tries.size : ends[t]].reshape(shape)
                    if counted:
                        columns, of, weights = dealt(rows, node * 2 + y, w, shape[0] * 2, b.n)
                        there = of % (shape[0] * 2) // 2
                        x = laid(ordered.ranks, columns, tries, there, whole[t])
                        x = x < (under.take(there, axis=0) if whole[t] else under.T.take(there, axis=1))
                        x = x.view(np.uint8).sum(axis=0, dtype=np.uint8)
                        new[:, :-1] += met(x if whole[t] else x.T, of, shape[0] * 2).reshape(shape[0], 2, -1).swapaxes(1, 2)
                        new[:, -1] += weights.reshape(-1, 2)
                        continue
                    for k in np.unique(node):
                        i = np.flatnonzero(node == k)
                        classes = np.zeros((len(i), 2))
                        classes[np.arange(len(i)), y[i]] = w[i]
                        new[k, :-1] += (ordered.ranks[rows[i, None], tries[k]] < under[k]).astype(float).T @ classes
                        new[k, -1] += classes.sum(axis=0)
                else:
                    k = slice(None)
                    if counted:
                        columns, of, _ = dealt(rows, node * 2 + y, w, shape[0] * 2, b.n)
                        x = laid(words, columns, tries, of % (shape[0] * 2) // 2, whole[t]).sum(axis=0, dtype=np.uint64)
                        value = histograms(x if whole[t] else x.T, of, shape[0] * 2)
                    else:
                        cell = places.take(rows[:, None] * n + tries[node]) + (((node * 2 + y) * shape[1])[:, None] + np.arange(shape[1])) * BINS
                        value = np.bincount(cell.ravel(), np.repeat(w, shape[1]), minlength=shape[0] * 2 * shape[1] * BINS)
                    value = k, value.reshape(shape[0] * 2, -1, BINS)
                if not drawn:
                    if tries is not p.tries[t]:
                        roots[root] = value
                    put(t, own, shape, p.tries[t] if tries is not p.tries[t] else None, *value)
        while found:  # given out a few trees at a time, so that no copy of all sums is made
            some = [(t, found.pop(t).tobytes()) for t in list(found)[:16]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int32()) for x in ([int(part[t]) for t, _ in some], [t for t, _ in some], [pid] * len(some))), pa.array([data for _, data in some], pa.binary())],
                names=["part", "tree", "pid", "data"],
            )

    return sums


def merged(growths: list[Growth], owners: list[tuple[int, int]], held, bins: np.ndarray | None, drawn: bool, final: bool):
    """The partial sums of each tree of a group as one; in the last step the cuts drawn, or the best ones."""

    def joined(t: int, parts: list[np.ndarray]) -> np.ndarray:
        (g, number), own = owners[t], growths[owners[t][0]]
        ranges = own.kind == "extra" and not drawn
        if ranges:
            parts = [x.reshape(2, -1) for x in parts]
            out = np.stack([np.min([x[0] for x in parts], axis=0), np.max([x[1] for x in parts], axis=0)])
        else:
            out = parts[0].copy()
            for x in parts[1:]:
                out += x
        if not final:
            return out
        p = held.value
        tries = p.tries[t]
        if ranges:
            lo, hi = out.reshape(2, *tries.shape)
            nodes = np.flatnonzero(p.place[p.first[t] : p.first[t + 1]] >= 0)
            u = np.stack([np.random.default_rng((own.seed, number, int(node), 1)).random(tries.shape[1]) for node in nodes])
            some = hi > lo
            out = np.where(some, lo + u * np.where(some, hi - lo, 0.0), lo)
            return np.where(some & (out >= hi), lo, out)
        if own.kind == "extra":
            out = out.reshape(tries.shape[0], tries.shape[1] + 1, 2)
            return best_cuts(out[:, :-1, None, :], out[:, -1], tries, p.cuts[t][:, :, None])
        # node, class, feature and even or odd bins, as histograms() has them
        out = out.reshape(tries.shape[0], 2, tries.shape[1], 2, BINS // 2).transpose(0, 2, 4, 3, 1).reshape(*tries.shape, BINS, 2)
        return best_cuts(out.cumsum(2)[:, :, :-1], out[:, 0].sum(1), tries, bins[tries])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        parts: dict[int, list] = {}
        for t, data in group.sort_values("pid")[["tree", "data"]].itertuples(index=False):
            parts.setdefault(int(t), []).append(np.frombuffer(data))
        values = [np.ascontiguousarray(joined(t, x)).tobytes() for t, x in parts.items()]
        return pd.DataFrame({"part": group["part"].iloc[0], "tree": list(parts), "pid": group["pid"].min(), "data": values})

    return meet


def summed(rows: DataFrame, growths: list[Growth], trees: list[Tree], p: Packed, bins: np.ndarray | None, drawn: bool, level: int) -> dict[int, np.ndarray]:
    """One job (or some, if the sums of all trees would not fit a task): for each tree what its group answers, some numbers a node."""
    owners = [(t.growth, t.number) for t in trees]
    ends = np.cumsum([len(x) * (x.shape[1] + 1) * (2 if growths[t.growth].kind == "extra" else 2 * BINS) for t, x in zip(trees, p.tries, strict=True)])
    turn, part = ends // MOST_SUMS, ends // MOST_MERGED
    out, kind = {}, "part int, tree int, pid int, data binary"
    many = rows.rdd.getNumPartitions() > MERGED
    for k in np.unique(turn):
        some = [x if turn[t] == k else x[:0] for t, x in enumerate(p.tries)]
        if not any(len(x) and (not drawn or growths[o[0]].kind == "extra") for x, o in zip(some, owners, strict=True)):
            continue
        held = rows.sparkSession.sparkContext.broadcast(Packed(p.first, p.feature, p.cut, p.left, p.place, some, p.cuts))
        parts = rows.mapInArrow(partial(growths, owners, part, held, bins, drawn, level), kind)
        if many:
            parts = parts.groupBy("part", F.floor(F.col("pid") / MERGED).alias("salt")).applyInPandas(merged(growths, owners, held, bins, drawn, False), kind)
        found = parts.groupBy("part").applyInPandas(merged(growths, owners, held, bins, drawn, True), kind).select("tree", "data")
        out.update({r.tree: np.frombuffer(r.data) for r in found.collect()})
        held.unpersist()
    return out


def split(t: Tree, g: Growth, found: np.ndarray | None) -> None:
    """Open nodes become inner nodes with two children, or leaves; children that are pure or deep enough are not open."""
    nodes, t.open = t.open, []
    for node, (f, cut, gain, *w) in zip(nodes, [] if found is None else found.reshape(-1, 7).tolist(), strict=False):
        left, right = (w[0], w[1]), (w[2], w[3])
        if node == 0 and gain > -np.inf:
            t.weight[0] = (left[0] + right[0], left[1] + right[1])
        if not gain > 1e-12 * (sum(left) + sum(right)):
            continue
        t.feature[node], t.cut[node], t.left[node], t.gain[node] = int(f), cut, len(t.feature), gain
        for side in (left, right):
            if min(side) > 0 and t.depth[node] + 1 < g.depth:
                t.open.append(len(t.feature))
            for values, x in ((t.feature, -1), (t.cut, 0.0), (t.left, 0), (t.weight, side), (t.gain, 0.0), (t.depth, t.depth[node] + 1)):
                values.append(x)


def grow(rows: DataFrame, growths: list[Growth]) -> list[list[Tree]]:
    """The trees of each growth over rows as table() makes them. Two jobs a level, whatever the number of trees."""
    head = rows.select((F.col("wide") if "ranks" in rows.columns else F.size("features")).alias("n")).limit(1).collect()
    trees = [Tree(i, k) for i, g in enumerate(growths) for k in range(1 if g.kind == "tree" else g.trees)]
    if head:
        n = head[0].n
        bins = quantile_cuts(rows, n) if any(g.kind != "extra" for g in growths) else None
        classes = root_weights(rows, growths)
        for t in trees:
            t.weight[0] = classes[t.growth]
        for level in range(max(g.depth for g in growths)):
            if not any(t.open for t in trees):
                break
            p = packed(trees, n, growths)
            found = summed(rows, growths, trees, p, bins, False, level)
            for t, tree in enumerate(trees):
                if growths[tree.growth].kind == "extra":
                    p.cuts[t] = found.pop(t).reshape(p.tries[t].shape) if t in found else None
                    if p.cuts[t] is None:
                        p.tries[t] = p.tries[t][:0]
            found.update(summed(rows, growths, trees, p, bins, True, level))
            for t, tree in enumerate(trees):
                split(tree, growths[tree.growth], found.get(t))
    out: list[list[Tree]] = [[] for _ in growths]
    for t in trees:
        out[t.growth].append(t)
    return out


def root_weights(rows: DataFrame, growths: list[Growth]) -> list[tuple[float, float]]:
    """Weights of both classes among the rows that each growth learns from."""
    asked = sorted({(g.target, g.out) for g in growths})
    if "ranks" in rows.columns:

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches):
                w = [b.learnt(Growth(target=target, out=out)) for target, out in asked]
                both = [[float(x[b.y[:, target] == c].sum()) for x, (target, _) in zip(w, asked, strict=True)] for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked), dtype=np.int32)), *map(pa.array, both)], names=["i", "zero", "one"])

        found = rows.mapInArrow(added, "i int, zero double, one double").groupBy("i").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
        of = {asked[r.i]: (r.zero, r.one) for r in found.collect()}
        return [of[g.target, g.out] for g in growths]
    sums = []
    for target, out in asked:
        y, left_out = F.col("targets")[target], F.lit(False)
        for slot, value in out:
            left_out = left_out | (F.coalesce(F.col("folds")[slot], F.lit(-1)) == value)
        sums += [F.sum(F.when(~left_out & (y == c), F.col("weight"))) for c in (0, 1)]
    found = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    of = {a: (found[2 * i] or 0.0, found[2 * i + 1] or 0.0) for i, a in enumerate(asked)}
    return [of[g.target, g.out] for g in growths]


def shares(trees: list[Tree]) -> np.ndarray:
    """The share of class 1 in every node."""
    w = np.array([x for t in trees for x in t.weight]).reshape(-1, 2)
    total = w.sum(1)
    return np.where(total > 0, w[:, 1] / np.where(total > 0, total, 1.0), 0.5)


def settings_scores(rows: DataFrame, growths: list[Growth], forests: list[list[Tree]], counts: tuple = (), depths: tuple = ()) -> DataFrame:
    """growth, trees, depth, accuracy, weight: of each forest's first trees, cut at each depth, over the rows it is tested on. One job for all."""
    flat = [t for f in forests for t in f]
    held = rows.sparkSession.sparkContext.broadcast((packed(flat), shares(flat)))
    first = np.cumsum([0, *map(len, forests)])

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, share = held.value
        out: dict[tuple[int, int, int], list[float]] = {}
        for b in blocks(batches):
            for g, own in enumerate(growths):
                y = b.y[:, own.target]
                rows = np.flatnonzero(b.having(own.test, True) & (b.w > 0) & (y >= 0))
                if not len(rows):
                    continue
                x, w, y = b.x[rows], b.w[rows], y[rows]
                levels = sorted({min(d, own.depth) for d in depths} or {own.depth})
                stops = {min(c, first[g + 1] - first[g]) for c in counts} or {first[g + 1] - first[g]}
                sums = np.zeros((len(levels), len(rows)))
                for k, t in enumerate(range(first[g], first[g + 1]), 1):
                    for d, at in enumerate(walked(x, p, t, own.depth)):
                        if d in levels:
                            sums[levels.index(d)] += share[at]
                    if k in stops:
                        for i, d in enumerate(levels):
                            now = out.setdefault((g, k, d), [0.0, 0.0])
                            now[0] += float(w[(sums[i] > k / 2) == (y == 1)].sum())
                            now[1] += float(w.sum())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in out], pa.int32()) for i in range(3)), *(pa.array([v[i] for v in out.values()], pa.float64()) for i in range(2))],
            names=["growth", "trees", "depth", "hit", "weight"],
        )

    parts = rows.mapInArrow(tested, "growth int, trees int, depth int, hit double, weight double")
    return parts.groupBy("growth", "trees", "depth").agg((F.sum("hit") / F.sum("weight")).alias("accuracy"), F.sum("weight").alias("weight"))


def predicted(rows: DataFrame, forests: list[list[Tree]], trees: int | None = None, depth: int = 1 << 10) -> DataFrame:
    """growth, id, score of every row: the mean share of class 1 over the (first) trees of each forest."""
    kept = [f[:trees] for f in forests]
    flat = [t for f in kept for t in f]
    held = rows.sparkSession.sparkContext.broadcast((packed(flat), shares(flat)))
    first, deep = np.cumsum([0, *map(len, kept)]), [min(depth, max([d for t in f for d in t.depth], default=0)) for f in kept]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, share = held.value
        for b in blocks(batches):
            for g in range(len(kept)):
                total = np.zeros(b.n)
                for t in range(first[g], first[g + 1]):
                    *_, at = walked(b.x, p, t, deep[g])
                    total += share[at]
                score = total / max(1, first[g + 1] - first[g])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.n, g, np.int32)), b.id, pa.array(score)], names=["growth", "id", "score"])

    return rows.mapInArrow(put, f"growth int, id {rows.schema['id'].dataType.simpleString()}, score double")


def tested(rows: DataFrame, growths: list[Growth], forests: list[list[Tree]]) -> DataFrame:
    """growth, target, score, hit of the rows that each growth is tested on: predicted()'s scores, each only where it is asked for, and whether they are right."""
    flat = [t for f in forests for t in f]
    held = rows.sparkSession.sparkContext.broadcast((packed(flat), shares(flat)))
    first, deep = np.cumsum([0, *map(len, forests)]), [max([d for t in f for d in t.depth], default=0) for f in forests]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, share = held.value
        for b in blocks(batches):
            out = []
            for g, own in enumerate(growths):
                y = b.y[:, own.target]
                at = np.flatnonzero(b.having(own.test, True) & (b.w > 0) & (y >= 0))
                total, trees = np.zeros(len(at)), first[g + 1] - first[g]
                for t in range(first[g], first[g + 1]):
                    *_, node = walked(b.x, p, t, deep[g], at)
                    total += share[node]
                out.append((np.full(len(at), g, np.int32), y[at].astype(np.int32), total / max(1, trees), (total > trees / 2) == (y[at] == 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["growth", "target", "score", "hit"])

    return rows.mapInArrow(put, "growth int, target int, score double, hit boolean")


def importances(trees: list[Tree], n: int, use: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation over trees of the share of the impurity's decrease that each feature (of n, or of those the trees may use) has."""
    place = {f: i for i, f in enumerate(range(n) if use is None else use)}
    each = np.zeros((len(trees), len(place)))
    for k, t in enumerate(trees):
        for f, gain in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                each[k, place[f]] += gain
        if each[k].sum() > 0:
            each[k] /= each[k].sum()
    return each.mean(axis=0), each.std(axis=0)
