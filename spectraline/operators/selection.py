"""Choosing models and features with trees that are grown together (operators/forests.py).

Every function states all the forests it needs and grows them in the same jobs, two a level: folds, settings, shares of the rows,
selected features and permuted copies are growths over one staged table, not fits in a loop. Settings are choices of a kind of trees,
of the features a node tries, of a number of trees and a depth; the latter two are prefixes of the largest forest.

Permuted copies are dealt inside blocks of about `BLOCK` rows, to which md5 numbers deal the rows at random: inside a block the row that
is r-th by id takes the place of the row that is r-th by md5(id|seed). A table of up to `BLOCK` rows is one block, so a full permutation;
a larger one takes one shuffle for all copies instead of two sorts for each. Targets are 0/1; ids are unique and not null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraline.functions import stats
from spectraline.operators import models
from spectraline.operators import forests as T
from spectraline.sources import sinks

BLOCK = 4096
KINDS = (("extra", "sqrt"), ("extra", "all"), ("forest", "sqrt"), ("forest", "all"), ("tree", "all"))


def nested_folds(rows: DataFrame, k: int) -> DataFrame:
    """rows with `outer`, and inner0, inner1, ...: the folds of the rows outside of outer fold 0, 1, ..., -1 inside. Stratified, from one ranking in md5 order."""
    ranked = models.dealt_rank(rows, by=("target",), name="_rank").withColumn("_rank", F.col("_rank") - 1)
    out = ranked.withColumn("outer", (F.col("_rank") % k).cast("int"))
    for o in range(k):  # the rank among the rows that are left, as every k-th is not
        left = F.col("_rank") - F.floor((F.col("_rank") + (k - 1 - o)) / k)
        out = out.withColumn(f"inner{o}", F.when(F.col("outer") == o, -1).otherwise(left % k).cast("int"))
    return out.drop("_rank")


def grid_scores(t: DataFrame, plans: list[tuple], counts: tuple, depths: tuple, kinds: tuple = KINDS) -> DataFrame:
    """plan, kind, features, trees, depth, accuracy: for each plan, a pair of `out` and `test`, every setting. All of them are grown together."""
    growths = [T.Growth(kind, max(counts), max(depths), features, out, test) for out, test in plans for kind, features in kinds]
    found = T.settings_scores(t, growths, T.grow(t, growths), counts, depths)
    names = models.few(t.sparkSession, [(i, i // len(kinds), g.kind, g.features) for i, g in enumerate(growths)], "growth int, plan int, kind string, features string")
    return found.join(F.broadcast(names), "growth").select("plan", "kind", "features", "trees", "depth", "accuracy")


def grid_search(rows: DataFrame, k: int = 5, counts: tuple = (200, 500, 1000), depths: tuple = (20,), kinds: tuple = KINDS) -> DataFrame:
    """kind, features, trees, depth, accuracy, std: means over k folds, best first."""
    t = sinks.stage(T.table(models.stratified_folds(rows, k), folds=("fold",)))
    each = grid_scores(t, [(((0, f),), ((0, f),)) for f in range(k)], counts, depths, kinds)
    out = each.groupBy("kind", "features", "trees", "depth").agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("std"))
    return out.orderBy(F.desc("accuracy"), "kind", "features", "trees", "depth")


def nested_cv(rows: DataFrame, k: int = 5, counts: tuple = (200, 500, 1000), depths: tuple = (20,), kinds: tuple = KINDS) -> DataFrame:
    """outer, kind, features, trees, depth, selected, accuracy.

    For each outer fold the setting that is best over its inner folds (`selected` is its mean accuracy there), refitted on the other outer
    folds and scored on this one; outer -1 is the setting that is best over the outer folds, refitted on all rows, and has no such score.
    Of equal settings the earlier kind, the fewer trees and the lower depth win.
    """
    t = sinks.stage(T.table(nested_folds(rows, k), folds=("outer", *(f"inner{o}" for o in range(k)))))
    plans = [(((1 + o, -1), (1 + o, i)), ((1 + o, i),)) for o in range(k) for i in range(k)] + [(((0, i),), ((0, i),)) for i in range(k)]
    means = (
        grid_scores(t, plans, counts, depths, kinds).groupBy(F.floor(F.col("plan") / k).cast("int").alias("outer"), "kind", "features", "trees", "depth")
        .agg(F.avg("accuracy").alias("accuracy")).collect()
    )
    best = {}
    for r in means:  # as many as outer folds and settings
        key = -round(r.accuracy, 12), kinds.index((r.kind, r.features)), r.trees, r.depth
        if r.outer not in best or key < best[r.outer][0]:
            best[r.outer] = key, r
    chosen = [best[o][1] for o in sorted(best)]
    growths = [T.Growth(r.kind, r.trees, r.depth, r.features, ((0, r.outer),), ((0, r.outer),)) for r in chosen if r.outer < k]
    score = {r.growth: r.accuracy for r in T.settings_scores(t, growths, T.grow(t, growths)).collect()}
    values = [(r.outer if r.outer < k else -1, r.kind, r.features, r.trees, r.depth, r.accuracy, score.get(i) if r.outer < k else None) for i, r in enumerate(chosen)]
    return models.few(t.sparkSession, values, "outer int, kind string, features string, trees int, depth int, selected double, accuracy double")


def cv_scores(folded: DataFrame, growth: T.Growth = T.Growth("tree")) -> DataFrame:
    """fold, accuracy, auc of forests that learn from the other folds (column fold); all folds are grown together."""
    t = sinks.stage(T.table(folded, folds=("fold",)))
    folds = sorted(r[0] for r in t.select(F.col("folds")[0]).distinct().collect())
    growths = [T.Growth(growth.kind, growth.trees, growth.depth, growth.features, ((0, f),), ((0, f),), growth.use, seed=growth.seed) for f in folds]
    fold = F.element_at(F.array(*map(F.lit, folds)), F.col("growth") + 1)
    truth = t.select("id", F.col("folds")[0].alias("fold"), F.col("targets")[0].alias("target"))
    own = sinks.stage(T.predicted(t, T.grow(t, growths)).withColumn("fold", fold).join(truth, ["id", "fold"]))
    accuracy = own.groupBy("fold").agg(stats.accuracy((F.col("score") > 0.5) == (F.col("target") == 1)).alias("accuracy"))
    return accuracy.join(stats.roc_auc(own, "fold"), "fold")


def learning_curve(rows: DataFrame, steps: int = 20, repeats: int = 5, growth: T.Growth = T.Growth()) -> DataFrame:
    """share, mean, std: accuracy on a fourth of the rows after learning from the first 1, 2, ... of `steps` parts of the rest, in `repeats` orders.

    A row's part is its md5 number for the order, so parts are equal up to chance and no order is ever made.
    """
    folded = models.stratified_folds(rows, 4)
    part = lambda r: F.floor(F.conv(F.substring(models.order_key("id", r), 1, 8), 16, 10).cast("double") * steps / 2.0**32).cast("int")
    t = sinks.stage(T.table(folded.withColumns({f"part{r}": part(r) for r in range(repeats)}), folds=("fold", *(f"part{r}" for r in range(repeats)))))
    asked = [(r, s) for r in range(repeats) for s in range(1, steps + 1)]
    growths = [
        T.Growth(growth.kind, growth.trees, growth.depth, growth.features, ((0, 0), *((1 + r, p) for p in range(s, steps))), ((0, 0),), growth.use, seed=growth.seed + r)
        for r, s in asked
    ]
    names = models.few(t.sparkSession, [(i, s / steps) for i, (_, s) in enumerate(asked)], "growth int, share double")
    found = T.settings_scores(t, growths, T.grow(t, growths)).join(F.broadcast(names), "growth")
    return found.groupBy("share").agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std"))


def by_u_test(folded: DataFrame, most: int) -> dict[int, tuple]:
    """For each fold the features that differ most between classes outside of it: one pass for all folds, `most` features each on the driver."""
    folds = F.array(*[F.lit(f.fold) for f in folded.select("fold").distinct().collect()])
    long = (
        folded.withColumn("out", F.explode(F.filter(folds, lambda f: f != F.col("fold"))))
        .select("out", "target", F.posexplode("features").alias("channel", "value"))
    )
    p = stats.mann_whitney(long, "out")
    top = p.groupBy("out").agg(F.slice(F.sort_array(F.collect_list(F.struct("p", "channel"))), 1, most).alias("top"))
    return {r.out: tuple(sorted(x.channel for x in r.top)) for r in top.collect()}


def selection_assessment(rows: DataFrame, k: int = 5, most: int = 8, growth: T.Growth = T.Growth(), selector: Callable[[DataFrame, int], dict] = by_u_test) -> DataFrame:
    """fold, features, accuracy, all_features: per fold, features selected on the rest, then forests with them and with all, both scored on the fold."""
    folded = models.stratified_folds(rows, k)
    t = sinks.stage(T.table(folded, folds=("fold",)))
    chosen = selector(folded.select("fold", "target", "features"), most)
    asked = [(f, use) for f in sorted(chosen) for use in (chosen[f], None)]
    growths = [T.Growth(growth.kind, growth.trees, growth.depth, growth.features, ((0, f),), ((0, f),), use, seed=growth.seed) for f, use in asked]
    score = {r.growth: r.accuracy for r in T.settings_scores(t, growths, T.grow(t, growths)).collect()}
    values = [(f, list(use), score.get(i), score.get(i + 1)) for i, (f, use) in enumerate(asked) if use is not None]
    return models.few(t.sparkSession, values, "fold int, features array<int>, accuracy double, all_features double")


def forward_selection(rows: DataFrame, gain: float = 0.01, most: int = 16, growth: T.Growth = T.Growth(features="all")) -> DataFrame:
    """step, channel, score: the feature, of all, with which forests on the features so far have the best mean accuracy over folds (column fold).

    The forests of all candidates and folds take a step together. It ends when the gain is too small, or after `most` features.
    """
    t = sinks.stage(T.table(rows, folds=("fold",)))
    n = (t.select(F.size("features").alias("n")).first() or [0])[0]
    folds = sorted(r.fold for r in rows.select("fold").distinct().collect())
    chosen: list[tuple[int, int, float]] = []
    while len(chosen) < min(most, n):
        have = [c for _, c, _ in chosen]
        asked = [(c, f) for c in range(n) if c not in have for f in folds]
        growths = [T.Growth(growth.kind, growth.trees, growth.depth, growth.features, ((0, f),), ((0, f),), (*have, c), seed=growth.seed) for c, f in asked]
        each: dict[int, list[float]] = {}
        for r in sorted(T.settings_scores(t, growths, T.grow(t, growths)).collect(), key=lambda r: r.growth):  # one row a forest
            each.setdefault(asked[r.growth][0], []).append(r.accuracy)
        best = max(each, key=lambda c: (round(float(np.mean(each[c])), 12), -c))
        score = float(np.mean(each[best]))
        if score < (chosen[-1][2] if chosen else 0.0) + gain:
            break
        chosen.append((len(chosen), best, score))
    return models.few(t.sparkSession, chosen, "step int, channel int, score double")


def importances(rows: DataFrame, growth: T.Growth = T.Growth()) -> DataFrame:
    """channel, importance, std: mean and deviation over trees of the shares in the impurity's decrease."""
    t = sinks.stage(T.table(rows))
    n = (t.select(F.size("features").alias("n")).first() or [0])[0]
    mean, std = T.importances(T.grow(t, [growth])[0], n)
    return models.few(t.sparkSession, [(i, float(m), float(d)) for i, (m, d) in enumerate(zip(mean, std, strict=True))], "channel int, importance double, std double")


def block_of(key: str, n: int) -> Column:
    """A number below the number of blocks that n rows make, from md5."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit("|block"))), 1, 8), 16, 10).cast("long") % max(1, -(-n // BLOCK))


def orders(ids: list, copies: int) -> np.ndarray:
    """copies x rows: the rows, given by ascending id, in the order of md5(id|copy)."""
    return np.array([sorted(range(len(ids)), key=lambda i, b=b: (hashlib.md5(f"{ids[i]}|{b}".encode()).digest(), ids[i])) for b in range(1, copies + 1)]).reshape(copies, len(ids))


def with_copies(rows: DataFrame, copies: int) -> DataFrame:
    """id, features, targets: behind the own ones those of the row dealt to it, once for each copy."""

    def dealt(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x, y = np.stack(group["features"]), group["target"].to_numpy()
        places = orders(group["id"].tolist(), copies)
        return pd.DataFrame({"id": group["id"], "features": list(np.concatenate([x, *(x[p] for p in places)], axis=1)), "targets": list(np.stack([y, *(y[p] for p in places)], axis=1))})

    kind = rows.schema["id"].dataType.simpleString()
    t = rows.select("id", F.col("features").cast("array<double>").alias("features"), F.col("target").cast("int").alias("target"), block_of("id", rows.count()).alias("block"))
    out = t.groupBy("block").applyInPandas(dealt, f"id {kind}, features array<double>, targets array<int>")
    return sinks.stage(out.select("id", "features", "targets", F.lit(1.0).alias("weight"), F.array().cast("array<int>").alias("folds"), F.xxhash64("id").alias("mark")))


def permuted_scores(rows: DataFrame, permutations: int = 100) -> DataFrame:
    """channel, b, score: |difference of the classes' means| of each feature, for the own targets (b = 0) and permuted ones, from one pass over the rows."""

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x, y = np.stack(group["features"]), group["target"].to_numpy().astype(float)
        y = np.stack([y, *y[orders(group["id"].tolist(), permutations)]])
        ones, n = y @ x, x.shape[1]
        return pd.DataFrame({
            "channel": np.tile(np.arange(n), len(y)), "b": np.repeat(np.arange(len(y)), n), "s1": ones.ravel(), "s0": (x.sum(0) - ones).ravel(),
            "n1": np.repeat(y.sum(1), n), "n0": np.repeat(len(x) - y.sum(1), n),
        })

    t = rows.select("id", F.col("features").cast("array<double>").alias("features"), "target", block_of("id", rows.count()).alias("block"))
    parts = t.groupBy("block").applyInPandas(sums, "channel int, b int, s1 double, s0 double, n1 double, n0 double")
    total = parts.groupBy("channel", "b").agg(*[F.sum(c).alias(c) for c in ("s1", "s0", "n1", "n0")])
    return total.select("channel", "b", F.round(F.abs(F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")), 9).alias("score"))


def permutation_fdr(scores: DataFrame, permutations: int) -> DataFrame:
    """channel, score, fdr from permuted_scores: permuted scores at least as high, a permutation, over the rank; rates rise along the ranks. Ordered passes see features x permutations."""
    by = scores.groupBy("score").agg(F.count_if(F.col("b") > 0).alias("perm"))
    above = by.withColumn("above", F.sum("perm").over(Window.orderBy(F.desc("score"))))
    real = scores.filter("b = 0").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "channel")))
    rate = real.join(above, "score").select("channel", "score", "rank", F.least(F.lit(1.0), F.col("above") / permutations / F.col("rank")).alias("fdr"))
    return stats.monotone(rate, [], "rank", "fdr").select("channel", "score", "fdr")


def mprobes(rows: DataFrame, runs: int = 5, growth: T.Growth = T.Growth()) -> DataFrame:
    """channel, fwer: share of runs in which a feature is no more important than the best permuted contrast. All runs are grown together."""
    t = with_copies(rows, runs)
    n = (t.select(F.size("features").alias("n")).first() or [0])[0] // (runs + 1)
    growths = [T.Growth(growth.kind, growth.trees, growth.depth, growth.features, use=(*range(n), *range(n * r, n * (r + 1))), seed=growth.seed + r) for r in range(1, runs + 1)]
    lost = np.zeros(n)
    for r, forest in enumerate(T.grow(t, growths), 1):
        imp, _ = T.importances(forest, n * (runs + 1))
        lost += imp[:n] <= imp[n * r : n * (r + 1)].max()
    return models.few(t.sparkSession, [(i, float(x) / runs) for i, x in enumerate(lost)], "channel int, fwer double")


def grown_importances(growth: T.Growth) -> Callable[[DataFrame, list], list[np.ndarray]]:
    """importance of the features `use` for the target at a place, for a list of (place, use): all in the same jobs."""

    def of(t: DataFrame, asked: list) -> list[np.ndarray]:
        width = t.select(F.size("features").alias("n")).first()[0]
        growths = [T.Growth(growth.kind, growth.trees, growth.depth, growth.features, use=use, target=y, seed=growth.seed) for y, use in asked]
        return [T.importances(f, width)[0][list(use)] for f, (_, use) in zip(T.grow(t, growths), asked, strict=True)]

    return of


def conditional_errors(rows: DataFrame, permutations: int = 5, stop: float = 0.5, at_once: int = 16, growth: T.Growth = T.Growth(), importance: Callable | None = None) -> DataFrame:
    """rank, channel, importance, fdr, cer, efdr of features from the most important on.

    fdr: features that reach the importance under permuted targets, over the rank. For cer and efdr of the feature of rank r + 1 the target is
    permuted together with the r features above it, which keeps what they explain; cer is the share of permutations in which another feature
    reaches its importance, efdr the mean share of false ones among those that would be selected. Features after both rates went above `stop`
    have neither. All three rise along the ranks. The forests of `at_once` ranks and all permutations are grown together.
    """
    t = with_copies(rows, permutations)
    n = (t.select(F.size("features").alias("n")).first() or [0])[0] // (permutations + 1)
    importance = importance or grown_importances(growth)
    own = importance(t, [(0, tuple(range(n)))])[0] if n else np.zeros(0)
    order = np.argsort(-own, kind="stable")
    real = own[order]

    def asked(rank: int, b: int) -> tuple[int, tuple]:
        above = set(order[:rank].tolist())
        return b, tuple(n * b + f if f in above else f for f in range(n))

    def beaten(found: np.ndarray, rank: int) -> int:
        """How many of the sorted permuted importances stay at or above the real ones, place by place, from the first on."""
        below = np.flatnonzero(np.sort(found)[::-1] < real[rank:])
        return int(below[0]) if len(below) else n - rank

    cer, efdr, hits, ended = [], [], np.zeros(n), False
    for first in range(0, n, at_once):
        if ended:
            break
        ranks = range(first, min(first + at_once, n))
        found = iter(importance(t, [asked(r, b) for r in ranks for b in range(1, permutations + 1)]))
        for rank in ranks:
            each = [np.delete(next(found), order[:rank]) for _ in range(permutations)]
            if not rank:
                hits += np.sum([(x[:, None] >= real).sum(0) for x in each], axis=0)
            if rank and cer[-1] > stop and efdr[-1] > stop:
                ended = True
                break
            false = [beaten(x, rank) for x in each]
            cer.append(float(np.mean([x.max() >= real[rank] for x in each])))
            efdr.append(float(np.mean([r / (r + rank) if rank else float(r > 0) for r in false])))
    fdr = np.maximum.accumulate(np.minimum(1.0, hits / permutations / np.arange(1, n + 1)))
    cer, efdr = ([*np.maximum.accumulate(x).tolist(), *[None] * (n - len(x))] for x in (cer, efdr))
    values = [(i + 1, int(order[i]), float(real[i]), float(fdr[i]), cer[i], efdr[i]) for i in range(n)]
    return models.few(t.sparkSession, values, "rank int, channel int, importance double, fdr double, cer double, efdr double")


def permutation_importance(rows: DataFrame, repeats: int = 5, growth: T.Growth = T.Growth("forest")) -> DataFrame:
    """channel, drop, std: mean and deviation over repeats of the loss of accuracy when a feature's values come from other rows.

    One forest, one job for all repeats. A row is scored again along a tree only for the features that its path there tests, as no other
    changes its leaf; so the work is rows x trees x depth, not rows x features.
    """
    t = with_copies(rows, repeats)
    n = (t.select(F.size("features").alias("n")).first() or [0])[0] // (repeats + 1)
    forest = T.grow(t, [T.Growth(growth.kind, growth.trees, growth.depth, growth.features, use=tuple(range(n)), seed=growth.seed)])[0]
    held = t.sparkSession.sparkContext.broadcast((T.packed(forest), T.shares(forest)))
    trees, depth = len(forest), growth.depth

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, share = held.value
        hit, count = np.zeros((repeats + 1, n)), 0
        for b in T.blocks(batches):
            y, base = b.y[:, 0] == 1, np.zeros(b.n)
            change = np.zeros((repeats, b.n, n))
            for tree in range(trees):
                path = list(T.walked(b.x, p, tree, depth))
                leaf = share[path[-1]]
                base += leaf
                tests = np.stack([p.feature[at] for at in path[:-1]], axis=1)
                for f in np.unique(tests[tests >= 0]):
                    rows = np.flatnonzero((tests == f).any(axis=1))
                    for r in range(repeats):
                        x = b.x[rows, :n].copy()
                        x[:, f] = b.x[rows, n * (r + 1) + f]
                        *_, at = T.walked(x, p, tree, depth)
                        change[r, rows, f] += share[at] - leaf[rows]
            hit[0] += ((base > trees / 2) == y).sum()
            hit[1:] += ((np.round(base[None, :, None] + change, 9) > trees / 2) == y[None, :, None]).sum(axis=1)
            count += b.n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(repeats + 1), n)), pa.array(np.tile(np.arange(n), repeats + 1)), pa.array(hit.ravel()), pa.array(np.full(hit.size, float(count)))],
            names=["repeat", "channel", "hit", "n"],
        )

    parts = t.mapInArrow(scored, "repeat long, channel long, hit double, n double").groupBy("repeat", "channel").agg((F.sum("hit") / F.sum("n")).alias("accuracy"))
    base = parts.filter("repeat = 0").select(F.col("channel").alias("channel"), F.col("accuracy").alias("base"))
    out = parts.filter("repeat > 0").groupBy("channel").agg(F.avg("accuracy").alias("a"), F.stddev_pop("accuracy").alias("std")).join(base, "channel")
    return out.select(F.col("channel").cast("int").alias("channel"), (F.col("base") - F.col("a")).alias("drop"), "std")


#: Bins of steps to come that a feature table has beside those of the first of its steps, all in all.
COLUMNS = 64


def halves(bins: list[tuple[float, float]]) -> list[tuple[float, float]]:
    return [half for lo, hi in bins for half in ((lo, (lo + hi) / 2), ((lo + hi) / 2, hi))]


def ahead(now: list[list], limit: float) -> list[tuple[float, float]]:
    """The bins of all folds, each once, and all that halving makes of them in the steps to come, as long as they are few."""
    out, step = [], [b for own in now for b in own]
    while not out or (min(hi - lo for lo, hi in step) > limit and len({*out, *step}) <= COLUMNS):
        out, step = [*out, *step], list(dict.fromkeys(halves(step)))
    return list(dict.fromkeys(out))


def progressive_binning(peaks: DataFrame, labels: DataFrame, bins: list[tuple[float, float]], limit: float, folds: int = 1, growth: T.Growth = T.Growth()) -> tuple[list, list]:
    """Steps of refinement for each fold, as lists of (lo, hi, importance, kept), and (fold, step, accuracy, auc) of the kept bins.

    In a step the more important half of the bins is cut at its midpoints, until the narrowest bin is no wider than `limit`. With folds (column
    fold of labels) the bins of a fold are found on the other folds and scored on the fold; all folds take a step together, from one feature
    table that has the bins of several steps if they are few. Trees on the kept bins of a step are grown with those on the bins of the next, and
    all are scored in one pass. With one fold all rows are learnt from, and nothing is scored. Bins are parameters: their number stays as it began.
    """
    now, steps, scores = [bins] * folds, [[] for _ in range(folds)], []
    t, place, waiting, grown = None, {}, [], []  # waiting: growths on kept bins; grown: those and their forests, as long as there is no other table

    def score() -> None:
        tests, forests = [g for g, _ in grown], [f for _, f in grown]
        own = sinks.stage(T.tested(t, tests, forests)) if tests else None
        right = {r.growth: r.accuracy for r in own.groupBy("growth").agg(stats.accuracy(F.col("hit")).alias("accuracy")).collect()} if tests else {}
        auc = {r.growth: r.auc for r in stats.roc_auc(own, "growth").collect()} if tests else {}
        before = len(steps[0]) - len(tests) // folds
        scores.extend((g % folds, before + g // folds, right[g], auc[g]) for g in sorted(right))
        grown.clear()

    while (on := min(hi - lo for own in now for lo, hi in own) > limit) or waiting:
        if not on or any(b not in place for own in now for b in own):
            grown += zip(waiting, T.grow(t, waiting) if waiting else [], strict=True)
            score()
            waiting = []
            if not on:
                break
            place = {b: i for i, b in enumerate(ahead(now, limit))}
            t = T.table(models.binned(peaks, labels, list(place), vector=False), folds=("fold",) if folds > 1 else ())
            t = sinks.stage(T.compact(t) if growth.kind == "extra" else t)
        out = [((0, f),) if folds > 1 else () for f in range(folds)]
        each = [T.Growth(growth.kind, growth.trees, growth.depth, growth.features, out[f], out[f], tuple(place[b] for b in own), seed=growth.seed) for f, own in enumerate(now)]
        forests = T.grow(t, [*waiting, *each])
        grown += zip(waiting, forests, strict=False)
        kept = []
        for f, forest in enumerate(forests[len(waiting) :]):
            imp = T.importances(forest, len(place), each[f].use)[0]
            order = sorted(range(len(now[f])), key=lambda i, imp=imp: (-imp[i], i))
            kept.append(set(order[: len(order) - len(order) // 2]))
            steps[f].append([(*b, float(imp[i]), i in kept[f]) for i, b in enumerate(now[f])])
        if folds > 1:
            waiting = [T.Growth(g.kind, g.trees, g.depth, g.features, g.out, g.test, tuple(g.use[i] for i in sorted(kept[f])), seed=g.seed) for f, g in enumerate(each)]
        now = [halves([b for i, b in enumerate(own) if i in kept[f]]) for f, own in enumerate(now)]
    return steps, scores
