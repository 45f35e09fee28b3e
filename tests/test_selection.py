"""Model selection on grown forests: folds, prefixes, permuted copies and rates by plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spectraline.operators import forests as T
from spectraline.operators import models, selection

SMALL = T.Growth("extra", 6, 4)


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
    return spark.createDataFrame(rows, "id long, features array<double>, target int, grp int, region int").cache()


def test_nested_folds_by_loop(table):
    """The inner folds of an outer fold deal the other rows of a class in turn, in md5 order."""
    out = {r.id: r for r in selection.nested_folds(table, 5).collect()}
    for y in (0, 1):
        ids = sorted((i for i in out if i % 2 == y), key=lambda i: (hashlib.md5(f"{i}|11".encode()).hexdigest(), i))
        assert [out[i].outer for i in ids] == [k % 5 for k in range(len(ids))]
        for o in range(5):
            rest = [i for i in ids if out[i].outer != o]
            assert [out[i][f"inner{o}"] for i in rest] == [k % 5 for k in range(len(rest))]
            assert all(out[i][f"inner{o}"] == -1 for i in ids if out[i].outer == o)


def test_nested_cv_takes_the_best_of_the_inner_folds(table):
    counts, depths, kinds = (2, 6), (1, 3), (("extra", "sqrt"), ("tree", "all"))
    out = {r.outer: r for r in selection.nested_cv(table, 3, counts, depths, kinds).collect()}
    assert sorted(out) == [-1, 0, 1, 2] and out[-1].accuracy is None
    folded = selection.nested_folds(table, 3)
    t = T.table(folded, folds=("outer", "inner0", "inner1", "inner2")).cache()
    for o in (-1, 0):
        plans = [(((0, i),), ((0, i),)) if o < 0 else (((1 + o, -1), (1 + o, i)), ((1 + o, i),)) for i in range(3)]
        best = {}
        for k, (kind, features) in enumerate(kinds):
            for trees in counts:
                for depth in depths:
                    one = [T.Growth(kind, trees, depth, features, *p) for p in plans]
                    found = [r.accuracy for r in T.settings_scores(t, one, T.grow(t, one)).collect()]
                    trees_ = 1 if kind == "tree" else trees
                    best[-round(float(np.mean(found)), 12), k, trees_, depth] = kind, features, trees_, depth
        assert best[min(best)] == (out[o].kind, out[o].features, out[o].trees, out[o].depth) and out[o].selected == pytest.approx(-min(best)[0])
    assert min(out[o].accuracy for o in range(3)) > 0.8


def test_cv_scores(table):
    folded = models.stratified_folds(table, 3)
    out = {r.fold: r for r in selection.cv_scores(folded, T.Growth("forest", 5, 3)).collect()}
    t = T.table(folded, folds=("fold",)).cache()
    for f in range(3):
        growth = [T.Growth("forest", 5, 3, out=((0, f),), test=((0, f),))]
        forest = T.grow(t, growth)
        assert out[f].accuracy == pytest.approx(T.settings_scores(t, growth, forest).first().accuracy) and out[f].auc > 0.85
        score = {r.id: r.score for r in T.predicted(t, forest).collect()}
        own = [(score[r.id], r.target) for r in folded.filter(f"fold = {f}").collect()]
        wins = [(a > b) + 0.5 * (a == b) for a, y in own if y for b, z in own if not z]
        assert out[f].auc == pytest.approx(np.mean(wins))


def test_grid_search(table):
    out = selection.grid_search(table, 3, (2, 4), (1, 2), (("forest", "all"), ("tree", "all"))).collect()
    assert Counter(r.kind for r in out) == {"forest": 4, "tree": 2} and out[0].accuracy == max(r.accuracy for r in out)


def test_learning_curve(table):
    out = {round(r.share, 2): r.mean for r in selection.learning_curve(table, 4, 2, SMALL).collect()}
    assert sorted(out) == [0.25, 0.5, 0.75, 1.0] and out[1.0] > 0.8


def test_selection_assessment(table):
    out = selection.selection_assessment(table, 3, 2, SMALL).collect()
    assert len(out) == 3 and all(2 in r.features and len(r.features) == 2 and r.accuracy > 0.8 for r in out)


def test_copies_are_permutations_inside_blocks(spark, table):
    rows = {r.id: r for r in selection.with_copies(table, 2).collect()}
    ids = sorted(rows)
    for b in (1, 2):
        order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}|{b}".encode()).digest(), i))
        for i, j in zip(ids, order, strict=True):
            assert rows[i].features[8 * b : 8 * b + 8] == rows[j].features[:8] and rows[i].targets[b] == rows[j].targets[0]
    many = spark.range(9000).selectExpr("id", "array(double(id)) as features", "int(id % 2) as target")
    assert many.select(selection.block_of("id", 9000).alias("b")).distinct().count() == 3
    out = selection.with_copies(many, 1).collect()
    assert sorted(r.features[1] for r in out) == list(map(float, range(9000)))


def test_permutation_rates_by_loop(table):
    rows = {r.id: r for r in table.collect()}
    ids, copies = sorted(rows), 20
    x, y = np.array([rows[i].features for i in ids]), np.array([rows[i].target for i in ids])
    score = lambda t: np.round(np.abs(x[t == 1].mean(0) - x[t == 0].mean(0)), 9)
    real, perm = score(y), np.concatenate([score(y[o]) for o in selection.orders(ids, copies)])
    want, top = {}, 0.0
    for rank, c in enumerate(np.argsort(-real, kind="stable"), 1):
        top = max(top, min(1.0, (perm >= real[c]).sum() / copies / rank))
        want[int(c)] = top
    got = {r.channel: r.fdr for r in selection.permutation_fdr(selection.permuted_scores(table, copies), copies).collect()}
    assert got == pytest.approx(want) and got[2] == 0.0


def test_permutation_importance_equals_the_plain_loop(table):
    """Every feature of every row is put in from another row, and all trees score all rows again."""
    repeats = 2
    t = selection.with_copies(table, repeats)
    forest = T.grow(t, [T.Growth("forest", 6, 4, use=tuple(range(8)), seed=11)])[0]
    rows = sorted(t.collect(), key=lambda r: r.id)
    x, y = np.array([r.features for r in rows]), np.array([r.targets[0] for r in rows])

    def score(tree, v):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] + int(v[tree.feature[node]] > tree.cut[node])
        a, b = tree.weight[node]
        return b / (a + b)

    def accuracy(z):
        return np.mean([(round(sum(score(tree, v) for tree in forest), 9) > 3) == (c == 1) for v, c in zip(z, y, strict=True)])

    base = accuracy(x[:, :8])
    got = {r.channel: r for r in selection.permutation_importance(table, repeats, T.Growth("forest", 6, 4)).collect()}
    for f in range(8):
        each = []
        for r in range(repeats):
            z = x[:, :8].copy()
            z[:, f] = x[:, 8 * (r + 1) + f]
            each.append(accuracy(z))
        assert got[f].drop == pytest.approx(base - np.mean(each)) and got[f].std == pytest.approx(np.std(each))
    assert max(got, key=lambda f: got[f].drop) == 2


def test_importances_and_contrasts(table):
    imp = selection.importances(table).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1) and max(imp, key=lambda r: r.importance).channel == 2
    fwer = {r.channel: r.fwer for r in selection.mprobes(table, 2, T.Growth("extra", 20, 4)).collect()}
    assert fwer[2] == 0.0 and set(fwer) == set(range(8))


def test_conditional_errors(table):
    """With correlations as importances the telling feature has no error, and rates beyond the stop are left open."""

    def importance(t, asked):
        rows = t.collect()
        x, y = np.array([r.features for r in rows]), np.array([r.targets for r in rows])
        return [np.array([abs(np.corrcoef(x[:, f], y[:, place])[0, 1]) for f in use]) for place, use in asked]

    one, all_ = (selection.conditional_errors(table, 4, stop=0.1, at_once=n, importance=importance).orderBy("rank").collect() for n in (1, 8))
    assert one == all_
    assert one[0].channel == 2 and (one[0].fdr, one[0].cer, one[0].efdr) == (0.0, 0.0, 0.0) and one[1].channel == 5 and one[1].cer == 0.0
    for name in ("fdr", "cer", "efdr"):
        x = [r[name] for r in one if r[name] is not None]
        assert x == sorted(x) and all(0 <= v <= 1 for v in x)
    assert any(r.cer is None for r in one) and [r.importance for r in one] == sorted((r.importance for r in one), reverse=True)
    grown = selection.conditional_errors(table, 2).collect()
    assert grown[0].channel == 2 and grown[0].cer == 0.0 and len(grown) == 8


@pytest.mark.parametrize("folds", [1, 2])
def test_progressive_bins(spark, folds):
    rng = random.Random(1)
    rows = [(i, rng.uniform(0, 100), 1.0) for i in range(120) for _ in range(6)] + [(i, rng.uniform(60, 62), 30.0) for i in range(0, 120, 2) for _ in range(3)]
    p = spark.createDataFrame(rows, "id long, mz double, intensity double").cache()
    t = spark.createDataFrame([(i, 1 - i % 2, i % 4, 0) for i in range(120)], "id long, target int, grp int, region int").cache()
    if folds > 1:
        t = models.stratified_folds(t, folds)
    each, scores = selection.progressive_binning(p, t, [(i * 20.0, i * 20.0 + 20) for i in range(5)], 6.0, folds)
    assert len(each) == folds and len(scores) == (2 * folds if folds > 1 else 0)
    for steps in each:
        assert [len(x) for x in steps] == [5, 6] and [sum(k for *_, k in x) for x in steps] == [3, 3]
        assert all(any(lo <= 61 <= hi and kept for lo, hi, _, kept in x) for x in steps)
    assert all(accuracy > 0.9 and auc > 0.9 for _, _, accuracy, auc in scores)


def test_forward_selection(table):
    """Each step's feature is the best of all by forests grown one at a time."""
    folded = models.stratified_folds(table, 2)
    out = selection.forward_selection(folded, growth=T.Growth("extra", 5, 3, "all")).orderBy("step").collect()
    assert out[0].channel == 2 and [r.score for r in out] == sorted(r.score for r in out)
    t = T.table(folded, folds=("fold",)).cache()
    have, scores = [], {}
    for step in out:
        scores = {}
        for c in set(range(8)) - set(have):
            each = [T.Growth("extra", 5, 3, "all", ((0, f),), ((0, f),), (*have, c)) for f in (0, 1)]
            scores[c] = np.mean([r.accuracy for r in T.settings_scores(t, each, T.grow(t, each)).collect()])
        assert step.channel == max(scores, key=lambda c: (round(scores[c], 12), -c)) and step.score == pytest.approx(scores[step.channel])
        have.append(step.channel)
        if len(have) == 1:
            break
