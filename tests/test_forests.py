"""Trees grown together against plain recursion on 200 rows; folds, weights, prefixes and edge cases."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraline.operators import forests as T

SCHEMA = "id long, features array<double>, target int, other int, w double, fold int"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)).round(2)
    y = ((x[:, 1] + 0.4 * x[:, 3] + rng.normal(size=200) * 0.3) > 0).astype(int)
    return x, y, rng.integers(0, 2, 200), rng.integers(1, 4, 200).astype(float), rng.integers(0, 5, 200)


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, other, w, fold = data
    made = [(i, x[i].tolist(), int(y[i]), int(other[i]), float(w[i]), int(fold[i])) for i in range(200)]
    return T.table(spark.createDataFrame(made, SCHEMA).repartition(5, "id"), ("target", "other"), ("fold",), "w").cache()


def gini_gain(w, y, left):
    def side(m):
        return sum((w[m & (y == c)].sum()) ** 2 for c in (0, 1)) / w[m].sum() if w[m].sum() else 0.0

    return side(left) + side(~left) - side(np.ones(len(y), bool))


def plain(g, number, x, y, w, cuts):
    """The tree by recursion over subsets of rows; nodes come in the order of levels, as the builder makes them."""
    tree = T.Tree(0, number)
    tree.weight[0] = tuple(float(w[y == c].sum()) for c in (0, 1))
    inside = {0: np.arange(len(y))}
    while tree.open:
        tries, nodes, tree.open = T.tried(g, tree, x.shape[1]), tree.open, []
        for node, fs in zip(nodes, tries, strict=True):
            at, best = inside[node], None
            u = np.random.default_rng((g.seed, number, node, 1)).random(len(fs))
            for k, f in enumerate(fs):
                v = x[at, f]
                own = [v.min() + u[k] * (v.max() - v.min())] if g.kind == "extra" else cuts[f][np.isfinite(cuts[f])]
                for c in own:
                    left = v <= c
                    if left.any() and not left.all():
                        gain = gini_gain(w[at], y[at], left)
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, int(f), float(c), left
            if best is None or not best[0] > 1e-12 * w[at].sum():
                continue
            tree.feature[node], tree.cut[node], tree.left[node], tree.gain[node] = best[1], best[2], len(tree.feature), best[0]
            for left in (best[3], ~best[3]):
                sub = at[left]
                side = tuple(float(w[sub][y[sub] == c].sum()) for c in (0, 1))
                inside[len(tree.feature)] = sub
                if min(side) > 0 and tree.depth[node] + 1 < g.depth:
                    tree.open.append(len(tree.feature))
                for values, new in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, 0), (tree.weight, side), (tree.gain, 0.0), (tree.depth, tree.depth[node] + 1)):
                    values.append(new)
    return tree


@pytest.mark.parametrize("kind", ["extra", "tree"])
@pytest.mark.parametrize("features", ["sqrt", "all"])
def test_same_trees_as_plain_recursion(rows, data, kind, features):
    x, y, other, w, fold = data
    growths = [T.Growth(kind, 3, 5, features, out=((0, f),), target=t, use=u) for f, t, u in ((0, 0, None), (3, 1, None), (1, 0, (0, 1, 4)))]
    cuts = T.quantile_cuts(rows, 6)
    for g, forest in zip(growths, T.grow(rows, growths), strict=True):
        keep = fold != g.out[0][1]
        for tree in forest:
            want = plain(g, tree.number, x[keep], (y, other)[g.target][keep], w[keep], cuts)
            assert tree.feature == want.feature and tree.left == want.left and tree.depth == want.depth
            assert tree.cut == pytest.approx(want.cut) and tree.gain == pytest.approx(want.gain) and np.allclose(tree.weight, want.weight)


def test_forest_weights_are_poisson(rows, data):
    mark = np.array([r.mark for r in rows.select("mark").collect()]).view(np.uint64)
    drawn = np.concatenate([T.poisson(mark, 11, k) for k in range(200)])
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03 and (T.poisson(mark, 11, 0) != T.poisson(mark, 11, 1)).any()


def test_smaller_settings_are_parts_of_the_grown_ones(rows, data):
    x, y, _, w, fold = data
    growths = [T.Growth(kind, 8, 5, out=((0, f),), test=((0, f),)) for kind in ("extra", "forest") for f in (0, 1)]
    small = [T.Growth(g.kind, 3, 2, out=g.out, test=g.test) for g in growths]
    big, few = T.grow(rows, growths), T.grow(rows, small)
    one = {(r.growth, r.trees, r.depth): (r.accuracy, r.weight) for r in T.settings_scores(rows, growths, big, (3, 8), (2, 5)).collect()}
    two = {(r.growth, r.trees, r.depth): (r.accuracy, r.weight) for r in T.settings_scores(rows, small, few).collect()}
    assert all(one[k] == pytest.approx(v) for k, v in two.items()) and len(two) == 4 and len(one) == 16
    for g, own in enumerate(growths):
        test = fold == own.test[0][1]
        score = {r.id: r.score for r in T.predicted(rows, big).filter(F.col("growth") == g).collect()}
        hit = np.array([(score[i] > 0.5) == (y[i] == 1) for i in range(200)])
        assert one[g, 8, 5][0] == pytest.approx((w * hit)[test].sum() / w[test].sum())
        assert one[g, 8, 5][0] > 0.7


def test_importances_find_the_features(rows):
    mean, _ = T.importances(T.grow(rows, [T.Growth("extra", 40, 5)])[0], 6)
    assert mean.argmax() == 1 and mean.sum() == pytest.approx(1)


def test_partial_sums_meet_in_two_steps(rows, monkeypatch):
    growths = [T.Growth("extra", 3, 4), T.Growth("tree", 1, 4)]
    want = T.grow(rows, growths)
    monkeypatch.setattr(T, "MERGED", 2)
    monkeypatch.setattr(T, "MOST_SUMS", 200)
    got = T.grow(rows, growths)
    assert [[(t.feature, t.cut) for t in f] for f in got] == [[(t.feature, t.cut) for t in f] for f in want]


def test_edges(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    (tree,) = T.grow(T.table(none), [T.Growth("tree")])[0]
    assert tree.feature == [-1] and T.predicted(T.table(none), [[tree]]).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0], 1, 0, 1.0, 0), (2, [1.0, 3.0], None, 0, 1.0, 0), (3, [1.0, 2.0], 0, 0, None, None), (4, [1.0, 5.0], 0, 0, 2.0, None)], SCHEMA)
    t = T.table(odd, folds=("fold",), weight="w")
    (tree,) = T.grow(t, [T.Growth("extra", 1, 3, "all")])[0]
    assert tree.feature[0] == 1 and sorted(tree.weight[1:]) == [(0.0, 1.0), (2.0, 0.0)]
    same = odd.withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    (tree,) = T.grow(T.table(same), [T.Growth("forest", 1, 3)])[0]
    assert tree.feature == [-1] and tree.weight[0] == (2.0, 1.0)
    monster = T.Tree(0, 0, feature=[-1] * (T.MOST_NODES + 1))
    with pytest.raises(ValueError, match="nodes"):
        T.packed([monster], 2, [T.Growth()])


@pytest.mark.parametrize("kind", ["extra", "tree", "forest"])
def test_large_and_broken_weights(spark, data, kind):
    """Weights that are counted by binary digits, and those that are not whole, give the plain sums of a tree's nodes."""
    x, y, *_ = data
    rng = np.random.default_rng(2)
    for w in (rng.integers(1, 900, 200).astype(float), rng.random(200), np.ones(200)):
        made = [(i, x[i].tolist(), int(y[i]), 0, float(w[i]), 0) for i in range(200)]
        t = T.table(spark.createDataFrame(made, SCHEMA).repartition(3, "id"), weight="w").cache()
        cuts = T.quantile_cuts(t, 6)
        mark = np.array([r.mark for r in t.orderBy("id").select("mark").collect()]).view(np.uint64)
        for features in ("sqrt", "all"):
            for tree in T.grow(t, [T.Growth(kind, 2, 4, features)])[0]:
                own = w * T.poisson(mark, 11, tree.number) if kind == "forest" else w
                keep = own > 0
                want = plain(T.Growth(kind, 2, 4, features), tree.number, x[keep], y[keep], own[keep], cuts)
                want.weight[0] = tree.weight[0] if kind == "forest" and tree.feature[0] < 0 else want.weight[0]
                assert tree.feature == want.feature and tree.left == want.left and tree.cut == pytest.approx(want.cut) and np.allclose(tree.weight, want.weight)


def test_counts_of_columns_are_plain_histograms():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, T.BINS, (700, 5))
    words = np.zeros((701, 5), np.uint64)
    words[:-1] = np.uint64(1) << (codes * 4).astype(np.uint64)
    group, rows, tries = rng.integers(0, 4, 700), np.arange(700), np.array([[0, 3], [4, 1]])
    for w in (np.ones(700), rng.integers(1, 4, 700).astype(float), rng.integers(1, 5000, 700).astype(float)):
        columns, of, total = T.dealt(rows, group, w, 4, 700)
        assert list(total) == [w[group == g].sum() for g in range(4)]
        for whole in (True, False):
            x = T.laid(words, columns, tries, of % 4 // 2, whole).sum(axis=0, dtype=np.uint64)
            got = T.histograms(x if whole else x.T, of, 4).reshape(4, -1, 2, T.BINS // 2).swapaxes(2, 3).reshape(4, -1, T.BINS)
            for g in range(4):
                for k, f in enumerate(range(5) if whole else tries[g // 2]):
                    assert list(got[g, k]) == list(np.bincount(codes[group == g, f], w[group == g], minlength=T.BINS))


def test_roots_of_trees_with_the_same_rows_are_laid_once(rows, monkeypatch):
    batch = rows.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    growths = [T.Growth("extra", 10, 2, "sqrt"), T.Growth("extra", 10, 2, "all"), T.Growth("forest", 2, 2, "sqrt"), T.Growth("forest", 2, 2, "all")]
    trees = [T.Tree(i, k) for i, g in enumerate(growths) for k in range(g.trees)]
    held = SimpleNamespace(value=T.packed(trees, 6, growths))
    monkeypatch.setattr(T, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    laid, calls = T.laid, []
    monkeypatch.setattr(T, "laid", lambda *a: calls.append(1) or laid(*a))
    out = list(T.partial(growths, [(t.growth, t.number) for t in trees], np.zeros(24, int), held, T.quantile_cuts(rows, 6), False, 0)(iter([batch])))
    assert sum(b.num_rows for b in out) == 24 and len(calls) == 3
