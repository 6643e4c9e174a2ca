"""Histogram trees and boosting against small plain-Python ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flock.operators import trees as tr


def _rows(spark, m, y, features=None):
    cols = [f"x{i}" for i in range(m.shape[1])]
    data = [(int(i), float(t), *[None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r])
            for i, (t, r) in enumerate(zip(y, m.tolist()))]
    df = spark.createDataFrame(data, "id long, label double, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    features = features or tr.fit_bins(df, cols)
    return tr.binned(df, features), features


def _gini(y):
    return 2 * sum(y) * (len(y) - sum(y)) / len(y) if len(y) else 0.0


def plain_tree(m, y, min_split, min_bucket, max_leaves):
    """Best first: (feature, cut) of the leaf that gains most, as sets of row numbers."""
    leaves, gains = [list(range(len(y)))], []
    while len(leaves) < max_leaves:
        best = None
        for k, rows in enumerate(leaves):
            if len(rows) < min_split:
                continue
            for f in range(m.shape[1]):
                values = sorted(set(m[rows, f]))
                for lo, hi in zip(values, values[1:]):
                    left = [i for i in rows if m[i, f] <= lo]
                    right = [i for i in rows if m[i, f] > lo]
                    if min(len(left), len(right)) >= min_bucket:
                        g = _gini(y[rows]) - _gini(y[left]) - _gini(y[right])
                        if g > 1e-12 and (best is None or g > best[0] + 1e-9):
                            best = (g, k, left, right)
        if best is None:
            break
        leaves[best[1]:best[1] + 1] = [best[2], best[3]]
        gains.append(best[0])
    return sorted(map(tuple, leaves)), gains


@pytest.mark.parametrize("seed,max_leaves", [(1, 14), (2, 5), (3, 40)])
def test_best_first_trees(spark, seed, max_leaves):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(250, 4)).round(2)
    y = ((m[:, 0] + m[:, 1] * m[:, 2] + rng.normal(size=250)) > 0).astype(int)
    rows, features = _rows(spark, m, y)
    rules = tr.class_rules(10, 3, max_leaves, cp=0.0)
    tree = tr.grow({0: rows.select("bins", F.lit(1.0).alias("a"), F.col("label").alias("b"))}, features, rules)[0]
    want, gains = plain_tree(m, y, 10, 3, max_leaves)
    keyed = rows.select("id", tree.route(F.col("bins"), lambda v: float(id(v))).alias("leaf")).collect()
    got = {}
    for r in keyed:
        got.setdefault(r.leaf, []).append(r.id)
    assert sorted(tuple(sorted(v)) for v in got.values()) == want
    assert len(tree.leaves()) <= max_leaves and len(tree.leaves()) == len(want)
    assert math.isclose(sum(n.gain for n in tree.nodes.values() if n.feature >= 0), sum(gains), rel_tol=1e-9)
    for k, node in tree.nodes.items():
        assert node.n >= 3 and (node.feature < 0 or node.n >= 10)


def test_several_trees_at_once_and_layout(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(200, 3)).round(1)
    y = (m[:, 0] > 0.2).astype(int) ^ (rng.random(200) < 0.1)
    rows, features = _rows(spark, m, y)
    stats = [F.lit(1.0).alias("a"), F.col("label").alias("b")]
    rules = tr.class_rules(max_leaves=6, cp=0.0)
    parts = {7: rows, 9: rows.where("id % 2 = 0"), 11: rows.where("false")}
    many = tr.grow({t: part.select("bins", *stats) for t, part in parts.items()}, features, rules)
    assert set(many) == {7, 9}
    for t in many:
        alone = tr.grow({t: parts[t].repartition(5).select("bins", *stats)}, features, rules)[t]
        assert many[t].nodes == alone.nodes


def test_histograms_are_summed_in_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(150, 2)).round(1)
    m[::7, 1] = np.nan
    rows, features = _rows(spark, m, (m[:, 0] > 0.2).astype(int) ^ (rng.random(150) < 0.2))
    stats = {3: rows.select("bins", F.lit(1.0).alias("a"), F.col("label").alias("b"))}
    rules = tr.class_rules(max_leaves=8, cp=0.0)
    whole = tr.grow(stats, features, rules)
    cells = tr._histograms(stats, {3: [2, 3]}, whole | {3: whole[3].nodes}, features)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # no row a feature of every row
    assert {r.node: r.n for r in cells.groupBy("node", "feature").agg(F.sum("n").alias("n")).collect()} == {k: whole[3].nodes[k].n for k in (2, 3)}
    monkeypatch.setattr(tr, "MAX_CELLS", 1)  # a reading for every node
    assert tr.grow(stats, features, rules)[3].nodes == whole[3].nodes


def test_text_levels_and_unseen(spark):
    rows = [(i, "abcde"[i % 5], float(i % 5 in (1, 4))) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, kind string, label double")
    features = tr.fit_bins(df, ["kind"])
    assert features[0].levels == ("a", "b", "c", "d", "e")
    b = tr.binned(df, features)
    tree = tr.grow({0: b.select("bins", F.lit(1.0).alias("a"), F.col("label").alias("b"))}, features, tr.class_rules())[0]
    assert len(tree.leaves()) == 2 and set(tree.nodes[1].left_bins) == {0, 2, 3}
    assert b.where(tree.route(F.col("bins"), tr.majority) != F.col("label")).count() == 0
    other = tr.binned(spark.createDataFrame([("z",), (None,)], "kind string"), features)
    assert [r.bins for r in other.collect()] == [[-1], [-1]]


def test_bins_of_wide_and_constant_columns(spark):
    df = spark.range(5000).select((F.col("id") * 0.5).alias("u"), F.lit(3.0).alias("c"), F.when(F.col("id") > 9, 1.0).alias("n"), F.lit(None).cast("double").alias("z"))
    features = tr.fit_bins(df, ["u", "c", "n", "z"], max_bins=16)
    assert [len(f.cuts) for f in features] == [15, 0, 0, 0]
    sizes = [r["count"] for r in tr.binned(df, features).groupBy(F.col("bins")[0].alias("b")).count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2
    assert {tuple(r.bins[1:]) for r in tr.binned(df, features).collect()} == {(0, -1, -1), (0, 0, -1)}


def test_pruning_by_complexity():
    def node(a, b, f=-1):
        return tr.Node(a, a, b, feature=f)
    tree = tr.Tree({1: node(100, 40, 0), 2: node(60, 10, 1), 3: node(40, 30), 4: node(30, 5), 5: node(30, 5)})
    assert set(tr.prune(tree, 0.01).nodes) == {1, 2, 3}  # the split of 2 saves no error
    assert set(tr.prune(tree, 0.6).nodes) == {1}


def test_pruning_of_a_large_tree_is_not_repeated_for_every_node(monkeypatch):
    rng = np.random.default_rng(4)
    nodes, deep = {1: tr.Node(4096, 4096, 1500)}, []
    for k in range(1, 2 ** 9):  # every node sums up its subtree, pruned or not
        v, share = nodes[k], rng.uniform(0.2, 0.8, 2)
        nodes[k] = tr.Node(v.n, v.a, v.b, feature=0)
        a = v.a * share[0]
        b = min(a, v.b * share[1])
        nodes[2 * k], nodes[2 * k + 1] = tr.Node(a, a, b), tr.Node(v.a - a, v.a - a, min(v.b - b, v.a - a))

    def leaves(k, kept):
        return [k] if kept[k].feature < 0 else leaves(2 * k, kept) + leaves(2 * k + 1, kept)

    want = dict(nodes)  # the plain way: the weakest split of the tree as it is, again and again
    while inner := [k for k in want if want[k].feature >= 0]:
        cost = {k: (tr._risk(want[k]) - sum(tr._risk(want[j]) for j in under)) / (len(under) - 1) for k in inner for under in [leaves(k, want)]}
        k = min(cost, key=cost.get)
        if cost[k] > 0.002 * tr._risk(nodes[1]):
            break
        keep, stack = {1}, [1]
        want[k] = tr.Node(want[k].n, want[k].a, want[k].b)
        while stack:
            j = stack.pop()
            if want[j].feature >= 0:
                keep |= {2 * j, 2 * j + 1}
                stack += [2 * j, 2 * j + 1]
        want = {j: want[j] for j in keep}
    risk = tr._risk
    monkeypatch.setattr(tr, "_risk", lambda v: deep.append(1) or risk(v))
    got = tr.prune(tr.Tree(nodes), 0.002)
    assert set(got.nodes) == set(want) and 1 < len(want) < len(nodes)
    assert len(deep) < 20 * len(nodes)  # each node once, then the nodes above a pruned one


def plain_boost(m, y, rounds, eta, depth, reg, min_child):
    margin, total = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        step = np.zeros(len(y))

        def split(rows, level):
            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + reg)
            best = (1e-9, None)
            if level < depth:
                for f in range(m.shape[1]):
                    x = m[rows, f]
                    miss = rows[np.isnan(x)]
                    values = np.unique(x[~np.isnan(x)])
                    for v in values:
                        low, high = rows[x <= v], rows[x > v]
                        for left, right in ((low, np.r_[high, miss]), (np.r_[low, miss], high)):
                            left, right = left.astype(int), right.astype(int)
                            if min(h[left].sum(), h[right].sum()) >= min_child:
                                gain = worth(left) + worth(right) - worth(rows)
                                if gain > best[0] + 1e-9:
                                    best = (gain, left, right)
            if best[1] is None:
                step[rows] = -eta * g[rows].sum() / (h[rows].sum() + reg)
            else:
                split(best[1], level + 1)
                split(best[2], level + 1)
        split(np.arange(len(y)), 0)
        margin = margin + step
        total.append(float(np.mean(np.log1p(np.exp(np.where(y > 0, -margin, margin))))))
    return margin, total


def test_two_rounds_match_plain_boosting(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(220, 4)).round(1)
    m[rng.random(m.shape) < 0.15] = np.nan
    y = ((np.nan_to_num(m[:, 0], nan=2.0) + np.nan_to_num(m[:, 1]) * 0.7 + rng.normal(size=220) * 0.5) > 0.3).astype(float)
    rows, features = _rows(spark, m, y)
    booster = tr.boost({0: rows}, features)[0]
    want, losses = plain_boost(m, y, 2, 0.3, 3, 1.0, 1.0)
    got = {r.id: r.f for r in rows.select("id", booster.margin(F.col("bins")).alias("f")).collect()}
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-9)
    for k in (1, 2):
        loss = rows.agg(F.avg(tr.log_loss(booster.margin(F.col("bins"), k), F.col("label")))).first()[0]
        assert math.isclose(loss, losses[k - 1], rel_tol=1e-9)
    imp = tr.gain_cover_frequency(booster)
    assert all(math.isclose(sum(r[i] for r in imp), 1.0) for i in (1, 2, 3)) and imp[0][0] == "x0"
