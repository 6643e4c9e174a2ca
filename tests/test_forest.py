"""Random forests against a plain Python tree of the same draws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flock.operators import forest as fo
from flock.operators import models as md
from flock.operators import trees as tr


def _people(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), float(x), float(z), k, None if i % 11 == 0 else float(i % 5)) for i, x, z, k in
            zip(range(n), rng.normal(size=n).round(1), rng.normal(size=n).round(2), rng.choice(list("pqrs"), n))]
    rows += rows[:20] + [(None, 0.5, 0.1, None, 1.0)] * 3
    df = spark.createDataFrame(rows, "id long, x double, noise double, kind string, part double").repartition(3)
    y = (F.col("x") + F.col("noise") * F.col("part") + F.when(F.col("kind").isin("p", "s"), 0.7).otherwise(0.0)) > 0.4
    return df.withColumn("y", F.when(F.coalesce(y, F.lit(False)), "Stay").otherwise("Leave"))


def _inputs(df):
    features = tr.fit_bins(df, ["x", "noise", "kind", "part"], 64)
    return fo.rows_to_draw(df, F.col("y") == "Stay", features), features


def plain_splits(rows, features, settings, tree):
    """{node: (feature, left bins with rows, rows, weight, second class, gain)}, a node at a time."""
    key, target = np.array([r.key for r in rows]), np.array([r.target for r in rows])
    bins, w = np.array([r.bins for r in rows]), fo.weights(np.array([r.key for r in rows]), settings.seed, tree)
    assert len(key) == len(target)
    out, least = {}, max(1, settings.node_size)

    def worth(i):
        a, b = w[i].sum(), (w[i] * target[i]).sum()
        return -2 * b * (a - b) / a

    def grow(k, i):
        if k.bit_length() > settings.max_depth:
            return
        best = (1e-9,)
        for f in fo.drawn_features(np.array([k]), len(features), settings, tree)[0]:
            values = np.unique(bins[i, f]).tolist()
            if features[f].levels is not None:
                share = {v: (w[j] * target[j]).sum() / w[j].sum() for v in values for j in [i[bins[i, f] == v]]}
                values.sort(key=lambda v: (share[v], v))
            for c in range(1, len(values)):
                inside = np.isin(bins[i, f], values[:c])
                left, right = i[inside], i[~inside]
                if min(w[left].sum(), w[right].sum()) >= least:
                    gain = worth(left) + worth(right) - worth(i)
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, int(f), set(values[:c]), left, right)
        if len(best) > 1:
            out[k] = (best[1], best[2], len(i), w[i].sum(), (w[i] * target[i]).sum(), best[0])
            grow(2 * k, best[3])
            grow(2 * k + 1, best[4])

    grow(1, np.flatnonzero(w))
    return out


@pytest.mark.parametrize("most,settings", [(1 << 18, fo.Settings(3, 2)), (40, fo.Settings(3, 2)), (40, fo.Settings(2, 3, 7, 4, 5))])
def test_every_split_of_full_trees(spark, monkeypatch, most, settings):
    monkeypatch.setattr(fo, "MAX_ROWS", most)  # small: the first levels are grown by rounds over the table
    monkeypatch.setattr(fo, "BLOCK", 2)
    rows, features = _inputs(_people(spark))
    stored = rows.collect()
    forest = fo.fit(rows, features, settings)
    got = {}
    for r in forest.splits.collect():
        assert r.node not in got.setdefault(r.tree, {})
        got[r.tree][r.node] = r
    for t in range(settings.trees):
        want = plain_splits(stored, features, settings, t)
        assert set(got[t]) == set(want) and len(want) > 5
        present = {f: {r.bins[f] for r in stored} for f in range(len(features))}
        for k, (f, left, n, a, b, gain) in want.items():
            r = got[t][k]
            assert r.feature == f and (r.n, r.a, r.b) == (n, a, b) and math.isclose(r.gain, gain, rel_tol=1e-9)
            assert left <= set(r.left_bins) and (features[f].levels is None or left == set(r.left_bins) & present[f])
    sums = {(r.tree, r.feature): r.gain for r in forest.gains.collect()}
    for (t, f), gain in sums.items():
        assert math.isclose(gain, sum(r.gain for r in got[t].values() if r.feature == f), rel_tol=1e-9)
    assert {k for k in sums} == {(t, r.feature) for t in got for r in got[t].values()}


def test_equal_rows_draw_apart_and_the_layout_does_not_matter(spark):
    df = _people(spark)
    keys = [r.key for r in _inputs(df)[0].collect()]
    assert len(keys) == 323 and len(set(keys)) == 323  # 20 rows twice, 3 equal ones without an id
    assert sorted(keys) == sorted(r.key for r in _inputs(df.repartition(7))[0].collect())
    w = np.concatenate([fo.weights(np.array(keys), 987, t) for t in range(40)])
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.08 and abs((w == 0).mean() - math.exp(-1)) < 0.02


def test_nodes_draw_features_evenly():
    s = fo.Settings(1, 3)
    drawn = fo.drawn_features(np.arange(1, 4001), 8, s, 0)
    assert drawn.shape == (4000, 3) and (np.diff(drawn, axis=1) > 0).all()
    assert abs(np.bincount(drawn.reshape(-1), minlength=8) / 1500 - 1).max() < 0.1


def test_forest_importance_without_histograms_of_small_nodes(spark):
    df = _people(spark)
    model = md.fit_forest(df.fillna(0.0, subset=["part"]), "y", ["x", "noise", "kind", "part"], trees=30)
    out = md.importance(model, ["x", "noise", "kind", "part"]).collect()
    assert {r.feature for r in out} == {"x", "noise", "kind", "part"} and math.isclose(sum(r.importance for r in out), 1.0)
    assert [r.importance for r in out] == sorted((r.importance for r in out), reverse=True)
    plan = model.gains._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "MapInArrow" in plan


def test_forest_of_one_class_has_no_splits(spark):
    df = spark.createDataFrame([(i, float(i % 7), "Stay") for i in range(30)], "id long, x double, y string")
    model = md.fit_forest(df, "y", trees=3)
    assert model.splits.count() == 0
    assert [tuple(r) for r in md.importance(model, ["x"]).collect()] == [("x", 0.0)]
