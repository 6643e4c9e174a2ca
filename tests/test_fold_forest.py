"""Forests of all folds together against the forest of each fold grown alone."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flock.operators import fold_forest as ff
from flock.operators import forest as fo
from flock.operators import models as md
from flock.operators import trees as tr
from flock.operators.sampling import stratified_folds

FEATURES = ["x", "noise", "kind", "part"]


def _people(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(int(i), float(x), float(z), k, float(i % 5)) for i, x, z, k in
            zip(range(n), rng.normal(size=n).round(1), rng.normal(size=n).round(2), rng.choice(list("pqrs"), n))]
    rows += [(n + i, 0.5, 0.1, None, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, x double, noise double, kind string, part double").repartition(3)
    y = (F.col("x") + F.col("noise") * F.col("part") + F.when(F.col("kind").isin("p", "s"), 0.7).otherwise(0.0)) > 0.4
    return df.withColumn("y", F.when(F.coalesce(y, F.lit(False)), "Stay").otherwise("Leave"))


@pytest.mark.parametrize("cells,chunk", [(1 << 21, 1 << 18), (50, 64)])
def test_every_fit_is_the_forest_grown_alone(spark, monkeypatch, cells, chunk):
    monkeypatch.setattr(ff, "MAX_CELLS", cells)
    monkeypatch.setattr(ff, "CHUNK", chunk)
    df = stratified_folds(_people(spark), "y", 3)
    features = tr.fit_bins(df, FEATURES, 64)
    rows = fo.rows_to_draw(df, F.col("y") == "Stay", features, keep=("fold",)).cache()
    settings = fo.Settings(4, 2, 5, 4, 11)
    forests = ff.fit(rows, features, settings, 3)
    stored = rows.collect()
    for fit in range(4):
        mine = [r for r in stored if r.fold != fit]
        want = {(r.tree, r.node): r for r in fo.fit(rows.where(F.col("fold") != fit), features, settings).splits.collect()}
        got = {(t, k): v for t, nodes in forests.nodes[fit].items() for k, v in nodes.items()}
        assert set(got) == set(want) and len(want) > 20
        width = max(tr.widths(features))
        for key, (f, bits, low, high) in got.items():
            r = want[key]
            left = set(np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=width)).tolist())
            present = {s.bins[f] for s in mine}
            assert f == r.feature and left & present == set(r.left_bins) & present
            for side, share in ((2 * key[1], low), (2 * key[1] + 1, high)):
                if (key[0], side) in want:
                    assert math.isclose(share, want[key[0], side].b / want[key[0], side].a)
    # a plain walk down the trees
    def share(fit, bins):
        total = 0.0
        for t in range(settings.trees):
            k, value = 1, forests.roots[fit][t]
            while k in forests.nodes[fit].get(t, {}):
                f, bits, low, high = forests.nodes[fit][t][k]
                left = np.unpackbits(np.frombuffer(bits, np.uint8))[bins[f]]
                k, value = (2 * k, low) if left else (2 * k + 1, high)
            total += value
        return total / settings.trees

    for fit in range(4):
        assert np.allclose(forests.share_of(fit)(np.array([r.bins for r in stored])), [share(fit, r.bins) for r in stored])
    right = forests.right_in_folds(rows)
    for f in range(3):
        held = [r for r in stored if r.fold == f]
        assert right[f] == (len(held), sum((share(f, r.bins) > 0.5) == (r.target > 0) for r in held))
    rows.unpersist()


def test_fits_that_split_alike_share_their_sums(spark, monkeypatch):
    """Eleven fits of plain rows take little more than the sums of one."""
    asked = []
    whole = ff._searched

    def seen(widths, text, settings, folds, slots):
        asked.append(sum(len(s) for s in slots.values()))
        return whole(widths, text, settings, folds, slots)

    monkeypatch.setattr(ff, "_searched", seen)
    df = spark.range(3000).select("id", (F.col("id") % 8).cast("double").alias("x"), F.when(F.col("id") % 8 > 3, "a").otherwise("b").alias("y"))
    cv = md.cv_forest(df, "y", folds=10, mtry=1, trees=5)
    assert asked == [5] and cv.accuracy == [[1.0] * 10]
    assert cv.predict(df).where("actual <> predicted").count() == 0


def test_predictions_of_the_best_setting_and_unseen_levels(spark):
    df = md.prepare(_people(spark), "y")
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0").withColumn("kind", F.when(F.col("id") % 8 == 0, "new").otherwise(F.col("kind")))
    cv = md.cv_forest(train, "y", folds=4, mtry=3, trees=20, grid={"max_nodes": [2, 14], "trees": [3, 20]})
    assert cv.settings == [{"maxDepth": d, "numTrees": t} for d in (1, 4) for t in (3, 20)]
    means = [sum(a) / 4 for a in cv.accuracy]
    best = cv.settings[means.index(max(means))]
    assert (cv.best.settings.max_depth, cv.best.settings.trees) == (best["maxDepth"], best["numTrees"])
    out = cv.predict(test).collect()
    assert len(out) == test.count() and {r.predicted for r in out} <= {"Leave", "Stay"}
    assert sum(r.actual == r.predicted for r in out) / len(out) > 0.6
    summary = md.cv_summary(cv).collect()
    assert [r.setting for r in summary][0] == "maxDepth=1, numTrees=3" and math.isclose(summary[3].accuracy, means[3])


def test_a_label_of_one_class_and_an_empty_fold(spark):
    one = spark.createDataFrame([(i, float(i % 7), "Stay") for i in range(30)], "id long, x double, y string")
    cv = md.cv_forest(one, "y", folds=3, mtry=1, trees=3)
    assert cv.accuracy == [[1.0] * 3] and {r.predicted for r in cv.predict(one).collect()} == {"Stay"}
    with pytest.raises(ValueError):
        md.cv_forest(one.limit(2), "y", folds=3, mtry=1, trees=3)
