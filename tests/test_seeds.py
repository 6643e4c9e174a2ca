"""Splits, folds, trees and boosters of all seeds together."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flock.operators import models as md
from flock.operators import sampling as sm
from flock.operators.trees import log_loss


def _people(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "noise": rng.normal(size=n).round(1), "kind": rng.choice(list("pqr"), n),
                        "y": np.where(x + rng.normal(size=n) * 0.4 > 0.2, "LeaveTheChurch", "StayAtChurch")})
    return spark.createDataFrame(pdf)


def test_splits_of_all_seeds_equal_each_split(spark):
    rows = [(i if i % 50 else None, [None, "a", "b", "only"][0 if i % 9 == 0 else 1 + i % 2]) for i in range(300)] + [(1000, "only"), (2000, "tiny"), (2001, "tiny")]
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "id long, s string").repartition(3)
    seeds = (987, 887, 7)
    got = {r.id: r.in_train for r in sm.stratified_splits(df, "s", seeds).collect()}
    assert len(got) == df.count() and got[1000] == [False] * 3  # floor(0.8) of one row
    for i, s in enumerate(seeds):
        alone = {r.id: r.split == "train" for r in sm.stratified_split(df, "s", 0.8, s).collect()}
        assert alone == {k: v[i] for k, v in got.items()}
    assert sm.stratified_splits(df.limit(0), "s", seeds).count() == 0
    assert all(v == [False] for v in (r.in_train for r in sm.stratified_splits(df, "s", (1,), prop=0.0).collect()))


def test_splits_never_broadcast_the_rows(spark, tmp_path):
    path = str(tmp_path / "people")
    spark.range(4000).select("id", F.when(F.col("id") % 7 > 0, "a").otherwise("b").alias("s")).write.parquet(path)
    df = spark.read.parquet(path)
    out = sm.stratified_splits(df, "s", md.SEEDS)
    got = out.collect()
    train = {"a": 3428 * 8 // 10, "b": 572 * 8 // 10}
    assert all(sum(r.in_train[i] for r in got if r.s == s) == n for s, n in train.items() for i in range(len(md.SEEDS)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BuildRight" in plan and "BuildLeft" not in plan


def test_folds_do_not_change_with_the_layout(spark):
    df = _people(spark, 203)
    a, b = ({r.id: r.fold for r in sm.stratified_folds(df.repartition(p), "y", 10, 987).collect()} for p in (1, 7))
    assert a == b and set(a.values()) == set(range(10))
    per = sm.stratified_folds(df, "y", 10).groupBy("y", "fold").count().toPandas()
    assert all(g["count"].max() - g["count"].min() <= 1 for _, g in per.groupby("y"))


def test_cross_validation_does_not_change_with_the_layout(spark):
    df = md.prepare(_people(spark, 160), "y")
    fit = [md.cv_summary(md.cv_forest(df.repartition(p), "y", folds=2, mtry=2, trees=3)).collect() for p in (1, 5)]
    assert [r.setting for r in fit[0]] == [r.setting for r in fit[1]] and all(0.5 < r.accuracy <= 1 for f in fit for r in f)


def test_trees_of_two_seeds(spark):
    df = _people(spark)
    pred, grown = md.seeded_trees(df, "y", (987, 87), max_leaves=14, cp=0.0)
    assert set(grown) == {987, 87} and all(len(t.leaves()) <= 14 for t in grown.values())
    for s in (987, 87):
        held = {r.id for r in sm.stratified_split(df, "y", 0.8, s).where("split = 'test'").collect()}
        rows = pred.where(F.col("seed") == s).collect()
        assert {r.id for r in rows} == held and len(rows) == len(held)
        assert sum(r.actual == r.predicted for r in rows) / len(rows) > 0.8
    again = md.seeded_trees(df.repartition(7), "y", (87,), max_leaves=14, cp=0.0)[1][87]
    assert again.nodes == grown[87].nodes
    for t in grown.values():
        assert all(n.n >= 3 for n in t.nodes.values()) and all(n.n >= 10 for n in t.nodes.values() if n.feature >= 0)


def test_reports_of_seeds(spark):
    rounds = md.tree_rounds(_people(spark), "y", (987, 887, 787))
    out = md.round_summary(rounds).toPandas().set_index("stat")
    assert set(out.index) == {"987", "887", "787", "mean", "sd"} and (out.loc[["987", "887", "787"], "accuracy"] > 0.75).all()
    assert math.isclose(out.loc["mean", "kappa"], out.loc[["987", "887", "787"], "kappa"].mean())
    assert math.isclose(out.loc["sd", "accuracy"], out.loc[["987", "887", "787"], "accuracy"].std())


def test_boosters_of_seeds(spark):
    df = _people(spark).select("id", "x", F.when(F.col("id") % 5 > 0, F.col("noise")).alias("noise"), F.lit(None).cast("double").alias("empty"),
                               (F.col("y") == "StayAtChurch").cast("double").alias("y"))
    margins, boosters = md.seeded_boosters(df, "y", (987, 87))
    rows = margins.toPandas()
    assert len(rows) == 800 and rows.groupby("seed").in_train.sum().nunique() == 1
    watch = md.watch_list(margins).toPandas().set_index(["seed", "round", "dataset"]).loss
    for (seed, k, part), loss in watch.items():
        g = rows[(rows.seed == seed) & (rows.in_train == (part == "train"))]
        p = 1 / (1 + np.exp(-g[f"margin{k}"]))
        assert math.isclose(loss, -np.mean(np.where(g.actual > 0, np.log(p), np.log(1 - p))), rel_tol=1e-9)
    assert all(watch[s, 2, "train"] < watch[s, 1, "train"] < math.log(2) for s in (987, 87))
    assert all(len(b.rounds) == 2 and all(max(t.nodes) < 16 for t in b.rounds) for b in boosters.values())
    report = md.boosted_rounds(df, "y", (987, 87)).toPandas().set_index("seed")
    assert (report.accuracy > 0.8).all() and math.isclose(report.test_log_loss[987], watch[987, 2, "test"])


@pytest.mark.parametrize("m,want", [(1000.0, 0.0), (-1000.0, 1000.0), (0.0, math.log(2))])
def test_log_loss_does_not_overflow(spark, m, want):
    assert math.isclose(spark.range(1).select(log_loss(F.lit(m), F.lit(1.0))).first()[0], want, abs_tol=1e-12)


def test_three_classes_are_refused(spark):
    with pytest.raises(ValueError):
        md.two_levels(spark.createDataFrame([("a",), ("b",), ("c",)], "y string"), "y")
