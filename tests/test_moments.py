"""Moment matrices, principal components and multi-start k-means against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flock.operators import models as md
from flock.operators import moments as mo


def _table(spark, seed=1, n=300):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + np.array([1e6, 0, -3, 5])
    return m, spark.createDataFrame(pd.DataFrame(m, columns=list("abcd")).assign(id=range(n))).repartition(4)


def test_moments_of_large_means(spark):
    m, df = _table(spark)
    got = mo.moments(df, list("abcd"))
    assert got.n == 300 and np.allclose(got.mean, m.mean(axis=0), rtol=1e-12)
    assert np.allclose(got.products / 299, np.cov(m.T), rtol=1e-8) and np.allclose(got.correlation(), np.corrcoef(m.T), rtol=1e-8)
    assert np.allclose(got.sd, m.std(axis=0, ddof=1))


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 5, None), (2.0, 5, None), (4.0, 5, None)], "a double, b int, c int")
    c = mo.moments(df, ["a", "b", "c"]).correlation()
    assert np.isclose(c[0, 0], 1) and np.isnan(c[0, 1]) and np.isnan(c[1, 1]) and np.isnan(c[2, 2])
    assert mo.moments(df.limit(0), ["a", "b"]).n == 0


def test_components_trace_rotation_and_scores(spark):
    m, df = _table(spark, 3)
    got = mo.moments(df, list("abcd"))
    loadings, variance = mo.principal_components(got)
    assert np.isclose(variance.sum(), 4) and np.allclose(loadings.T @ loadings, np.eye(4), atol=1e-12) and (np.diff(variance) <= 0).all()
    z = (m - m.mean(axis=0)) / m.std(axis=0, ddof=1)
    scores = mo.project(df, list("abcd"), got, loadings).orderBy("id").toPandas()
    assert np.allclose(scores[[f"pc{i}" for i in range(1, 5)]].to_numpy(), z @ loadings, atol=1e-7)
    assert np.allclose(scores.drop(columns="id").var(ddof=1), variance)
    table, flipped, shares = md.pca(df, list("abcd"), k=2)
    assert np.allclose(table.orderBy("variable").toPandas()[["pc1", "pc2"]].to_numpy(), -loadings[:, :2]) and len(shares) == 2
    assert flipped.columns == ["id", "pc1", "pc2"]


def plain_lloyd(x, centres, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres, ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


@pytest.mark.parametrize("seed", [1, 2])
def test_all_starts_equal_separate_ones(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(60, 3)) + 4 * rng.normal(size=3) for _ in range(5)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])).repartition(3)
    cols = ["a", "b", "c"]
    starts = mo.start_centres(df, cols, 4, 7, seed)
    assert starts.shape == (7, 4, 3) and all(len(np.unique(s, axis=0)) == 4 for s in starts)
    assert np.array_equal(starts, mo.start_centres(df.repartition(5), cols, 4, 7, seed))
    centres, sizes, costs = mo.kmeans(df, cols, starts, max_iter=6)
    for i in range(7):
        want, cost = plain_lloyd(x, starts[i], 6)
        assert np.allclose(centres[i], want) and np.isclose(costs[i], cost) and sizes[i].sum() == len(x)
    prof = md.kmeans_profile(df, cols, k=4, starts=7, seed=seed, max_iter=6).toPandas()
    assert np.isclose(prof.total_within_ss[0], costs.min()) and prof["size"].sum() == len(x)


def test_the_table_is_read_once_an_iteration_for_all_starts(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(50)], "a double, b double")
    starts, sc, tracker = mo.start_centres(df, ["a", "b"], 2, 25, 1), spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("kmeans-all", "all starts")
    mo.kmeans(df, ["a", "b"], starts, max_iter=3)
    many = len(tracker.getJobIdsForGroup("kmeans-all"))
    sc.setJobGroup("kmeans-one", "one start")
    mo.kmeans(df, ["a", "b"], starts[:1], max_iter=3)
    one = len(tracker.getJobIdsForGroup("kmeans-one"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert one <= many <= 4 * max(1, one // 2)


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        mo.start_centres(spark.createDataFrame([(1.0,), (1.0,)], "a double"), ["a"], 2, 3, 1)
    assert md.kmeans_profile(spark.createDataFrame([(1.0,), (2.0,), (None,)], "a double"), ["a"], k=3, starts=2).agg(F.sum("size")).first()[0] == 3
