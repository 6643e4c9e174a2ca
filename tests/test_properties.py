"""Property tests: split sizes, histogram totals, KDE and loess against direct
numpy computations, running totals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flock.functions import numeric
from flock.operators import metrics, profile, ranks, sampling, smooth


def test_stratified_split_exact_sizes(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(5000), "s": rng.choice(["a", "b", "c"], 5000, p=[0.6, 0.3, 0.1])})
    df = spark.createDataFrame(pdf)
    out = sampling.stratified_split(df, "s", 0.8, seed=987).toPandas()
    assert len(out) == 5000 and set(out.id) == set(range(5000))
    for s, g in out.groupby("s"):
        assert (g.split == "train").sum() == math.floor(0.8 * len(g))
    # same rows as the plain per-stratum window definition
    import hashlib
    pdf["h"] = [hashlib.md5(f"987:{i}".encode()).hexdigest() for i in pdf.id]
    pdf = pdf.sort_values(["s", "h", "id"])
    pdf["r"] = pdf.groupby("s").cumcount() + 1
    pdf["n"] = pdf.groupby("s").id.transform("size")
    want = set(pdf[pdf.r <= np.floor(0.8 * pdf.n)].id)
    assert set(out[out.split == "train"].id) == want
    again = sampling.stratified_split(df, "s", 0.8, seed=987).toPandas()
    assert set(again[again.split == "train"].id) == want


def test_histogram_sums_to_n(spark):
    vals = [float(v) for v in np.random.default_rng(1).integers(0, 100, 500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = metrics.histogram(df, "x", 7).toPandas()
    assert h["count"].sum() == 500
    d = metrics.histogram(df, "x", 7, density=True).toPandas()
    assert abs((d.density * 7).sum() - 1) < 1e-12
    long = profile.gather(df)
    assert profile.hist_by_key(long).toPandas()["count"].sum() == 500


def test_kde_equals_direct_sum(spark):
    x = np.random.default_rng(2).normal(10, 3, 300).round(1)
    long = spark.createDataFrame([("k", float(v)) for v in x], "key string, value double")
    got = profile.kde(long, n_points=64).toPandas().sort_values("i")
    q1, q3 = np.percentile(x, [25, 75])
    bw = 0.9 * min(np.std(x, ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 64)
    want = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert np.allclose(got.density.to_numpy(), want, rtol=1e-10)


def test_binned_kde_within_its_bound(spark):
    x = np.random.default_rng(3).gamma(2.0, 5.0, 2000)
    rows = [("a", float(v)) for v in x] + [("b", 4.0)] * 5 + [("c", 1.0), ("c", 900.0), ("a", None)]
    long = spark.createDataFrame(rows, "key string, value double")
    exact = profile.kde(long, n_points=128).toPandas().sort_values(["key", "i"])
    got = profile.kde_binned(long, n_points=128).toPandas().sort_values(["key", "i"])
    assert got[["key", "i"]].values.tolist() == exact[["key", "i"]].values.tolist() and np.allclose(got.x, exact.x)
    q1, q3 = np.percentile(x, [25, 75])
    bw = 0.9 * min(np.std(x, ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    step = (x.max() - x.min()) / 127
    off = np.abs(got.density.to_numpy() - exact.density.to_numpy())[(got.key == "a").to_numpy()]
    assert 0 < off.max() <= step ** 2 / (8 * math.sqrt(2 * math.pi) * bw ** 3) + math.exp(-32) / bw
    for key in "bc":
        assert np.allclose(got.density[got.key == key].to_numpy(), exact.density[exact.key == key].to_numpy(), rtol=1e-9)
    assert profile.kde_binned(long.where("false")).count() == 0


def test_text_as_numbers(spark):
    cases = {"12": (12.0, 12), " -3.9 ": (-3.9, -3), "1e3": (1000.0, 1000), ".5": (0.5, 0), "7.": (7.0, 7), "3e9": (3e9, None),
             "12f": (None, None), "4D": (None, None), "1,000": (None, None), "": (None, None), "e5": (None, None), "x1": (None, None), None: (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", numeric.r_numeric("t").alias("n"), numeric.r_integer(F.col("t")).alias("i")).collect()
    assert {r.t: (r.n, r.i) for r in got} == cases


def test_loess_reproduces_quadratic(spark):
    x = np.arange(40, dtype=float)
    y = 3 + 0.5 * x - 0.02 * x ** 2
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = smooth.loess(df, "x", "y").toPandas().sort_values("x")
    assert np.allclose(got.fit.to_numpy(), y, atol=1e-9)
    band = smooth.loess(df, "x", "y", level=0.95).toPandas()
    assert (band.lower <= band.fit + 1e-9).all() and (band.upper >= band.fit - 1e-9).all()


@pytest.mark.parametrize("df_, p, want", [(10, 0.975, 2.228138852), (1, 0.975, 12.70620474),
                                          (30, 0.95, 1.697260887), (200, 0.5, 0.0)])
def test_t_quantile(df_, p, want):
    assert abs(smooth.t_quantile(p, df_) - want) < 1e-6


def test_cumulative_accounts_end_at_total(spark):
    from flock.operators.accounts import monthly_accounts
    from flock.sources.fixtures import load_domain
    d = load_domain(spark, "/root/testdata/sf0.001")
    m = monthly_accounts(d["person"]).toPandas().sort_values("mo")
    assert m.total_accounts.iloc[-1] == d["person"].where(F.col("foreign_id").isNull()).count()
    assert (np.diff(m.total_accounts.to_numpy()) > 0).all()


def test_mau_at_least_any_week_part(spark):
    from flock.operators.accounts import accounts
    from flock.sources.fixtures import load_domain
    d = load_domain(spark, "/root/testdata/sf0.01")
    a = accounts(d["person"], d["attendance"], d["gift"]).toPandas().dropna()
    assert (a.active_users_month >= a.active_users_week).all()


def test_bucketed_ranks_exact_on_mixed_signs(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1000, 3000), rng.integers(-5, 5, 2000).astype(float),
                        [0.0, 1e-300, -1e300, 1e300, 7.5, 7.5]])
    long = spark.createDataFrame([("k", float(v)) for v in x], "key string, value double")
    q = profile.quantiles7(long).collect()[0]
    assert np.allclose([q.q1, q.median, q.q3], np.percentile(x, [25, 50, 75]), rtol=0, atol=1e-9)
    vc = profile.value_counts(long).toPandas().sort_values("value")
    assert (np.diff(vc.cum.to_numpy()) > 0).all() and vc.cum.iloc[-1] == len(x)
    # ranges follow one another in value order
    c = ranks.counted(long).toPandas().sort_values("value")
    assert (np.diff(c.part.to_numpy()) >= 0).all() and c.cnt.sum() == len(x)
