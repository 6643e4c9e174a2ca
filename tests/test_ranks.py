"""Order statistics by range: against numpy, on narrow bands and hot values, and by the sizes of their sorts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flock.operators import clean, profile, ranks


def _long(spark, pairs):
    return spark.createDataFrame(pairs, "key string, value double").repartition(4)


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_and_hinges_of_many_shapes(spark, seed):
    rng = np.random.default_rng(seed)
    columns = {"narrow": 1.0e9 + rng.integers(0, 3000, 4001) / 1e3, "hot": np.where(rng.random(3000) < 0.7, 5.0, rng.normal(size=3000)),
               "mixed": np.concatenate([rng.normal(0, 1e3, 999), [0.0, -0.0, 1e-300, -1e300, 1e300]]), "one": np.array([3.5]), "two": np.array([1.0, 2.0])}
    long = _long(spark, [(k, float(x)) for k, v in columns.items() for x in v] + [("hot", None), ("none", None)])
    q = {r.key: r for r in profile.quantiles7(long).collect()}
    f = {r.key: r for r in profile.fivenum(long).collect()}
    assert set(q) == set(f) == set(columns)
    for k, v in columns.items():
        assert np.allclose([q[k].q1, q[k].median, q[k].q3], np.percentile(v, [25, 50, 75]), rtol=1e-15, atol=0)
        s, n = np.sort(v), len(v)
        n4 = ((n + 3) // 2) / 2
        at = [1, n4, (n + 1) / 2, n + 1 - n4, n]
        assert [f[k][c] for c in ("min", "lower_hinge", "median", "upper_hinge", "max")] == [(s[int(np.floor(p)) - 1] + s[int(np.ceil(p)) - 1]) / 2 for p in at]
        assert f[k].n == n


def test_infinities_and_nan_sort_last(spark):
    r = profile.fivenum(_long(spark, [("k", x) for x in (1.0, 2.0, 3.0, float("inf"), float("-inf"))])).first()
    assert (r["min"], r["median"], r["max"]) == (float("-inf"), 2.0, float("inf"))


def test_ranges_of_two_million_seconds(spark):
    """A month of seconds, two thirds of them in one hour: no range holds more than a few percent."""
    n = 2_000_000
    second = F.when(F.col("id") % 3 == 0, F.col("id") % 2_592_000).otherwise(F.xxhash64("id") % 3_600)
    long = spark.range(n).select(F.lit("t").alias("key"), (F.lit(1.7e9) + second + (F.col("id") % 1000) / 1000).alias("value"))
    counts = ranks.counted(long)
    sizes = [r["count"] for r in counts.groupBy("part").count().collect()]
    distinct = sum(sizes)
    assert len(sizes) >= 40 and max(sizes) < 0.05 * distinct
    want = long.selectExpr("percentile(value, array(0.25, 0.5, 0.75)) AS p").first().p
    v = ranks.values_at(counts, ranks.quantile_ranks((0.25, 0.5, 0.75), ("a", "b", "c")), few_keys=True)
    got = v.select(*[ranks.quantile7(p, k).alias(k) for p, k in ((0.25, "a"), (0.5, "b"), (0.75, "c"))]).first()
    assert np.allclose([got.a, got.b, got.c], want, rtol=1e-15, atol=0)


def test_only_ranges_with_a_wanted_rank_are_summed(spark):
    long = spark.range(100_000).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("value"))
    counts = ranks.counted(long)
    v = ranks.values_at(counts, {"x": lambda n: F.lit(50_000), "y": lambda n: n}, few_keys=True)
    assert tuple(v.select("x", "y", "n").first()) == (49_999.0, 99_999.0, 100_000)
    text = v._jdf.queryExecution().executedPlan().toString()
    assert "Window" in text and "BroadcastHashJoin" in text


def test_profile_of_dates_and_nulls(spark):
    day = dt.date
    df = spark.createDataFrame([(day(2020, 1, i), dt.datetime(2020, 1, i, 12), None, float(i)) for i in (1, 2, 3, 4)] + [(None, None, None, None)],
                               "d date, t timestamp_ntz, e date, x double")
    got = {r.key: r for r in profile.profile_dates(df).collect()}
    d, t, e = got["d"], got["t"], got["e"]
    assert (d["min"], d.q1, d["median"], d["mean"], d["max"], d.nulls) == (
        dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 18), dt.datetime(2020, 1, 2, 12), dt.datetime(2020, 1, 2, 12), dt.datetime(2020, 1, 4), 1)
    assert t["median"] == dt.datetime(2020, 1, 3) and (e["min"], e["mean"], e.nulls) == (None, None, 5)
    x = profile.profile_numeric(df).first()
    assert (x.key, x["min"], x.q1, x["median"], x["mean"], x.q3, x["max"], x.nulls) == ("x", 1.0, 1.75, 2.5, 2.5, 3.25, 4.0, 1)
    assert profile.profile_numeric(df.limit(0)).count() == 0


def _sets(spark):
    rows = [(i, float(i % 7) if i % 5 else None, i % 11) for i in range(400)] + [(1000 + i, 3.0, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b int").repartition(3)
    sets = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", None), ("b", 10.0), ("c", 1.0), ("b", 99.0)], "key string, value double")
    return rows, df, sets


def test_exclusion_sets_both_ways(spark):
    rows, df, sets = _sets(spark)
    want = sorted((r for r in rows if r[1] != 3.0 and r[2] != 10), key=lambda r: r[0])
    for limit in (100, 0):  # broadcast, and one salted join
        got = profile.exclude_sets(df, sets, ["a", "b"], broadcast_values=limit)
        assert [tuple(r) for r in got.orderBy("id").collect()] == want and got.columns == df.columns
    assert profile.exclude_sets(df, sets.limit(0), ["a", "b"]).count() == len(rows)
    assert profile.exclude_sets(df, sets, []).count() == len(rows)


def test_cleaning_exchanges_no_column_values(spark):
    """With Spark's own broadcast off, people stay in place: nothing is dealt by a column's value or by bare key."""
    people = spark.range(500).select("id", *[(F.xxhash64("id", F.lit(i)) % 50).cast("int").alias(c) for i, c in enumerate(clean.OUTLIER_COLUMNS)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = profile.exclude_sets(people, clean.raw_outliers(people, coef=0.1), clean.OUTLIER_COLUMNS)
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in text and "SortMergeJoin" not in text
        hist = profile.hist_columns(people, clean.OUTLIER_COLUMNS)
        text = hist._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(key#" in text and "SortMergeJoin" not in text
        assert all("bin#" in line for line in text.splitlines() if "hashpartitioning" in line)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_histograms_wide_equal_long(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), None if a > 1 else float(b), 7.0, None) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    wide = sorted(map(tuple, profile.hist_columns(df, df.columns).collect()))
    assert wide == sorted(map(tuple, profile.hist_by_key(profile.gather(df)).collect())) and ("c", 7.0, 300) in wide
    assert profile.hist_columns(df.limit(0), df.columns).count() == 0
