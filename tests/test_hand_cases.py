"""Hand-made cases of FIXTURES.md section 3 (values checked against the
reference's documented semantics)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flock.functions import dates
from flock.functions.numeric import pct_decimal
from flock.operators import accounts, clean, profile, streaks
from flock.operators.people import activation_date

D = dt.date


def _weeks(spark, rows):
    df = spark.createDataFrame([(1, D(*d), o) for d, o in rows], "id long, day date, is_online int")
    return df.select("id", dates.week_start("day").alias("period_start"), "is_online").distinct()


def _streak(spark, rows, strict=False):
    r = streaks.streaks(_weeks(spark, rows), strict=strict).collect()[0]
    return r.highest_streak, float(r.lco_percentage)


def test_weekly_run_counts_three(spark):
    rows = [((2022, 1, 1), 0), ((2022, 1, 8), 0), ((2022, 1, 15), 0), ((2022, 1, 22), 0)]
    assert _streak(spark, rows) == (3, 0.0)
    assert _streak(spark, rows, strict=True)[0] == 4


def test_equal_four_week_gaps(spark):
    rows = [((2022, 1, 1), 0), ((2022, 1, 29), 0), ((2022, 2, 26), 0), ((2022, 3, 26), 1)]
    assert _streak(spark, rows) == (3, 33.33)


def test_single_visit(spark):
    assert _streak(spark, [((2022, 1, 1), 0)]) == (1, 0.0)


def test_tied_runs_pooled(spark):
    rows = [((2022, 1, 1), 0), ((2022, 1, 8), 0), ((2022, 1, 15), 1),
            ((2022, 3, 5), 1), ((2022, 3, 12), 1), ((2022, 3, 19), 1)]
    assert _streak(spark, rows) == (2, 75.0)


def test_same_week_both_kinds_is_deterministic(spark):
    rows = [((2022, 1, 1), 0), ((2022, 1, 1), 1), ((2022, 1, 8), 0)]
    first = _streak(spark, rows)
    assert all(_streak(spark, rows) == first for _ in range(2))


def test_week_label_and_week_start(spark):
    df = spark.createDataFrame([(D(2022, 10, 15),), (D(2022, 10, 16),), (D(2022, 10, 22),)], "d date")
    got = df.select(dates.week_label("d").alias("w"), dates.week_start("d").alias("s")).collect()
    assert [r.w for r in got] == [D(2022, 10, 8), D(2022, 10, 15), D(2022, 10, 15)]
    assert [r.s for r in got] == [D(2022, 10, 15), D(2022, 10, 15), D(2022, 10, 22)]


def test_month_and_week_boundaries(spark):
    df = spark.createDataFrame([(D(2022, 1, 31), D(2022, 2, 1))], "a date, b date")
    r = df.select(dates.month_diff("a", "b").alias("m"), dates.day_diff("a", "b").alias("d"),
                  dates.week_diff(F.lit("2022-01-01").cast("date"), F.lit("2022-01-02").cast("date")).alias("w"),
                  dates.add_months_lit("2022-04-30", -2).alias("c")).collect()[0]
    assert (r.m, r.d, r.w, r.c) == (1, 1, 1, D(2022, 2, 28))


def test_closed_threshold_literal(spark):
    assert spark.range(1).select(dates.closed_count_threshold("2001-08-01").alias("t")).collect()[0].t == 37041


def test_activation_cases(spark):
    t1, t2 = dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1)
    df = spark.createDataFrame([(t1, None), (None, t1), (t2, t1), (t1, t1)],
                               "a timestamp_ntz, g timestamp_ntz")
    got = [r.x for r in df.select(activation_date(F.col("a"), F.col("g")).alias("x")).collect()]
    assert got == [None, None, t1, t1]


def test_hinges_differ_from_percentile(spark):
    long = spark.createDataFrame([("k", float(v)) for v in range(1, 7)], "key string, value double")
    r = profile.fivenum(long).collect()[0]
    assert (r.lower_hinge, r.median, r.upper_hinge) == (2.0, 3.5, 5.0)
    q = profile.quantiles7(long).collect()[0]
    assert (q.q1, q.q3) == (2.25, 4.75)


def test_value_exclusion_keeps_nulls(spark):
    df = spark.createDataFrame([(1,), (10,), (None,)], "x int")
    vals = spark.createDataFrame([("x", 10.0)], "key string, value double")
    got = sorted(profile.exclude_values(df, "x", vals).collect(), key=lambda r: (r.x is None, r.x))
    assert [r.x for r in got] == [1, None]


def test_first_match_recode(spark):
    df = spark.createDataFrame([("1143143",)], "m string")
    assert clean.recode(df, "m", [("143", "Married")]).collect()[0].m == "1Married143"
    assert clean.recode(df, "m", [("143", "Married")], mode="exact").collect()[0].m == "1143143"


def test_unpivot_drops_null(spark):
    stats = spark.createDataFrame([(D(2020, 1, 1), None, 2, None, None, None, None, None)],
                                  "mo date, new_accounts long, total_accounts long, total_new_check_ins long, "
                                  "total_last_check_ins long, active_users_month long, week_number date, "
                                  "active_users_week long")
    rows = accounts.account_stats_long(stats).collect()
    assert [(r.type, r.number) for r in rows] == [("total_accounts", 2)]


def test_decimal_share(spark):
    df = spark.createDataFrame([(1,), (0,), (0,)], "f int")
    assert float(df.agg(pct_decimal("f").alias("p")).collect()[0].p) == 33.33


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13, 100])
def test_fivenum_matches_tukey_definition(spark, n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 20, n).astype(float)
    long = spark.createDataFrame([("k", float(v)) for v in x], "key string, value double")
    r = profile.fivenum(long).collect()[0]
    xs = np.sort(x)
    n4 = np.floor((n + 3) / 2) / 2
    d = [1, n4, (n + 1) / 2, n + 1 - n4, n]
    want = [0.5 * (xs[int(np.floor(p)) - 1] + xs[int(np.ceil(p)) - 1]) for p in d]
    assert [r.min, r.lower_hinge, r.median, r.upper_hinge, r.max] == want


def test_t_quantile_reaches_wide_tails():
    from flock.operators.smooth import t_quantile

    assert abs(t_quantile(0.975, 10) - 2.2281388520) < 1e-8
    assert abs(t_quantile(0.9999, 1) - 3183.0987571) < 1e-3  # one degree: tan(pi * (p - 1/2))
