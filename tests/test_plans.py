"""Plan checks: one shuffle for the streak windows, pushdown into the scans,
no Python evaluation in the metric queries."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from conftest import SF_SMALL
from flock.operators import streaks

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_streak_windows_share_one_shuffle(spark):
    periods = spark.range(0, 1000).select(
        (F.col("id") % 37).alias("id"), F.date_add(F.lit("2020-01-04").cast("date"),
                                                   ((F.col("id") % 50) * 7).cast("int")).alias("period_start"),
        (F.col("id") % 2).cast("int").alias("is_online")).distinct()
    plan = spark.createDataFrame(periods.collect(), periods.schema)
    out = streaks.streaks(plan)
    text = out._jdf.queryExecution().executedPlan().toString()
    # windows over id and (id, run) plus the final per-id aggregate: one exchange
    assert text.count("Exchange hashpartitioning(id") == 1, text


def test_filters_and_columns_reach_the_scan(spark):
    df = queries()["person_attendance"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,P))" in text
    assert "o_totalprice" not in text  # unused columns pruned from ReadSchema


def test_metric_queries_stay_in_the_jvm(spark):
    names = ["monthly_accounts", "account_stats", "streaks", "person_features", "stickiness", "fivenum",
             "clean_people_literal", "stratified_split", "kde", "hist30_by_key"]
    for name in names:
        text = _plan(queries()[name](spark, SF_SMALL))
        assert not any(n in text for n in PY_NODES), name


def test_cleaning_plan_reads_outlier_set_once(spark):
    # the outlier (key, value) set is materialized once for its per-column anti
    # joins; the cleaning plan itself then needs only a handful of exchanges
    df = queries()["clean_people_literal"](spark, SF_SMALL)
    assert _plan(df).count("Exchange") <= 20
