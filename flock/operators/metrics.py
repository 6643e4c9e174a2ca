"""The engagement series the reference plots.

All inputs are already monthly/weekly aggregates (account statistics) or the
person table; every series is one grouped aggregate with the year floor
written as a range predicate, so it prunes and pushes down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import since_year
from ..functions.numeric import hist_bin

SINCE_YEAR = 2018  # the reference's floor; the order-based fixtures use 1998


def activation_rate(stats: DataFrame, since: int = SINCE_YEAR) -> DataFrame:
    """MAU / cumulative accounts x 100, rounded to 2, plus the accounts-per-100k series."""
    s = (stats.where(since_year("mo", since))
         .select("mo", "total_accounts", F.col("active_users_month").alias("active_users")).distinct())
    return s.select("mo", "total_accounts", "active_users",
                    F.round(F.col("active_users") / F.col("total_accounts") * 100, 2).alias("activation_rate"),
                    (F.col("total_accounts") / 100000).alias("accounts_per_100k"))


def mau(stats: DataFrame, since: int = SINCE_YEAR, distinct: bool = True) -> DataFrame:
    """Monthly active users; de-duplicated (S17) unless ``distinct=False``."""
    s = stats.where(since_year("mo", since)).select("mo", F.col("active_users_month").alias("active_users"))
    return s.distinct() if distinct else s


def wau(stats: DataFrame, since: int = SINCE_YEAR) -> DataFrame:
    """Weekly active users = sum of the week's month-split rows (S14, literal)."""
    return (stats.where(since_year("mo", since)).groupBy("week_number")
            .agg(F.sum("active_users_week").cast("long").alias("total_active_users")))


def wau_whole_weeks(stats: DataFrame, events: DataFrame, since: int = SINCE_YEAR) -> DataFrame:
    """K18 option ``whole_weeks``: distinct aliases per week over the months
    kept in the statistics (no double count of month-split weeks)."""
    months = stats.where(since_year("mo", since)).select(F.col("mo").alias("event_month")).distinct()
    return (events.join(months, "event_month", "left_semi").groupBy("week_number")
            .agg(F.count_distinct("person_alias_id").alias("total_active_users")))


def stickiness(stats: DataFrame, since: int = SINCE_YEAR) -> DataFrame:
    """Mean weekly actives in the month / monthly actives."""
    s = stats.where(since_year("mo", since))
    return (s.groupBy("mo", "active_users_month")
            .agg((F.avg("active_users_week") / F.col("active_users_month")).alias("stickiness"))
            .select("mo", "stickiness"))


def avg_weekly_activation(stats: DataFrame, since: int = SINCE_YEAR) -> DataFrame:
    """Mean weekly actives by (month, number of week rows in the month)."""
    s = stats.where(since_year("mo", since)).withColumn(
        "weeks", F.count("week_number").over(Window.partitionBy("mo")))
    return s.groupBy("mo", "weeks").agg(F.avg("active_users_week").alias("awa"))


def time_to_activate(people: DataFrame, since: int = SINCE_YEAR) -> DataFrame:
    """Mean days to activate per creation month (non-negative only)."""
    p = people.where(since_year("person_created_date", since) & (F.col("time_to_activate") >= 0))
    return (p.groupBy(F.trunc("person_created_date", "MM").alias("mo"))
            .agg(F.avg("time_to_activate").alias("activation")))


def histogram(df: DataFrame, col: str, width: float, density: bool = False) -> DataFrame:
    """Right-closed bins of ``width`` centred on multiples of the width;
    with ``density`` the count is scaled by 1 / (n * width)."""
    h = df.where(F.col(col).isNotNull()).groupBy(hist_bin(F.col(col), width).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    if density:
        total = F.sum("count").over(Window.partitionBy())
        h = h.select("bin", (F.col("count") / (total * float(width))).alias("density"))
    return h


def time_to_activate_hist(people: DataFrame, since: int = SINCE_YEAR, width: float = 20) -> DataFrame:
    """Histogram of days to activate in [0, 100]."""
    p = people.where(since_year("person_created_date", since)
                     & F.col("time_to_activate").between(0, 100))
    return histogram(p, "time_to_activate", width)


def retention_hist(retention: DataFrame, width: float = 7, limit_days: int = 60,
                   density: bool = False) -> DataFrame:
    """Weekly bins of days to return below ``limit_days`` (counts or density)."""
    r = retention.where(F.col("retention_days") < limit_days)
    return histogram(r, "retention_days", width, density)
