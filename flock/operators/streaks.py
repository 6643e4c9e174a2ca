"""K7: attendance streaks.

A streak is a run of *equal* gaps between consecutive attended periods
(SURVEY S6): the first row opens a run (no previous gap), the second opens
another (no previous-previous gap), so four straight weeks give 3 and
attending every fourth week is a streak too.  The online share is pooled over
every run that ties for the longest (S8).

The reference needs two self-joins to find the rows of the longest runs; here
they are window maxima.  All windows share the partitioning key ``id``, so the
whole operator costs one shuffle of the de-duplicated (person, period,
online) rows; Spark's ``EnsureRequirements`` accepts the ``id`` hash
partitioning for the ``(id, run)`` windows as well.  A person contributes at
most one row per period and flag, so even a person with a third of all raw
check-ins is bounded by the calendar after the de-duplication (which is a
partial-aggregated shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date, sunday_week_index, week_start
from ..functions.numeric import pct_decimal


def attended_weeks(attendance: DataFrame, person_alias: DataFrame, person: DataFrame,
                   occurrence: DataFrame, group: DataFrame, online_campus: int = 30,
                   first_day: str = "SAT") -> DataFrame:
    """Distinct (person, week start, online flag) of attended check-ins.

    Check-ins are reduced to distinct (alias, week, flag) before the alias and
    person joins, so those joins see the de-duplicated volume."""
    occ = occurrence.select(F.col("id").alias("occurrence_id"), "group_id")
    att = attendance.where(F.col("did_attend") == 1).select(
        "person_alias_id", "occurrence_id", week_start("start_ts", first_day).alias("period_start"))
    per_group = att.join(occ, "occurrence_id").select("person_alias_id", "period_start", "group_id").distinct()
    online = F.when(F.col("campus_id") == online_campus, 1).otherwise(0).alias("is_online")
    per_alias = per_group.join(group.select(F.col("id").alias("group_id"), "campus_id"), "group_id").select(
        "person_alias_id", "period_start", online).distinct()
    alias = person_alias.select(F.col("id").alias("person_alias_id"), F.col("person_id").alias("id"))
    return (per_alias.join(alias, "person_alias_id")
            .join(person.select("id"), "id", "left_semi")
            .select("id", "period_start", "is_online").distinct())


def attended_days(daily: DataFrame, person_alias: DataFrame) -> DataFrame:
    """Day-grain input: distinct (person, day, online flag)."""
    per_alias = daily.select("person_alias_id", as_date("start_ts").alias("period_start"),
                             "is_online").distinct()
    alias = person_alias.select(F.col("id").alias("person_alias_id"), F.col("person_id").alias("id"))
    return per_alias.join(alias, "person_alias_id").select("id", "period_start", "is_online").distinct()


def streak_runs(periods: DataFrame, grain: str = "week", strict: bool = False) -> DataFrame:
    """Every input row with its run id (``run``) and position in the run (``pos``).

    Ties inside one period (both an online and an in-person row, S7) are
    broken by the online flag for LAG and ROW_NUMBER; the running sum keeps
    RANGE peers, as the reference's default frame does."""
    idx = sunday_week_index("period_start") if grain == "week" else F.unix_date("period_start")
    ordered = Window.partitionBy("id").orderBy("period_start", "is_online")
    peers = (Window.partitionBy("id").orderBy("period_start")
             .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    df = periods.withColumn("_idx", idx).withColumn("gap", F.col("_idx") - F.lag("_idx").over(ordered))
    if strict:
        change = F.when(F.col("gap").isin(0, 1), 0).otherwise(1)
    else:
        change = F.when(F.lag("gap").over(ordered) == F.col("gap"), 0).otherwise(1)
    df = df.withColumn("change", change).withColumn("run", F.sum("change").over(peers))
    in_run = Window.partitionBy("id", "run").orderBy("period_start", "is_online")
    pos = F.dense_rank().over(Window.partitionBy("id", "run").orderBy("period_start")) if strict \
        else F.row_number().over(in_run)
    return df.withColumn("pos", pos).drop("_idx")


def longest_runs(periods: DataFrame, *more, grain: str = "week", strict: bool = False, counts=None) -> DataFrame:
    """``(id, highest_streak, lco_percentage, *more)``: longest run and the online share (DECIMAL(19,2)
    percent) over all rows of the runs tied for longest.  ``more``: aggregates over all rows of a person;
    ``counts`` tells the rows that are visits (a person without any gets nulls)."""
    runs = streak_runs(periods, grain, strict)
    person = Window.partitionBy("id")
    run = Window.partitionBy("id", "run")
    best = (runs.withColumn("_best", F.max("pos").over(person))
            .withColumn("_top", F.max(F.when(F.col("pos") == F.col("_best"), 1)).over(run)))
    top = F.col("_top") == 1 if counts is None else (F.col("_top") == 1) & counts
    if not more:
        best, top = best.where(top), F.lit(True)
    share = F.sum(F.when(top, F.col("is_online"))) / F.count(F.when(top, 1)).cast("decimal(19,2)") * 100
    return best.groupBy("id").agg(
        F.max(F.when(top, F.col("pos"))).cast("long").alias("highest_streak"),
        (pct_decimal("is_online") if not more else F.when(F.count(F.when(top, 1)) > 0, share).cast("decimal(19,2)")).alias("lco_percentage"), *more)


def streaks(periods: DataFrame, grain: str = "week", strict: bool = False) -> DataFrame:
    """``(id, highest_streak, lco_percentage)`` of attended periods."""
    return longest_runs(periods, grain=grain, strict=strict)
