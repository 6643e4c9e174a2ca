"""K1-K5: account growth, active users and the account-statistics table.

Plan notes (scale):
* every per-month series is aggregated *before* any window: the global
  running sum (E5w) sees one row per month, never raw rows;
* distinct counts use Spark's two-phase distinct aggregation, so a month
  holding a third of all events still spreads over all reducers by
  (month, alias) before the per-month count;
* person events are de-duplicated per source before the union (map-side
  partial aggregation shrinks each source first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import add_months_lit, closed_count_threshold, month_bucket, week_label

STAT_COLUMNS = ["mo", "new_accounts", "total_accounts", "total_new_check_ins", "total_last_check_ins",
                "active_users_month", "week_number", "active_users_week"]
UNPIVOT_VALUES = ["new_accounts", "total_accounts", "total_new_check_ins", "total_last_check_ins"]


def monthly_count(df: DataFrame, ts: str, name: str, count_col: str | None = None) -> DataFrame:
    """Rows (or non-null ``count_col``) per calendar month of ``ts``."""
    cnt = F.count(count_col) if count_col else F.count(F.lit(1))
    return df.groupBy(month_bucket(ts).alias("mo")).agg(cnt.alias(name))


def monthly_accounts(person: DataFrame, exclude_imported: bool = True) -> DataFrame:
    """K1: new accounts per month and their running total."""
    p = person.where(F.col("foreign_id").isNull()) if exclude_imported else person
    monthly = monthly_count(p, "created_ts", "new_accounts", count_col="id")
    # one row per month: a single-partition running sum is cheap and exact
    running = Window.orderBy("mo").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly.withColumn("total_accounts", F.sum("new_accounts").over(running).cast("long"))


def person_events(attendance: DataFrame, gift: DataFrame) -> DataFrame:
    """K2: distinct (alias, month, week label) of attended check-ins, then of gifts."""
    att = attendance.where(F.col("did_attend") == 1).select(
        "person_alias_id",
        month_bucket("start_ts").alias("event_month"),
        week_label("start_ts").alias("week_number")).distinct()
    gv = gift.select(
        "person_alias_id",
        month_bucket("created_ts").alias("event_month"),
        week_label("created_ts").alias("week_number")).distinct()
    return att.unionByName(gv)


def active_users_month(events: DataFrame) -> DataFrame:
    """Distinct active aliases per month."""
    return events.groupBy("event_month").agg(F.count_distinct("person_alias_id").alias("active_users"))


def active_users_week(events: DataFrame) -> DataFrame:
    """Distinct active aliases per (month, week label); a week spanning two
    months yields two rows (S13)."""
    return events.groupBy("event_month", "week_number").agg(
        F.count_distinct("person_alias_id").alias("active_users_week"))


def accounts(person: DataFrame, attendance: DataFrame, gift: DataFrame,
             exclude_imported: bool = True) -> DataFrame:
    """K3: monthly accounts + monthly active users + weekly rows of the month."""
    total = monthly_accounts(person, exclude_imported)
    ev = person_events(attendance, gift)
    mau = active_users_month(ev).withColumnRenamed("event_month", "mo")
    wau = active_users_week(ev).withColumnRenamed("event_month", "mo")
    return (total.join(mau, "mo", "left").join(wau, "mo", "left")
            .select("mo", "new_accounts", "total_accounts",
                    F.col("active_users").alias("active_users_month"),
                    "week_number", "active_users_week"))


def first_last_checkins(person_att: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D1 over the person-attendance table: people whose first (last)
    check-in falls in each month."""
    first = monthly_count(person_att, "first_attendance", "total_new_check_ins")
    last = monthly_count(person_att, "last_attendance", "total_last_check_ins")
    return first, last


def _closed(stats: DataFrame, as_of, closed_filter: str) -> DataFrame:
    if closed_filter == "literal":
        # A count compared with a datetime = days since 1900-01-01
        return stats.where(F.col("total_last_check_ins") <= closed_count_threshold(as_of))
    if closed_filter == "closed_months":
        return stats.where(F.col("total_last_check_ins").isNotNull()
                           & (F.col("mo") <= add_months_lit(as_of, -2)))
    raise ValueError(f"closed_filter must be 'literal' or 'closed_months', not {closed_filter!r}")


def account_stats(person: DataFrame, attendance: DataFrame, gift: DataFrame, person_att: DataFrame,
                  as_of, closed_filter: str = "literal", exclude_imported: bool = True) -> DataFrame:
    """K4: accounts joined with first/last check-ins per month, closed months only, in the
    reference's order: months of first check-ins descending, months without any last."""
    acc = accounts(person, attendance, gift, exclude_imported)
    first, last = first_last_checkins(person_att)
    first = first.withColumn("first_mo", F.col("mo"))
    stats = acc.join(first, "mo", "left").join(last, "mo", "left")
    order = F.col("first_mo").desc_nulls_last(), F.col("mo"), F.col("week_number")
    return _closed(stats, as_of, closed_filter).orderBy(*order).select(*STAT_COLUMNS)


def account_stats_v1(person: DataFrame, person_att: DataFrame, as_of) -> DataFrame:
    """K4 of the first script: no activity columns, imported people counted."""
    acc = monthly_accounts(person, exclude_imported=False)
    first, last = first_last_checkins(person_att)
    first = first.withColumn("first_mo", F.col("mo"))
    stats = acc.join(first, "mo", "left").join(last, "mo", "left")
    # ORDER BY the joined (nullable) first-check-in month, descending, nulls last
    return (_closed(stats, as_of, "literal").orderBy(F.col("first_mo").desc_nulls_last(), "mo")
            .select("mo", "new_accounts", "total_accounts", "total_new_check_ins", "total_last_check_ins"))


def account_stats_long(stats: DataFrame) -> DataFrame:
    """UNPIVOT of the four account numbers; null cells are dropped
    like SQL UNPIVOT does (``DataFrame.unpivot`` keeps them)."""
    ids = [c for c in stats.columns if c not in UNPIVOT_VALUES]
    long = stats.select(*ids, *[F.col(c).cast("long").alias(c) for c in UNPIVOT_VALUES]).unpivot(
        ids, UNPIVOT_VALUES, "type", "number")
    return long.where(F.col("number").isNotNull())
