"""Registered queries: calendar functions, identity, accounts (A5, H*, J1, K1-K6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import accounts as acc
from ..operators.identity import primary_alias
from ..operators.people import PersonParts
from ..sources.fixtures import load_domain
from . import sqltext as q
from .registry import register

AS_OF = q.AS_OF
MB, WL = q.month_bucket, q.week_label

PA_SQL = """
primary_alias AS (
  SELECT person_id, min(id) AS alias_id FROM person_alias
  WHERE alias_person_id = person_id AND person_id IN (SELECT id FROM person) GROUP BY person_id),
person_attendance AS (
  SELECT person_id AS id, min(start_ts) AS first_attendance, max(start_ts) AS last_attendance, count(*) AS total_check_ins
  FROM primary_alias JOIN attendance ON person_alias_id = alias_id WHERE did_attend = 1 GROUP BY person_id)"""

#: Months of sign-ups, of activity and of first and last check-ins, each counted by its definition.
ACCOUNTS_SQL = f"""
{PA_SQL.strip()},
signups AS (
  SELECT DISTINCT mo, count(*) OVER (PARTITION BY mo) AS new_accounts, count(*) OVER (ORDER BY mo) AS total_accounts
  FROM (SELECT {MB('created_ts')} AS mo FROM person WHERE foreign_id IS NULL) x),
activity AS (
  SELECT kind, person_alias_id, {MB('moment')} AS event_month, {WL('moment')} AS week_number
  FROM (SELECT 'check-in' AS kind, person_alias_id, start_ts AS moment FROM attendance WHERE did_attend = 1
        UNION ALL SELECT 'gift', person_alias_id, created_ts FROM gift) x
  GROUP BY ALL),
active AS (
  SELECT event_month, week_number, count(DISTINCT person_alias_id) AS users, grouping(week_number) = 1 AS whole_month
  FROM activity GROUP BY GROUPING SETS ((event_month), (event_month, week_number))),
active_months AS (SELECT event_month, users AS active_users FROM active WHERE whole_month),
active_weeks AS (SELECT event_month, week_number, users AS active_users_week FROM active WHERE NOT whole_month),
accounts AS (
  SELECT mo, new_accounts, total_accounts, m.active_users AS active_users_month, w.week_number, w.active_users_week
  FROM active_weeks w RIGHT JOIN signups ON w.event_month = mo LEFT JOIN active_months m ON m.event_month = mo),
ends AS (
  SELECT mo, nullif(count(*) FILTER (is_first), 0) AS total_new_check_ins, nullif(count(*) FILTER (NOT is_first), 0) AS total_last_check_ins
  FROM (SELECT {MB('first_attendance')} AS mo, true AS is_first FROM person_attendance
        UNION ALL SELECT {MB('last_attendance')}, false FROM person_attendance) x
  GROUP BY mo),
all_months AS (SELECT * FROM accounts LEFT JOIN ends USING (mo)),
account_stats AS (
  SELECT * FROM all_months WHERE total_last_check_ins <= {q.closed_threshold()})"""


def _d(spark, sf_dir):
    return load_domain(spark, sf_dir)


def _stats(spark, sf_dir, closed_filter="literal"):
    d = _d(spark, sf_dir)
    parts = PersonParts(d)
    return acc.account_stats(d["person"], d["attendance"], d["gift"], parts.attendance, AS_OF, closed_filter)


# --- calendar functions -------------------------------------------------------

@register("date_dim", sql=q.with_adapter(f"""
bounds AS (SELECT CAST(min(start_ts) AS DATE) AS lo, CAST(max(start_ts) AS DATE) AS hi FROM attendance)""",
    select=f"""
SELECT CAST(d AS DATE) AS full_date, {q.week_start_sat('d')} AS week_start
FROM bounds, generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) t(d)"""))
def date_dim_q(spark, sf_dir):
    """A5: calendar over the attendance date range, Saturday week start."""
    d = _d(spark, sf_dir)
    return dates.date_dim_over(d["attendance"], "start_ts")


@register("week_labels", sql=q.with_adapter(select=f"""
SELECT DISTINCT CAST(start_ts AS DATE) AS day, {WL('start_ts')} AS week_label,
       {q.week_start_sat('start_ts')} AS week_start, {q.sunday_week('start_ts')} AS week_index
FROM attendance"""))
def week_labels(spark, sf_dir):
    """Week label, Saturday week start and Sunday-boundary week index per day."""
    a = _d(spark, sf_dir)["attendance"]
    return a.select(dates.as_date("start_ts").alias("day"),
                    dates.week_label("start_ts").alias("week_label"),
                    dates.week_start("start_ts").alias("week_start"),
                    dates.sunday_week_index("start_ts").cast("long").alias("week_index")).distinct()


@register("month_diffs", sql=q.with_adapter(PA_SQL, select=f"""
SELECT id, {q.month_diff('first_attendance', 'last_attendance')} AS months_first_last,
       {q.month_diff('last_attendance', f"DATE '{AS_OF}'")} AS months_since_last,
       CAST(DATE '{AS_OF}' - INTERVAL 2 MONTH AS DATE) AS two_months_before
FROM person_attendance"""))
def month_diffs(spark, sf_dir):
    """Month-boundary distances (not months_between)."""
    pa = PersonParts(_d(spark, sf_dir)).attendance
    return pa.select("id",
                     dates.month_diff("first_attendance", "last_attendance").alias("months_first_last"),
                     dates.month_diff("last_attendance", dates.lit_date(AS_OF)).alias("months_since_last"),
                     dates.add_months_lit(AS_OF, -2).alias("two_months_before"))


@register("day_diffs", sql=q.with_adapter(PA_SQL, select=f"""
SELECT pa.id, {q.day_diff('p.created_ts', 'pa.first_attendance')} AS days_to_first_attendance,
       {q.day_diff('pa.first_attendance', 'pa.last_attendance')} AS days_first_last
FROM person_attendance pa JOIN person p ON p.id = pa.id"""))
def day_diffs(spark, sf_dir):
    """H7: midnight-boundary day distances (negative when attended before creation)."""
    d = _d(spark, sf_dir)
    pa = PersonParts(d).attendance.join(d["person"].select("id", "created_ts"), "id")
    return pa.select("id", dates.day_diff("created_ts", "first_attendance").alias("days_to_first_attendance"),
                     dates.day_diff("first_attendance", "last_attendance").alias("days_first_last"))


# --- identity and attendance ---------------------------------------------------

@register("primary_alias", sql=q.with_adapter(PA_SQL, select="""
SELECT person_id, alias_id FROM primary_alias WHERE alias_id IS NOT NULL"""))
def primary_alias_q(spark, sf_dir):
    """Person -> primary alias."""
    d = _d(spark, sf_dir)
    return primary_alias(d["person_alias"], d["person"])


@register("person_attendance", sql=q.with_adapter(PA_SQL, select="SELECT * FROM person_attendance"))
def person_attendance_q(spark, sf_dir):
    """K6: first/last/total check-ins via the primary alias."""
    return PersonParts(_d(spark, sf_dir)).attendance


# --- accounts -------------------------------------------------------------------

@register("monthly_accounts", sql=q.with_adapter(ACCOUNTS_SQL, select="SELECT * FROM signups"))
def monthly_accounts(spark, sf_dir):
    """K1: new and cumulative non-imported accounts per month."""
    return acc.monthly_accounts(_d(spark, sf_dir)["person"])


@register("monthly_accounts_all", sql=q.with_adapter(f"""
nat AS (SELECT {MB('created_ts')} AS mo, count(id) AS new_accounts FROM person GROUP BY 1)""", select="""
SELECT mo, new_accounts, CAST(sum(new_accounts) OVER (ORDER BY mo) AS BIGINT) AS total_accounts FROM nat"""))
def monthly_accounts_all(spark, sf_dir):
    """K1 v1: imported people counted too."""
    return acc.monthly_accounts(_d(spark, sf_dir)["person"], exclude_imported=False)


@register("person_events", sql=q.with_adapter(ACCOUNTS_SQL, select="SELECT person_alias_id, event_month, week_number FROM activity"))
def person_events(spark, sf_dir):
    """K2/G1: attended and giving events by (alias, month, week label)."""
    d = _d(spark, sf_dir)
    return acc.person_events(d["attendance"], d["gift"])


@register("active_users_month", sql=q.with_adapter(ACCOUNTS_SQL, select="SELECT * FROM active_months"))
def active_users_month(spark, sf_dir):
    """Distinct active aliases per month."""
    d = _d(spark, sf_dir)
    return acc.active_users_month(acc.person_events(d["attendance"], d["gift"]))


@register("active_users_week", sql=q.with_adapter(ACCOUNTS_SQL, select="SELECT * FROM active_weeks"))
def active_users_week(spark, sf_dir):
    """Distinct active aliases per (month, week label)."""
    d = _d(spark, sf_dir)
    return acc.active_users_week(acc.person_events(d["attendance"], d["gift"]))


@register("accounts", sql=q.with_adapter(ACCOUNTS_SQL, select="SELECT * FROM accounts"))
def accounts_q(spark, sf_dir):
    """K3: month rows fanned out to their week rows."""
    d = _d(spark, sf_dir)
    return acc.accounts(d["person"], d["attendance"], d["gift"])


@register("first_checkins", sql=q.with_adapter(ACCOUNTS_SQL, select="SELECT mo, total_new_check_ins FROM ends WHERE total_new_check_ins > 0"))
def first_checkins(spark, sf_dir):
    """People whose first check-in falls in each month."""
    return acc.first_last_checkins(PersonParts(_d(spark, sf_dir)).attendance)[0]


@register("last_checkins", sql=q.with_adapter(ACCOUNTS_SQL, select="SELECT mo, total_last_check_ins FROM ends WHERE total_last_check_ins > 0"))
def last_checkins(spark, sf_dir):
    """People whose last check-in falls in each month."""
    return acc.first_last_checkins(PersonParts(_d(spark, sf_dir)).attendance)[1]


@register("account_stats", sql=q.with_adapter(ACCOUNTS_SQL, select="SELECT * FROM account_stats"))
def account_stats(spark, sf_dir):
    """K4 with the literal count-versus-date filter."""
    return _stats(spark, sf_dir)


@register("account_stats_closed", sql=q.with_adapter(ACCOUNTS_SQL, select=f"""
SELECT * FROM all_months
WHERE total_last_check_ins IS NOT NULL AND mo <= CAST(DATE '{AS_OF}' - INTERVAL 2 MONTH AS DATE)"""))
def account_stats_closed(spark, sf_dir):
    """K4 with the intended filter: closed months only."""
    return _stats(spark, sf_dir, "closed_months")


@register("account_stats_v1", sql=q.with_adapter(ACCOUNTS_SQL, f"""
signups_all AS (
  SELECT DISTINCT mo, count(*) OVER (PARTITION BY mo) AS new_accounts, count(*) OVER (ORDER BY mo) AS total_accounts
  FROM (SELECT {MB('created_ts')} AS mo FROM person) x)""", select=f"""
SELECT * FROM signups_all LEFT JOIN ends USING (mo) WHERE total_last_check_ins <= {q.closed_threshold()}"""))
def account_stats_v1(spark, sf_dir):
    """K4 of the first script (no activity columns)."""
    d = _d(spark, sf_dir)
    return acc.account_stats_v1(d["person"], PersonParts(d).attendance, AS_OF)


LONG_SQL = """
SELECT mo, active_users_month, week_number, active_users_week, type, number FROM (
  SELECT mo, active_users_month, week_number, active_users_week, 'new_accounts' AS type,
         CAST(new_accounts AS BIGINT) AS number FROM account_stats
  UNION ALL SELECT mo, active_users_month, week_number, active_users_week, 'total_accounts',
         CAST(total_accounts AS BIGINT) FROM account_stats
  UNION ALL SELECT mo, active_users_month, week_number, active_users_week, 'total_new_check_ins',
         CAST(total_new_check_ins AS BIGINT) FROM account_stats
  UNION ALL SELECT mo, active_users_month, week_number, active_users_week, 'total_last_check_ins',
         CAST(total_last_check_ins AS BIGINT) FROM account_stats) u
WHERE number IS NOT NULL"""


@register("account_stats_long", sql=q.with_adapter(ACCOUNTS_SQL, select=LONG_SQL))
def account_stats_long(spark, sf_dir):
    """UNPIVOT of the account numbers, nulls dropped."""
    return acc.account_stats_long(_stats(spark, sf_dir))


@register("growth", sql=q.with_adapter(ACCOUNTS_SQL, f"long AS ({LONG_SQL})", select="""
SELECT mo, number FROM long WHERE type = 'total_accounts'"""))
def growth(spark, sf_dir):
    """The cumulative-accounts series read back from the long form."""
    long = acc.account_stats_long(_stats(spark, sf_dir))
    return long.where(F.col("type") == "total_accounts").select("mo", "number")
