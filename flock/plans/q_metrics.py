"""Registered queries: engagement series K16-K23 over account stats and people."""

from __future__ import annotations

from ..operators import accounts as acc
from ..operators import metrics as m
from ..operators import people as pp
from . import sqltext as q
from .q_accounts import ACCOUNTS_SQL, _stats
from .q_people import FEATURES_SELECT, PARTS_SQL, RETENTION_SQL, _parts
from .registry import register

SINCE = q.SINCE_YEAR
SINCE_DATE = f"DATE '{SINCE:04d}-01-01'"
# the fixtures' first check-ins lie in 1995, so activation is read from the first creation year on
ACTIVATION_SINCE = 1995
ACTIVATION_DATE = f"DATE '{ACTIVATION_SINCE:04d}-01-01'"
FEATURES_SQL = f"{PARTS_SQL.strip()},\nfeatures AS ({FEATURES_SELECT})"
STATS_SINCE = f"SELECT * FROM account_stats WHERE mo >= {SINCE_DATE}"


def _people(spark, sf_dir):
    d, parts = _parts(spark, sf_dir)
    return pp.person_features(d, q.AS_OF)


def _retention(spark, sf_dir):
    d, _ = _parts(spark, sf_dir)
    return pp.retention_days(d["person"], d["attendance"], d["person_alias"])


@register("activation_rate", sql=q.with_adapter(ACCOUNTS_SQL, f"s AS ({STATS_SINCE})", select="""
SELECT mo, total_accounts, active_users,
       round(active_users / total_accounts * 100, 2) AS activation_rate,
       total_accounts / 100000 AS accounts_per_100k
FROM (SELECT DISTINCT mo, total_accounts, active_users_month AS active_users FROM s) x"""))
def activation_rate(spark, sf_dir):
    """Activation rate and the accounts-per-100k companion series."""
    return m.activation_rate(_stats(spark, sf_dir), SINCE)


@register("mau", sql=q.with_adapter(ACCOUNTS_SQL, f"s AS ({STATS_SINCE})", select="""
SELECT DISTINCT mo, active_users_month AS active_users FROM s"""))
def mau(spark, sf_dir):
    """Monthly active users (de-duplicated, S17)."""
    return m.mau(_stats(spark, sf_dir), SINCE)


@register("wau", sql=q.with_adapter(ACCOUNTS_SQL, f"s AS ({STATS_SINCE})", select="""
SELECT week_number, CAST(sum(active_users_week) AS BIGINT) AS total_active_users FROM s GROUP BY week_number"""))
def wau(spark, sf_dir):
    """Weekly active users as the sum of month-split week rows."""
    return m.wau(_stats(spark, sf_dir), SINCE)


@register("wau_whole_weeks", sql=q.with_adapter(ACCOUNTS_SQL, f"s AS ({STATS_SINCE})", select="""
SELECT week_number, count(DISTINCT person_alias_id) AS total_active_users
FROM activity WHERE event_month IN (SELECT mo FROM s) GROUP BY week_number"""))
def wau_whole_weeks(spark, sf_dir):
    """K18 option whole_weeks: distinct actives per week (no month split double count)."""
    d, _ = _parts(spark, sf_dir)
    return m.wau_whole_weeks(_stats(spark, sf_dir), acc.person_events(d["attendance"], d["gift"]), SINCE)


@register("stickiness", sql=q.with_adapter(ACCOUNTS_SQL, f"s AS ({STATS_SINCE})", select="""
SELECT mo, avg(active_users_week) / active_users_month AS stickiness FROM s GROUP BY mo, active_users_month"""))
def stickiness(spark, sf_dir):
    """Mean weekly actives / monthly actives."""
    return m.stickiness(_stats(spark, sf_dir), SINCE)


@register("avg_weekly_activation", sql=q.with_adapter(ACCOUNTS_SQL, f"""
s AS (SELECT *, count(week_number) OVER (PARTITION BY mo) AS weeks FROM ({STATS_SINCE}) x)""", select="""
SELECT mo, weeks, avg(active_users_week) AS awa FROM s GROUP BY mo, weeks"""))
def avg_weekly_activation(spark, sf_dir):
    """Mean weekly actives by (month, weeks in month)."""
    return m.avg_weekly_activation(_stats(spark, sf_dir), SINCE)


@register("time_to_activate", sql=q.with_adapter(FEATURES_SQL, select=f"""
SELECT CAST(date_trunc('month', person_created_date) AS DATE) AS mo, avg(time_to_activate) AS activation
FROM features WHERE person_created_date >= {ACTIVATION_DATE} AND time_to_activate >= 0 GROUP BY 1"""))
def time_to_activate(spark, sf_dir):
    """Mean days to activate per creation month."""
    return m.time_to_activate(_people(spark, sf_dir), ACTIVATION_SINCE)


@register("time_to_activate_hist", sql=q.with_adapter(FEATURES_SQL, select=f"""
SELECT CAST(ceil((time_to_activate - 10.0) / 20.0) AS BIGINT) * CAST(20 AS DOUBLE) AS bin, count(*) AS count
FROM features WHERE person_created_date >= {ACTIVATION_DATE} AND time_to_activate BETWEEN 0 AND 100
GROUP BY 1"""))
def time_to_activate_hist(spark, sf_dir):
    """Days-to-activate histogram, width 20."""
    return m.time_to_activate_hist(_people(spark, sf_dir), ACTIVATION_SINCE)


@register("retention_hist", sql=q.with_adapter(RETENTION_SQL, select="""
SELECT CAST(ceil((retention_days - 3.5) / 7.0) AS BIGINT) * CAST(7 AS DOUBLE) AS bin, count(*) AS count
FROM retention WHERE retention_days < 60 GROUP BY 1"""))
def retention_hist(spark, sf_dir):
    """Days to return below 60, weekly bins."""
    return m.retention_hist(_retention(spark, sf_dir))


@register("retention_density", sql=q.with_adapter(RETENTION_SQL, select="""
SELECT bin, count / (CAST(sum(count) OVER () AS DOUBLE) * 7) AS density FROM (
  SELECT CAST(ceil((retention_days - 3.5) / 7.0) AS BIGINT) * CAST(7 AS DOUBLE) AS bin, count(*) AS count
  FROM retention WHERE retention_days < 60 GROUP BY 1) h"""))
def retention_density(spark, sf_dir):
    """The same bins scaled to a density."""
    return m.retention_hist(_retention(spark, sf_dir), density=True)


# --- loess of the WAU and stickiness series (L22/L23) --------------------------------

SERIES_SQL = f"""
series AS (
  SELECT 'wau' AS key, CAST(week_number - DATE '1970-01-01' AS DOUBLE) AS x,
         CAST(sum(active_users_week) AS DOUBLE) AS y
  FROM ({STATS_SINCE}) s WHERE week_number IS NOT NULL GROUP BY week_number
  UNION ALL
  SELECT 'stickiness', CAST(mo - DATE '1970-01-01' AS DOUBLE), avg(active_users_week) / active_users_month
  FROM ({STATS_SINCE}) s GROUP BY mo, active_users_month),
series_ok AS (SELECT * FROM series WHERE x IS NOT NULL AND y IS NOT NULL),
sn AS (SELECT key, count(*) AS n FROM series_ok GROUP BY key),
pairs AS (SELECT a.key, a.x AS x0, b.x, b.y, abs(b.x - a.x) AS d
          FROM series_ok a JOIN series_ok b ON a.key = b.key),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key, x0 ORDER BY d) AS r FROM pairs),
bw AS (SELECT r.key, r.x0, max(CASE WHEN r.r = greatest(floor(sn.n * 0.75), 1) THEN r.d END) AS h
       FROM ranked r JOIN sn ON sn.key = r.key GROUP BY r.key, r.x0),
wt AS (SELECT p.key, p.x0, (p.x - p.x0) / bw.h AS u, p.y,
              CASE WHEN p.d / bw.h < 1 THEN pow(1 - pow(p.d / bw.h, 3), 3) ELSE 0 END AS w
       FROM pairs p JOIN bw ON bw.key = p.key AND bw.x0 = p.x0),
mom AS (SELECT key, x0, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3,
               sum(w * u * u * u * u) AS s4, sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2
        FROM wt GROUP BY key, x0)"""


def _series(spark, sf_dir):
    from pyspark.sql import functions as F
    stats = _stats(spark, sf_dir)
    w = m.wau(stats, SINCE).where(F.col("week_number").isNotNull()).select(
        F.lit("wau").alias("key"), F.unix_date("week_number").alias("x"), F.col("total_active_users").alias("y"))
    s = m.stickiness(stats, SINCE).select(F.lit("stickiness").alias("key"), F.unix_date("mo").alias("x"),
                                          F.col("stickiness").alias("y"))
    return w.unionByName(s)


@register("loess_series", sql=q.with_adapter(ACCOUNTS_SQL, SERIES_SQL, select="""
SELECT mom.key, mom.x0 AS x, so.y,
       round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
             / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)), 6) AS fit
FROM mom JOIN series_ok so ON so.key = mom.key AND so.x = mom.x0"""))
def loess_series(spark, sf_dir):
    """Loess (span 0.75, degree 2) of the WAU and stickiness series."""
    from pyspark.sql import functions as F

    from ..operators.smooth import loess
    fit = loess(_series(spark, sf_dir), "x", "y", key="key")
    return fit.withColumn("fit", F.round("fit", 6))


@register("loess_band")
def loess_band(spark, sf_dir):
    """The 95 % confidence band of the same fits (exact smoother matrix)."""
    from ..operators.smooth import loess
    return loess(_series(spark, sf_dir), "x", "y", key="key", level=0.95)
