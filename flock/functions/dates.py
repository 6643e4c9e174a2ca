"""Calendar expressions, all JVM-side column expressions (no UDFs).

Conventions follow the reference's T-SQL semantics (SURVEY S1-S4):

* month bucket  = first day of the month (``trunc``), null in -> null out;
* week label    = the Saturday *before* the day: weeks run Sunday..Saturday and
  a Saturday gets the label seven days earlier (``DATEADD(WEEK, DATEDIFF(WEEK,
  6, t), 5)``);
* week start    = the Saturday on or before the day (the calendar dimension);
* week distance = number of Sunday boundaries crossed;
* month distance = number of calendar-month boundaries crossed;
* day distance  = number of midnights crossed (may be negative).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_ZERO = "1900-01-01"  # day 0 of an int compared with a datetime in T-SQL


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(c) -> Column:
    return F.to_date(_c(c))


def month_bucket(c) -> Column:
    """``CAST(CONCAT(YEAR(t),'-',MONTH(t),'-01') AS DATE)``."""
    return F.trunc(as_date(c), "MM")


def week_label(c) -> Column:
    """Saturday strictly before the day for Sunday..Friday, a week earlier for a Saturday."""
    d = as_date(c)
    return F.date_sub(d, F.dayofweek(d))


def week_start(c, first_day: str = "SAT") -> Column:
    """Start of the week containing the day (calendar dimension, A5)."""
    d = as_date(c)
    shift = {"SUN": 0, "MON": 1, "TUE": 2, "WED": 3, "THU": 4, "FRI": 5, "SAT": 6}[first_day.upper()]
    # dayofweek: Sunday = 1 .. Saturday = 7
    return F.date_sub(d, (F.dayofweek(d) - 1 - F.lit(shift) + 7) % 7)


def sunday_week_index(c) -> Column:
    """Week number counted in Sunday boundaries since the epoch (``DATEDIFF(WEEK)``)."""
    return F.floor((F.unix_date(as_date(c)) + 4) / 7)


def week_diff(a, b) -> Column:
    return sunday_week_index(b) - sunday_week_index(a)


def month_diff(a, b) -> Column:
    """``DATEDIFF(MONTH, a, b)``: calendar-month boundaries between a and b."""
    a, b = as_date(a), as_date(b)
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("int")


def day_diff(a, b) -> Column:
    """``DATEDIFF(DAY, a, b)``: midnights between a and b."""
    return F.datediff(as_date(b), as_date(a))


def lit_date(d) -> Column:
    if isinstance(d, (_dt.date, _dt.datetime)):
        d = d.strftime("%Y-%m-%d")
    return F.lit(str(d)).cast("date")


def closed_count_threshold(as_of) -> Column:
    """The literal S10 bound: ``count <= DATEADD(MONTH,-2,as_of)`` converts the
    datetime to days since 1900-01-01."""
    return F.datediff(F.add_months(lit_date(as_of), -2), lit_date(DAY_ZERO))


def since_year(c, year: int) -> Column:
    """``format(col,'%Y') >= year`` written as a range test so it prunes/pushes down."""
    return _c(c) >= lit_date(f"{int(year):04d}-01-01")


def date_dim(spark: SparkSession, start, end, first_day: str = "SAT") -> DataFrame:
    """Calendar dimension ``(full_date, week_start)`` for [start, end].

    Generated with ``sequence`` + ``explode`` over year slices so no single
    task builds a long range."""
    years = spark.range(_year(start), _year(end) + 1).select(F.col("id").cast("int").alias("y"))
    lo = F.greatest(F.make_date("y", F.lit(1), F.lit(1)), lit_date(start))
    hi = F.least(F.make_date("y", F.lit(12), F.lit(31)), lit_date(end))
    days = years.select(F.explode(F.sequence(lo, hi)).alias("full_date"))
    return days.select("full_date", week_start("full_date", first_day).alias("week_start"))


def _year(d) -> int:
    if isinstance(d, (_dt.date, _dt.datetime)):
        return d.year
    return int(str(d)[:4])


def add_months_lit(as_of, n: int) -> Column:
    """``DATEADD(MONTH, n, as_of)`` (end-of-month clamped, like T-SQL)."""
    return F.add_months(lit_date(as_of), n)


def date_dim_over(df: DataFrame, col: str, first_day: str = "SAT") -> DataFrame:
    """Calendar dimension covering the dates of ``df[col]``; built lazily from
    the min/max aggregate, one ``sequence`` per calendar year."""
    b = df.agg(F.min(as_date(col)).alias("lo"), F.max(as_date(col)).alias("hi"))
    years = b.select("lo", "hi", F.explode(F.sequence(F.year("lo"), F.year("hi"))).alias("y"))
    lo = F.greatest(F.make_date("y", F.lit(1), F.lit(1)), F.col("lo"))
    hi = F.least(F.make_date("y", F.lit(12), F.lit(31)), F.col("hi"))
    days = years.select(F.explode(F.sequence(lo, hi)).alias("full_date"))
    return days.select("full_date", week_start("full_date", first_day).alias("week_start"))
