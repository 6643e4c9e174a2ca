"""Exact order statistics by range partitioning.

Values are counted per (key, value) with partial aggregation.  Spark draws
splitters over (key, value) from a sample of the distinct values and deals them
to ranges; the ranges' totals, a table of a few rows per key, give each range
the rank it starts at.  Only the ranges that hold a wanted rank are then sorted
and summed.  Splitters fall where the values are, so a column of a narrow band
(two million seconds of one month, say) is cut as finely as any other, and a
value that makes half of a column is one row.  The result is exact: the
splitters only decide who does the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Ranges of the counted values; a sort holds about one of them.
RANGES = 48


def counted(long: DataFrame, key: str = "key", value: str = "value", ranges: int | None = None) -> DataFrame:
    """A written table (key, value, cnt, part): how often each value occurs (a null value too), dealt by
    range.  ``long`` is read once; the number of ranges grows with the session's shuffle partitions."""
    spark = long.sparkSession
    ranges = ranges or max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = long.groupBy(key, value).agg(F.count(F.lit(1)).alias("cnt"))
    dealt = counts.repartitionByRange(ranges, key, value).withColumn("part", F.spark_partition_id())
    # a task writes several ranges one after the other, so narrow tables make few files
    return materialize(dealt.coalesce(min(ranges, max(8, spark.sparkContext.defaultParallelism))))


def range_totals(counts: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, part, rows, off, n): non-null rows of a range, rows of the key before it, rows of the key.
    The windows hold one row per range that a key lies in."""
    per = counts.where(F.col(value).isNotNull()).groupBy(key, "part").agg(F.sum("cnt").alias("rows"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (per.withColumn("off", F.coalesce(F.sum("rows").over(before), F.lit(0)))
            .withColumn("n", F.sum("rows").over(whole)))


def running_counts(counts: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value, cnt, cum, n): running totals in value order, summed inside (key, range)."""
    inside = Window.partitionBy(key, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = counts.where(F.col(value).isNotNull()).join(range_totals(counts, key, value), [key, "part"])
    return j.withColumn("cum", F.col("off") + F.sum("cnt").over(inside)).select(key, value, "cnt", "cum", "n")


def values_at(counts: DataFrame, ranks: dict[str, Callable[[Column], Column]], key: str = "key",
              value: str = "value", few_keys: bool = False) -> DataFrame:
    """(key, n, one column per entry of ``ranks``): the value at a 1-based rank, a whole-number function of n.

    ``few_keys``: the keys are column names, so the wanted ranges are at most keys x ranks and are broadcast;
    else Spark decides from their size at run time."""
    totals = range_totals(counts, key, value)
    want = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank"))
                               for name, rank in ranks.items()])).alias("want")
    hits = (totals.select(key, "part", "off", "rows", "n", want)
            .where((F.col("want.rank") > F.col("off")) & (F.col("want.rank") <= F.col("off") + F.col("rows")))
            .groupBy(key, "part", "off", "n").agg(F.collect_list("want").alias("wants")))
    inside = Window.partitionBy(key, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counts.where(F.col(value).isNotNull()).join(F.broadcast(hits) if few_keys else hits, [key, "part"])
    found = found.withColumn("cum", F.col("off") + F.sum("cnt").over(inside))
    here = F.filter("wants", lambda w: (w["rank"] <= F.col("cum")) & (w["rank"] > F.col("cum") - F.col("cnt")))
    found = found.select(key, value, "n", F.explode(here).alias("w"))
    return found.groupBy(key).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("w.name") == name, F.col(value))).alias(name)
                                                           for name in ranks])


def quantile_ranks(probs, names) -> dict[str, Callable[[Column], Column]]:
    """Ranks below and above each type-7 quantile, as ``<name>_lo`` and ``<name>_hi``."""
    out = {}
    for p, name in zip(probs, names):
        out[f"{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p) + 1)
        out[f"{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p) + 1)
    return out


def quantile7(p: float, name: str) -> Column:
    """The type-7 quantile from its two neighbours: h = (n - 1) p + 1, interpolated."""
    h = (F.col("n") - 1) * F.lit(p) + 1
    lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    return lo + (h - F.floor(h)) * (hi - lo)
