"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release

#: A table is broadcast only when its measured size stays under this.
BROADCAST_BYTES = 32 << 20
#: Rows that one window partition of a numbering may hold on average.
NUMBERING_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hint_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit in ``limit`` bytes,
    else unchanged (a shuffled join, whose skewed partitions AQE splits).
    ``df`` should be materialized: it is counted here."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bucket_count(rows: int, per_bucket: int = NUMBERING_ROWS) -> int:
    return max(1, -(-rows // per_bucket))


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str, rows: int | None = None) -> DataFrame:
    """``df`` with the column ``name``: 0, 1, 2 ... without gaps inside each ``group``.

    A plain ``row_number`` would put a whole group in one task.  Here rows go
    to hash buckets of about ``NUMBERING_ROWS``; the buckets' counts give each
    bucket its first number, and rows are numbered inside (group, bucket).
    The order inside a bucket is ``order``, so equal input gives equal output.
    ``df`` is read twice and should be a materialized table.
    """
    from pyspark.sql import Window

    buckets = bucket_count(df.count() if rows is None else rows)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    if buckets == 1:
        return df.withColumn(name, (F.row_number().over(inside) - 1).cast("long")).drop("_bucket")
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"),
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    on: Column = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    numbered = df.withColumn("_i", F.row_number().over(inside) - 1)
    return (numbered.join(hint_if_small(materialize(firsts), 64), on)
            .withColumn(name, (F.col("_first") + F.col("_i")).cast("long"))
            .drop("_bucket", "_b", "_first", "_i", *[f"_g{i}" for i in range(len(group))]))


def in_order(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df``, written, with tree (a number that ascends with ``group``, null first), pos (0, 1 ... in the
    group by ``order``) and n (rows of the group).

    Rows are dealt by range and sorted inside partitions; partitions' counts give each row its number in
    the whole table.  No task holds a whole group, and rows alike in all keys are spread by a row number."""
    from pyspark.sql import Window

    numbered = materialize(df.withColumn("_rid", F.monotonically_increasing_id()))
    keys = [group, *order]
    rows = materialize(numbered.repartitionByRange(*keys, "_rid").sortWithinPartitions(*keys, "_rid").drop("_rid")
                       .withColumn("_at", F.monotonically_increasing_id()))
    release(numbered)
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = materialize(rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
                         .select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start")))
    rows = rows.withColumn("_p", part).join(hint_if_small(starts, 32), "_p")
    rows = rows.withColumn("_g", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_start", "_at")
    groups = materialize(rows.groupBy(F.col(group).alias("_key")).agg(F.min("_g").alias("tree"), F.count(F.lit(1)).alias("n")))
    return (rows.join(hint_if_small(groups, 128), F.col(group).eqNullSafe(F.col("_key")))
            .withColumn("pos", F.col("_g") - F.col("tree")).drop("_g", "_key"))
