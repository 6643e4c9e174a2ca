"""Exact, reproducible stratified splits and folds.

Every row gets a hash rank ``md5('<seed>:<key>')``; in each stratum the
``floor(prop * n)`` rows with the smallest hashes are the training set.  R's
generator cannot be reproduced (S38); a keyed hash gives the same guarantee
(exact per-stratum sizes, fixed by the seed) on any engine.

Distributed: no window over a whole stratum (a stratum may hold most rows).
The first four hex digits of the hash split each stratum into 65,536
buckets; bucket sizes are counted with partial aggregation, a running count
over the (stratum, bucket) table - at most 65,536 rows per stratum - gives
each bucket's offset, and ranks inside a bucket come from a window over
(stratum, bucket), which holds about n / 65,536 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX = 4


def hash_rank(seed: int, key: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _in_buckets(df: DataFrame, strata: str, seed: int, key: str) -> DataFrame:
    """``df`` with _rank (from 1, in the stratum by hash and key) and _n (rows of the stratum)."""
    h = df.withColumn("_h", hash_rank(seed, key)).withColumn("_b", F.substring("_h", 1, BUCKET_HEX))
    buckets = h.groupBy(strata, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    ordered = Window.partitionBy(strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (buckets.withColumn("_off", F.coalesce(F.sum("_cnt").over(ordered), F.lit(0)))
               .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(strata)))
               .select(F.col(strata).alias("_s"), F.col("_b").alias("_bb"), "_off", "_n"))
    # null strata form their own stratum (null-safe join); every row has its bucket, the outer join only keeps the
    # rows, whose size is guessed too small from compressed files, from being the side that is broadcast
    j = h.where(F.col("_b").isNotNull()).join(offsets, F.col(strata).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_bb")), "left") \
        .drop("_s", "_bb")
    rank = F.col("_off") + F.row_number().over(Window.partitionBy(strata, "_b").orderBy("_h", key))
    return j.withColumn("_rank", rank).drop("_h", "_b", "_off")


def stratified_split(df: DataFrame, strata: str, prop: float = 0.8, seed: int = 987,
                     key: str = "id", out: str = "split") -> DataFrame:
    """Adds ``out`` = 'train' / 'test' with exactly floor(prop * n) training rows per stratum."""
    train = F.col("_rank") <= F.floor(F.col("_n") * prop)
    return _in_buckets(df, strata, seed, key).withColumn(out, F.when(train, "train").otherwise("test")).drop("_rank", "_n")


def stratified_folds(df: DataFrame, strata: str, folds: int = 10, seed: int = 987, key: str = "id",
                     out: str = "fold") -> DataFrame:
    """Adds ``out``: 0 .. folds - 1, dealt in turn by hash rank inside each stratum, so folds differ by a row a
    stratum at most and do not depend on how the table is partitioned."""
    fold = ((F.col("_rank") - 1) % folds).cast("int")
    return _in_buckets(df, strata, seed, key).withColumn(out, fold).drop("_rank", "_n")


def stratified_splits(df: DataFrame, strata: str, seeds: tuple[int, ...], prop: float = 0.8, key: str = "id",
                      out: str = "in_train") -> DataFrame:
    """Adds the array ``out``: for each seed, whether the row is in the training part that
    ``stratified_split`` gives it.  ``df`` is read three times for all seeds together and never moved.

    A split is told by one row of each stratum, the last training row by (hash, key).  Counts per (seed, stratum,
    hash bucket) find the bucket it lies in, and only the rows of these buckets (n / 65,536 of a stratum) are
    ordered.  Each row is then compared with its stratum's last training rows."""
    hashes = F.array(*[hash_rank(s, key) for s in seeds])
    each = df.select(F.col(strata).alias("_s"), F.posexplode(hashes).alias("_i", "_h"))
    per = each.groupBy("_i", "_s", F.substring("_h", 1, BUCKET_HEX).alias("_b")).agg(F.count(F.lit(1)).alias("_cnt"))
    whole = Window.partitionBy("_i", "_s")
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
           .withColumn("_take", F.floor(F.sum("_cnt").over(whole) * prop)))
    here = per.where((F.col("_off") < F.col("_take")) & (F.col("_off") + F.col("_cnt") >= F.col("_take")))
    # one row per stratum: the bucket of its last training row under each seed.  The hint names the side to broadcast
    # (a row a stratum): left to itself Spark may take the rows, whose size it guesses from compressed files and
    # before the hashes of all seeds are made
    here = here.groupBy(F.col("_s").alias("_s2")).agg(*[F.max(F.when(F.col("_i") == i, F.struct("_b", "_off", "_take"))).alias(f"_at{i}")
                                                       for i in range(len(seeds))])
    near = [F.when(F.substring(hash_rank(s, key), 1, BUCKET_HEX) == F.col(f"_at{i}._b"),
                   F.struct(F.lit(i).alias("_i"), hash_rank(s, key).alias("_h"), f"_at{i}._b", f"_at{i}._off", f"_at{i}._take"))
            for i, s in enumerate(seeds)]
    found = df.join(F.broadcast(here), F.col(strata).eqNullSafe(F.col("_s2"))).select(
        F.col(strata).alias("_s"), F.col(key).alias("_k"), F.inline(F.filter(F.array(*near), F.isnotnull)))
    rank = F.col("_off") + F.row_number().over(Window.partitionBy("_i", "_s", "_b").orderBy("_h", "_k"))
    last = found.withColumn("_r", rank).where(F.col("_r") == F.col("_take"))
    # one row per stratum: its last training row under each seed
    ends = last.groupBy(F.col("_s").alias("_s2")).agg(*[F.max(F.when(F.col("_i") == i, F.struct("_h", "_k"))).alias(f"_end{i}")
                                                       for i in range(len(seeds))])
    j = df.join(F.broadcast(ends), F.col(strata).eqNullSafe(F.col("_s2")), "left")
    mine = [F.coalesce(F.struct(hash_rank(s, key).alias("_h"), F.col(key).alias("_k")) <= F.col(f"_end{i}"), F.lit(False))
            for i, s in enumerate(seeds)]
    return j.withColumn(out, F.array(*mine)).drop("_s2", *[f"_end{i}" for i in range(len(seeds))])
