"""Operator 4, sharding: minimax contiguous partition of atomic groups.

Groups of equal texts are ordered by size; the smallest shard capacity for
which greedy filling needs no more than the given shards is found by search,
and the order is cut there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._util import number_rows

#: Capacities tried at once in a round of the search.
TRIED_AT_ONCE = 32


def running_sums(groups: DataFrame, size: str, order: list) -> DataFrame:
    """``groups`` with ``part`` and ``upto`` (sum of ``size`` up to and with the row in
    ``order``): range partitions, their totals as offsets, a running sum inside."""
    ranged = materialize(groups.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum(size).alias("_t"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return materialize(ranged.withColumn("_s", F.sum(size).over(inside)).join(totals, "part")
                       .withColumn("upto", (F.col("_before") + F.col("_s")).cast("long")).drop("_before", "_s"))


def _reach(sums: DataFrame, wanted: list[int], most: int) -> list[int | None]:
    """For each wanted bound the largest ``upto`` not above it, in one pass that
    reads only the stretch of ``most`` (the largest group) under each bound."""
    near = F.lit(False)
    for x in set(wanted):
        near = near | F.col("upto").between(x - most, x)
    return list(sums.where(near).agg(*[F.max(F.when(F.col("upto") <= x, F.col("upto"))).alias(f"x{i}")
                                       for i, x in enumerate(wanted)]).first())


def minimax_cuts(sums: DataFrame, shards: int, start: int, total: int, most: int) -> list[int]:
    """The ``upto`` values at which ``shards`` contiguous shards of the rows after
    ``start`` end, with the smallest largest shard.  Searches the capacity, many
    at once a round; each is checked by greedy filling, one pass a shard."""
    rest = total - start
    low, high = max(-(-rest // shards), most), -(-rest // shards) + most  # high always suffices
    best: list[int] | None = None
    while best is None or low < high:
        step = max(1, -(-(high - low + 1) // TRIED_AT_ONCE))
        tried = sorted({min(high, low + i * step) for i in range(TRIED_AT_ONCE + 1)})
        ends: list[list[int]] = [[] for _ in tried]
        for _ in range(shards):
            at = [e[-1] if e else start for e in ends]
            reached = _reach(sums, [min(a + c, total) for a, c in zip(at, tried)], most)
            for e, a, r in zip(ends, at, reached):
                e.append(max(a, r if r is not None else a))
        fits = next(i for i, e in enumerate(ends) if e[-1] == total)
        best = ends[fits]
        if fits == 0 or step == 1:
            break
        low, high = tried[fits - 1] + 1, tried[fits]
    return best


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every row of ``docs`` in a shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    * size: UTF-8 bytes of the text plus 1 (null text: 1).  Rows of equal text
      are one group and share a shard; null and empty texts are one group.
    * law "bytes": groups from large to small, cut into ``shards`` contiguous
      runs so that the largest is as small as it can be.  A group larger than
      an even share of what is left has a shard alone, and the others share the
      rest evenly.  Ties go by smallest id, then by text hash.
    * slot: 0, 1, ... without gaps in each shard.  grown_shard is null.
    * Fewer groups than shards leave shards empty; an empty table gives no rows.

    Scale: texts are read once and never shuffled.  Groups are summed per task
    first; their order is by ranges, with running sums inside ranges; the search
    reads the stretches of one number column in which a cut can fall.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                                   F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
                                   F.unhex(F.md5(text)).alias("text_md5")))
    groups = rows.groupBy("text_md5").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("low_id"))
    sums = running_sums(groups, "bytes", [F.col("bytes").desc(), F.col("low_id"), F.col("text_md5")])
    total, n = sums.agg(F.max("upto"), F.count(F.lit(1))).first()
    shard = F.lit(0)
    if n:
        largest = [(r[0], r[1]) for r in sums.orderBy("upto").limit(shards).select("bytes", "upto").collect()]
        cuts, start = [], 0
        for size, upto in largest[:-1]:
            if len(cuts) < shards - 1 and size * (shards - len(cuts)) >= total - start:
                cuts.append(upto)
                start = upto
            else:
                break
        if start < total:
            most = next((size for size, upto in largest if upto > start), largest[-1][0])
            cuts += minimax_cuts(sums, shards - len(cuts), start, total, most)
        for cut in cuts[:shards - 1]:
            shard = shard + (F.col("upto") > F.lit(cut)).cast("int")
    dealt = materialize(rows.join(sums.select("text_md5", shard.cast("int").alias("shard")), "text_md5"))
    return number_rows(dealt, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
