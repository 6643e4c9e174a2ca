"""Operator 6, mixing sources to target weights by entropy balancing.

Each source gets a token target.  Document rates minimise the entropy
sum(size * (r * log r - r)) under the token constraint of every source,
sum(size * r) = target.  The convex dual has one multiplier per source,
``size_s * exp(l) - l * target_s``, and rates are exponentially tilted:
r = exp(l).  Newton steps on the dual run in parallel on the rows of the
source table, and rates are rounded to whole copies.

Documents weigh by their tokens in the entropy.  Unweighted, the tilt would be
exp(l * size): long documents would vanish from shrunk sources and pass any
copy limit in grown ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._util import bucket_count, hint_if_small

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """``sources`` (one row per source) with ``weight``: the cycle dealt by code
    point order, null last.  The order is found by ranges, not in one task."""
    ranged = sources.withColumn("_last", F.col("source").isNull())
    ranged = materialize(ranged.repartitionByRange(ranged["_last"], F.col("source").asc_nulls_last())
                         .withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_p", F.coalesce(F.sum("_n").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # a row per range
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_last", "source")) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return (ranged.withColumn("_i", rank).join(counts, "_p")
            .withColumn("weight", F.element_at(weights, (F.pmod(F.col("_first") + F.col("_i"), F.lit(len(cycle))) + 1).cast("int")))
            .drop("_p", "_last", "_i", "_first"))


def fill_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: ``share`` of all
    tokens dealt by weight, none above ``most`` times its source, the excess dealt
    again by weight until none is above.  Each round is one aggregate of two sums."""
    sources = materialize(sources)
    top = F.lit(float(most)) * F.col("source_size")
    total = sources.agg((F.sum("source_size") * F.lit(float(share)))).first()[0] or 0.0
    factor, full = 0.0, None
    while True:
        above = F.lit(False) if full is None else top < F.lit(factor) * F.col("weight")
        s = sources.agg(F.sum(F.when(above, top).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
                        F.sum(above.cast("long"))).first()
        if s[2] is None or s[2] == full or not s[1]:
            break
        full, factor = s[2], (total - s[0]) / s[1]
    given = F.lit(factor) * F.col("weight")
    if s[2] and not s[1]:
        given = top  # every source is full
    return sources.withColumn("target", F.least(top, given))


def newton_rate(size: Column, target: Column, steps: int = 40) -> Column:
    """exp(l) at the minimum of size * exp(l) - l * target: Newton from l = 0,
    l -= 1 - target / (size * exp(l)).  The dual is convex, a step below the
    minimum is cut at +1 (it would overshoot), and 40 steps reach rates of 1e-12."""
    step = lambda l, _: l - F.greatest(F.lit(-1.0), F.lit(1.0) - target / (size * F.exp(l)))
    tilt = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return F.when((size > 0) & (target > 0), F.exp(tilt)).otherwise(F.lit(0.0))


def mix(docs: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size,
    target, copies, taken (size * copies).

    * size: words of the text (null: 0).  A null source is a source of its own.
    * copies: the whole part of its source's rate, and one more for documents
      in the order of md5(doc_id) until the source's target is met: a document
      whose middle lies inside the rest of the target.  A source misses its
      target by half a document at most.  A document without words gets no extra
      copy.  Copies never pass ``most`` rounded up.
    * Runs agree: the order depends on the rows only.  Rows alike in id and size
      are interchangeable.  A null id sorts by the md5 of "".
    * Empty tables give an empty result; other columns are not read.

    Scale: (id, source, size) is written once; sources are sums.  The running
    sum that decides the extra copies is taken over hash buckets; only the one
    bucket of each source where the target falls is ordered row by row.
    """
    spark = docs.sparkSession
    d = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
                    .withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sums = d.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = fill_targets(source_weights(sums, cycle), share, most)
    rate = newton_rate(F.col("source_size").cast("double"), F.col("target"))
    targets = targets.withColumn("rate", rate)
    # rates are whole up to rounding error when a source is full
    targets = targets.withColumn("base", F.floor(F.col("rate") + 1e-9).cast("long"))
    targets = materialize(targets.withColumn("rest", F.greatest(F.lit(0.0), (F.col("rate") - F.col("base")) * F.col("source_size")))
                          .select(F.col("source").alias("s"), "source_size", "target", "base", "rest"))
    digits = len(f"{bucket_count(d.count()) - 1:x}") + 1
    d = d.withColumn("bucket", F.substring("key", 1, digits))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
               .withColumn("sum_before", F.coalesce(F.sum("words").over(before), F.lit(0))))
    buckets = buckets.join(hint_if_small(targets, 100), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("s"), F.col("bucket").alias("b"), "source_size", "target", "base", "rest", "sum_before",
        F.when(F.col("sum_before") + F.col("words") <= F.col("rest"), "all").when(F.col("sum_before") > F.col("rest"), "none")
        .otherwise("some").alias("state"))
    rows = materialize(d.join(hint_if_small(materialize(buckets), 160),
                              F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("sum_before") + F.sum("size").over(order) - F.col("size") / 2.0
    some = rows.where("state = 'some'").withColumn("extra", ((F.col("size") > 0) & (middle <= F.col("rest"))).cast("long"))
    whole = rows.where("state <> 'some'").withColumn("extra", ((F.col("size") > 0) & (F.col("state") == "all")).cast("long"))
    return whole.unionByName(some).select("doc_id", "size", "source_size", "target",
                                          (F.col("base") + F.col("extra")).alias("copies"),
                                          ((F.col("base") + F.col("extra")) * F.col("size")).alias("taken"))
