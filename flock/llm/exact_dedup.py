"""Operator 5, exact dedup: one row per class of byte-equal texts stays.

Rows are grouped by the 128-bit hash of their whole text.  Only narrow
fingerprints travel for that.  The texts of groups with two rows or more then
meet in a second grouping by hash *and* text, which compares bytes, so a
collision never joins two different texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._util import hint_if_small


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    * ``keep``: "min" or "max", the id of the row that stays.  A null id loses
      against any other.  Of rows that share text and id, one stays.
    * A null text counts as empty.  An empty table gives an empty result.
    * Other columns of ``docs`` are not read, whatever their names.

    Scale: the texts are read twice.  The first pass shuffles 16-byte hashes
    (combined per task first, so a hot group is one row per task).  The second
    shuffles texts of repeated groups only, again combined per task; the
    repeated hashes reach the scan by broadcast when their measured size is
    small, else by a shuffled join.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("h", F.unhex(F.md5("t")))
    rows = materialize(d.select("doc_id", "h", F.unhex(F.sha2("t", 256)).alias("sha"))
                       .withColumn("rid", F.monotonically_increasing_id()))
    if keep == "max":  # a null sorts lowest
        best = F.max(F.struct("doc_id", "rid"))
    else:
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    repeated = materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    # bytes compared: rows of one group share hash and text
    same = d.join(hint_if_small(repeated, 40), "h").groupBy("h", "t").agg(F.count(F.lit(1)).alias("group_size"))
    same = (same.select("h", F.unhex(F.sha2("t", 256)).alias("sha"), "group_size")
            .groupBy("h", "sha").agg(F.count(F.lit(1)).alias("texts"), F.sum("group_size").alias("group_size")))
    same = same.withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long")))
    first = rows.join(hint_if_small(repeated, 40), "h").groupBy("h", "sha").agg(best.alias("best"))
    classes = materialize(same.join(first, ["h", "sha"]).where("group_size > 1")
                          .select("h", "sha", "group_size", F.col("best.doc_id").alias("keep_id"),
                                  F.col("best.rid").alias("keep_rid")))
    out = rows.join(hint_if_small(classes, 100), ["h", "sha"], "left")
    alone = F.col("group_size").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))
