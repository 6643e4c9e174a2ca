"""A training corpus from ``documents``: five stages, each one of the llm operators.

Every stage reads what the stage before it kept; all but the last return the
columns of ``documents``.  Rows are told apart by id and text, so repeated ids
do no harm.
"""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flock.llm._util import hint_if_small, table
from flock.llm.jaccard_join import jaccard_join
from flock.llm.line_dedup import line_dedup
from flock.llm.mixing import mix
from flock.llm.packing import best_fit_pack
from flock.llm.quality import score_quality, train_quality
from flock.session import ensure_checkpoint_dir, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shared five-word shingles of 0.8 or more.
WIDTH, PERCENT = 5, 80
#: Pairs of least shingle hashes by which the line stage tells near copies.
BANDS = 7


def _row_key() -> Column:
    return F.struct("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good (score of 0.5 or more)."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), model).where("_score >= 0.5").select(*COLUMNS)


def _shingle_hashes(text: Column) -> Column:
    """Hashes of the text's five-word shingles (A-Z lower-cased); fewer words are one shingle."""
    words = F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def hashed(w: Column) -> Column:
        first = F.sequence(F.lit(0), F.greatest(F.size(w) - WIDTH, F.lit(0)))
        return F.transform(first, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)]))

    # A lambda's variable is taken once; a text's words named in the inner lambda would be found anew for every
    # shingle, and a slice would copy them all.
    return F.transform(F.array(words), hashed)[0]


def _bands(least: Column) -> Column:
    """Hashes of the neighbouring pairs among a text's least shingle hashes (of the one, if there is but one)."""
    pair = [F.when(F.get(least, b + 1).isNotNull() | F.lit(b == 0), F.xxhash64(F.get(least, b), F.get(least, b + 1))) for b in range(BANDS)]
    return F.array_compact(F.array(*pair))


def pages(docs: DataFrame) -> DataFrame:
    """(source, md5, page): texts of a source that share a band with another one, and the page they are: the
    least md5 among all that share one with them.  Others are pages of their own.

    The BANDS + 1 least of a text's distinct shingle hashes are a random sample of its shingles, and near copies
    have nearly the same ones: at 0.8 shared shingles a pair of neighbours among them is in both samples more
    often than not, and one of BANDS pairs almost surely.  Texts with little in common rarely share one; for the share of a line in its source it hardly matters if they do, since pages and pages with the
    line fall alike.  Only hashes travel, least and greatest first taken in each task."""
    keyed = docs.where(F.col("source").isNotNull()).select("source", F.md5("text").alias("md5"), _shingle_hashes(F.col("text")).alias("hashes"))
    keyed = keyed.select("source", "md5", F.slice(F.sort_array(F.array_distinct("hashes")), 1, BANDS + 1).alias("least"))
    keyed = materialize(keyed.select("source", "md5", F.explode(_bands(F.col("least"))).alias("band")))
    shared = (keyed.groupBy("source", "band").agg(F.min("md5").alias("least"), F.max("md5").alias("most"))
              .where("least <> most").select("source", "band", "least"))
    met = keyed.join(hint_if_small(materialize(shared), 80), ["source", "band"])
    return materialize(met.groupBy("source", "md5").agg(F.min("least").alias("page")).where("page <> md5"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; a source is the site.

    Copies and near copies are one page: else the lines of a document that makes much of its source would pass
    for boilerplate, and every copy of it would lose them.  Near copies are told by their least shingle hashes in
    DataFrame functions alone.  Texts without words, or null, are one page of a source; a null source has no site."""
    docs = docs.select(*COLUMNS)
    full = docs.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    other = pages(full).select(F.col("source").alias("_s"), F.col("md5").alias("_m"), "page")
    paged = docs.withColumn("_md5", F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.md5("text")))
    paged = paged.join(hint_if_small(other, 140), (F.col("source") == F.col("_s")) & (F.col("_md5") == F.col("_m")), "left")
    paged = paged.withColumn("_page", F.coalesce("page", "_md5")).drop("_s", "_m", "page", "_md5")
    out = line_dedup(paged, host_col="source", page_col="_page")
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    docs = docs.select(*COLUMNS)
    joined = materialize(jaccard_join(docs.withColumn("key", _row_key()), WIDTH, PERCENT, id_col="key"))
    rows = joined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n"), F.min("component_id").alias("component_id"))
    rows = rows.withColumnRenamed("doc_id", "key")
    other = materialize(rows.where("n > 0 AND key <> component_id").select("key"))
    again = materialize(rows.where("n > 0 AND key = component_id AND rows > 1").select("key"))
    keyed = docs.withColumn("key", _row_key())
    single = keyed.join(hint_if_small(other, 100), "key", "left_anti").join(hint_if_small(again, 100), "key", "left_anti")
    once = keyed.join(hint_if_small(again, 100), "key", "left_semi").dropDuplicates(["key"])
    return single.unionByName(once).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    docs = docs.select(*COLUMNS).withColumn("key", _row_key())
    copies = mix(docs.select(F.col("key").alias("doc_id"), "text", "source"))
    copies = materialize(copies.groupBy(F.col("doc_id").alias("key")).agg(F.max("copies").alias("copies")).where("copies > 0"))
    return docs.join(hint_if_small(copies, 100), "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return best_fit_pack(docs, special=True)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources to target weights", mixing), ("best-fit packing", packing)]

#: A trained model and a tokenizer are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{i}")
            docs = spark.read.parquet(f"{root}/{i}")
    return docs
