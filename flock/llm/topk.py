"""Operator 9, exact top-k search by block-at-a-time pruning.

Vectors are quantised and kept in blocks, each a forward index (its vectors as
one matrix) with the maximum and minimum of every term (component).  The sum
over terms of the larger of q * max and q * min bounds every score of a block.
A query takes blocks in the order of that bound and stops when it falls below
its k-th best score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._util import bucket_count

#: Vectors of a block, and vectors of the blocks one task scans for one batch of queries.
BLOCK, SCAN, QUERIES = 256, 16_384, 512
SCALE = 1024


def quantise(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, values): floor(SCALE * x) of whole, finite vectors; others are left out."""
    v = F.col(vector_col)
    good = F.forall(F.coalesce(v, F.array()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return (vectors.where(v.isNotNull() & good & (F.size(v) > 0))
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("values")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(-1, width)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while every partial sum stays below 2**53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < 2**53:
        return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def scan(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray,
         k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the positions and scores of its best ``k`` vectors, ties to smaller ids,
    leaving out the query's own row and, if it is so, all that score below ``floor``."""
    starts = np.arange(0, len(vectors), BLOCK)
    high = np.maximum.reduceat(vectors, starts, axis=0)
    low = np.minimum.reduceat(vectors, starts, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = _products(up, high) + _products(down, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best_pos = [np.zeros(0, np.int64) for _ in queries]
    best_score = [np.zeros(0, np.int64) for _ in queries]
    kth = floor.copy()
    live = np.ones(len(queries), bool)
    for turn in range(len(starts)):
        block = order[:, turn]
        live &= bounds[np.arange(len(queries)), block] >= kth
        if not live.any():
            break
        for b in np.unique(block[live]):
            who = np.flatnonzero(live & (block == b))
            here = np.arange(starts[b], min(starts[b] + BLOCK, len(vectors)))
            scores = _products(queries[who], vectors[here])
            for i, s in zip(who.tolist(), scores):
                take = (s >= kth[i]) & (rows[here] != own[i])
                if take.any():
                    pos = np.concatenate([best_pos[i], here[take]])
                    val = np.concatenate([best_score[i], s[take]])
                    top = np.lexsort((ids[pos], -val))[:k]
                    best_pos[i], best_score[i] = pos[top], val[top]
                    if len(top) == k:
                        kth[i] = max(kth[i], val[top[-1]])
    return list(zip(best_pos, best_score))


_LAST = np.iinfo(np.int64).max
_FOUND = "query_row long, query_id long, vec_id long, score long"


def _scan_group(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            width = int(key[0].as_py())
            queries, vectors = _matrix(left.column("values"), width), _matrix(right.column("values"), width)
            ids = right.column("vec_id").fill_null(_LAST).to_numpy()
            own, qid = left.column("row").to_numpy(), left.column("vec_id").to_numpy()
            for i, (pos, score) in enumerate(scan(queries, own, left.column("floor").to_numpy(), vectors, ids, right.column("row").to_numpy(), k)):
                found.append(pa.table({"query_row": np.full(len(pos), own[i]), "query_id": np.full(len(pos), qid[i]),
                                       "vec_id": pa.array(ids[pos], mask=ids[pos] == _LAST), "score": score}))
        if found:
            return pa.concat_tables(found)
        return pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "vec_id", "score")})
    return run


def _rank(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of each
    row whose id is divisible by ``every``, against all other rows.

    Ties go to the smaller id (a null id last).  Vectors that are null, empty or
    hold a null or non-finite component take no part.  Vectors meet vectors of
    their own length only.  Rows that repeat an id are rows of their own, as
    queries and as candidates; a query leaves out its own row alone.  Scores
    must fit a long.  Fewer than ``k`` other rows: all of them.

    Scale: all queries meet all vectors, that is the task.  Vectors are dealt to
    groups of SCAN, queries to batches of QUERIES, and each (batch, group) is one
    task of bounded memory.  A first wave scans one group for each query, which
    gives the k-th score from which the second wave prunes all other groups; a
    query's rows are k for each group, ranked by two window passes.
    """
    v = quantise(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id())
    v = materialize(v.withColumn("width", F.size("values")))
    rows = v.count()
    is_query = F.col("vec_id") % every == 0
    groups = bucket_count(rows, SCAN)
    batches = bucket_count(v.where(is_query).count(), QUERIES)
    # neighbours in the input share a block
    ranged = v.withColumn("group", F.pmod(F.xxhash64((F.col("row") / BLOCK).cast("long")), F.lit(groups)).cast("int"))
    q = ranged.where(is_query).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))
    q = q.select("batch", "row", "vec_id", "values", "width", "group")
    each_batch = ranged.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))

    def wave(queries: DataFrame) -> DataFrame:
        keys = ["width", "batch", "group"]
        queries = queries.toDF(*queries.columns)  # columns of their own: both sides come from one table
        return queries.groupBy(*keys).cogroup(each_batch.groupBy(*keys)).applyInArrow(_scan_group(k), _FOUND)

    lowest = F.lit(-(1 << 62)).cast("long")
    first = materialize(wave(q.withColumn("floor", lowest)))
    floors = first.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    rest = q.join(floors, q["row"] == floors["query_row"], "left").withColumn("floor", F.coalesce("floor", lowest))
    rest = rest.withColumn("home", F.col("group")).drop("group").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    second = wave(rest.where("group <> home").select("batch", "row", "vec_id", "values", "width", "group", "floor"))
    return _rank(first.unionByName(second), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
