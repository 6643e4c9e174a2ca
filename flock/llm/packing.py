"""Operator 8, best-fit packing of tokenized documents into fixed sequences.

Large-item matching: items above a third of the capacity pair, at most two in
a sequence, the largest with the largest partner that fits; smaller items go,
largest first, to the sequence with the smallest gap that holds them.

Items differ only in length, and there are no more lengths than the capacity.
So the packing is found for counts of lengths (a bounded table, whatever the
corpus) and written as ranges of ranks: the items of length l with ranks
[low, high) go to sequences base, base + 1 ...  Spark ranks the items of each
length and joins them with those ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._bpe import default_ranks, encoder
from ._util import number_rows

CAPACITY = 2048
PLAN = "plan_length long, low long, high long, each long, base long, start_at long"


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole pieces, a shorter one first."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def _piece_rows(ranks: str, capacity: int, end_id: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, special)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                start = 0
                for piece, n in enumerate(piece_lengths(len(ids), capacity)):
                    rows.append((doc, piece, start, n, zlib.crc32(ids[start:start + n].tobytes())))
                    start += n
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.record_batch([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int32()),
                                   *[pa.array(c, pa.int64()) for c in columns[2:]]],
                                  ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None, end_id: int = 0, special: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and ``end_id``, cut."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _piece_rows(ranks or default_ranks(), capacity, end_id, special),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Packing of ``counts[length]`` items as rows of PLAN: the items of ``length`` with
    ranks low <= r < high go to sequence base + (r - low) // each, at
    start_at + (r - low) % each * length."""
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[int, tuple]]] = {}  # gap -> (sequences, chain of (length, each))

    def close(count: int, chain: tuple, gap: int) -> None:
        if count:
            gaps.setdefault(gap, []).append((count, chain))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((n for n in large if n <= a and a + n <= capacity and left[n] > (n == a)), None)
            if b is None:
                close(left[a], ((a, 1),), capacity - a)
                left[a] = 0
            elif b == a:
                close(left[a] // 2, ((a, 2),), capacity - 2 * a)
                left[a] %= 2
            else:
                pairs = min(left[a], left[b])
                close(pairs, ((a, 1), (b, 1)), capacity - a - b)
                left[a] -= pairs
                left[b] -= pairs
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[s]
        while c:
            gap = min((g for g in gaps if g >= s), default=None)
            count, chain = gaps[gap].pop() if gap is not None else (c, ())
            room = gap if gap is not None else capacity
            if gap is not None and not gaps[gap]:
                del gaps[gap]
            each = min(room // s, c)
            used = min(count, c // each)
            close(used, (*chain, (s, each)), room - each * s)
            if gap is not None:
                close(count - used, chain, room)
            c -= used * each
    plan, base, rank = [], 0, dict.fromkeys(counts, 0)
    for gap in sorted(gaps):
        for count, chain in gaps[gap]:
            at = 0
            for n, each in chain:
                plan.append((n, rank[n], rank[n] + count * each, each, base, at))
                rank[n] += count * each
                at += n * each
            base += count
    return plan


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None, end_id: int = 0, special: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; a null text is empty.  With
    ``special`` a special token's string is its id, else ordinary text.  Only documents
    longer than ``capacity`` are cut.  Rows that repeat a doc_id are documents of
    their own.  An empty table gives no rows; other columns are not read.

    Scale: texts are tokenized where they are read.  Piece rows (40 bytes) are
    written once, ranked by hash buckets and joined with the plan, which has a
    few rows per length and is broadcast: its size depends on the capacity only.
    """
    pieces = materialize(token_pieces(docs, capacity, ranks, end_id, special))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    plan = docs.sparkSession.createDataFrame(pack_counts(counts, capacity), PLAN)
    ranked = number_rows(pieces, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "rank", sum(counts.values()))
    packed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    i = F.col("rank") - F.col("low")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("base") + F.floor(i / F.col("each"))).cast("long").alias("sequence_id"),
                         (F.col("start_at") + i % F.col("each") * F.col("length")).cast("long").alias("offset"))
