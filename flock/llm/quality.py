"""Operator 7, quality classifier: supervised subword embeddings.

Words and character 3- and 4-grams (within a word and its blanks) are hashed to
rows of an embedding table; a document is the average of its rows; a softmax
layer gives the two classes.  Both are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows.

The softmax of an average of rows only needs, for two classes, one number per
row (its product with the difference of the class vectors), so scoring carries
a table of BUCKETS floats whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import U, mix

BUCKET_BITS, DIM, EPOCHS, BATCH, RATE, SEED = 16, 16, 6, 32, 0.5, 17
#: Labelled rows of each class that may be fitted on, about (a documented bound).
SAMPLE_PER_CLASS = 1500
SLICE_CHARS = 100_000
_BLANK = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and n-gram of whole texts; letter case counts."""
    lengths = np.array([len(t) + 2 for t in texts], np.int64)  # a blank before and after
    chars = np.frombuffer(("".join(f" {t} " for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    full = ~np.isin(chars, _BLANK)
    h = mix(np.where(full, chars, 32).astype(U), 3)
    rows, keys = [], []
    for n in (3, 4):
        if len(chars) >= n:
            end = len(chars) - n + 1
            ok = owner[:end] == owner[n - 1:]
            key = h[:end].copy()
            for j in range(1, n):
                key = key * U(0x9E3779B97F4A7C15) + h[j:end + j]
                if j < n - 1:
                    ok &= full[j:end + j]
            at = np.flatnonzero(ok)
            rows.append(owner[at])
            keys.append(mix(key[at], n))
    before = np.zeros(len(chars), bool)
    before[1:] = full[:-1]
    starts, ends = np.flatnonzero(full & ~before), np.flatnonzero(before & ~full)
    up = np.cumprod(np.full(len(chars) + 1, 0x9E3779B97F4A7C15, U))
    down = np.cumprod(np.full(len(chars) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), U))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(h * up[:-1])])
    rows.append(owner[starts])
    keys.append(mix((sums[ends] - sums[starts]) * down[starts], 1))
    row, key = np.concatenate(rows), np.concatenate(keys)
    return row, (key >> U(64 - BUCKET_BITS)).astype(np.int64)


def learnable(doc_id: Column) -> Column:
    """Whether labels of this document may be learned from (the rest is held out)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, label) of about ``per_class`` labelled learnable rows of each class, or
    all of them.  Rows come by a hash of the id, alike in every run."""
    good = labels.where(F.col("quality").isin(0, 1) & learnable(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in good.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = lambda c: min(1.0, per_class / max(1, total.get(c, 0)))
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1_000_000)) / 1e6
    few = good.where(u < F.when(F.col("label") == 0, share(0)).otherwise(share(1)))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most about 2 * per_class rows


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, label in zip(*[c.to_pylist() for c in batch.columns]):
            bucket, count = np.unique(features([text or ""])[1], return_counts=True)
            yield pa.record_batch([pa.array([str(doc)]), pa.array([label], pa.int32()), pa.array([bucket.tolist()], pa.list_(pa.int32())),
                                   pa.array([count.tolist()], pa.list_(pa.int32()))], ["doc_id", "label", "bucket", "count"])


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Train on (label, buckets, counts); the score table and its offset.  Classes weigh alike."""
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    labels = np.array([b[0] for b in bags], np.int64)
    weight = len(bags) / (2.0 * np.maximum(1, np.bincount(labels, minlength=2))) if len(bags) else np.ones(2)
    bags = [(y, b, (c / max(1, c.sum())).astype(np.float32)) for y, b, c in bags]
    steps = EPOCHS * -(-len(bags) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            part = [bags[i] for i in order[lo:lo + BATCH]]
            sizes = np.array([len(b) for _, b, _ in part])
            idx, share = np.concatenate([b for _, b, _ in part]), np.concatenate([s for _, _, s in part])
            doc = np.repeat(np.arange(len(part)), sizes)
            vec = np.zeros((len(part), DIM), np.float32)
            np.add.at(vec, doc, emb[idx] * share[:, None])
            z = vec @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            y = np.array([x[0] for x in part])
            p[np.arange(len(part)), y] -= 1
            p *= weight[y][:, None].astype(np.float32)
            back = p @ out.T
            out -= rate * vec.T @ p
            bias -= rate * p.mean(axis=0)
            # an average spreads its gradient thin: each row moves by its share of the document
            np.subtract.at(emb, idx, rate * len(labels) ** 0.5 * share[:, None] * back[doc])
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _score_rows(table: np.ndarray, offset: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            scores, a = np.empty(len(column)), 0
            while a < len(column):  # texts leave Arrow a slice at a time
                texts, n = [], 0
                for value in column[a:]:
                    text = value.as_py() or ""
                    if texts and n + len(text) > SLICE_CHARS:
                        break
                    texts.append(text)
                    n += len(text)
                b = a + len(texts)
                row, bucket = features(texts)
                total, count = np.bincount(row, table[bucket], b - a), np.bincount(row, minlength=b - a)
                scores[a:b] = 1 / (1 + np.exp(-np.clip(total / np.maximum(1, count) + offset, -500, 500)))
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "_score"])
    return run


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """The model: a table of BUCKETS floats and an offset.  Bags of at most about
    2 * ``per_class`` labelled rows come to the driver.  Without a label of both
    classes every score is 0.5."""
    rows = labelled_sample(docs, labels, per_class).mapInArrow(_bag_rows, "doc_id string, label int, bucket array<int>, count array<int>").toArrow()
    bags = sorted(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), range(rows.num_rows)))
    buckets, counts = rows["bucket"].combine_chunks(), rows["count"].combine_chunks()
    if len({b[1] for b in bags}) < 2:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    return fit([(y, buckets[i].values.to_numpy().astype(np.int64), counts[i].values.to_numpy()) for _, y, i in bags if len(buckets[i].values)])


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``_score`` (0 to 1).  Nulls and texts without a feature score by the offset alone."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score_rows(*model), f"{schema}, _score double")


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Scores read the whole text and nothing else.  Labels that are null or not 0
    or 1 are left out; several labels of one document all count.  Rows whose
    crc32(doc_id) leaves 1 by 3 are held out: never learned from.  A null id is
    not held out and has no label.  One pass over the texts, no shuffle.
    """
    scored = score_quality(docs.select("doc_id", "text"), train_quality(docs, labels, per_class))
    return scored.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= 0.5).cast("int").alias("predicted"))
