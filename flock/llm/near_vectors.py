"""Operator 12, embedding near-dedup by an epsilon grid order join.

A cosine of ``t`` or more between two vectors is a distance of at most
``eps = sqrt(2 - 2 t)`` between their unit vectors.  Unit vectors are projected
on a few leading principal dimensions, put in grid cells of side ``eps`` and
sorted by label, length and cells (epsilon grid order); the sequence is cut
into blocks.  Intervals of the sequence are joined recursively, from the whole
sequence down to blocks: a pair of intervals whose bounding boxes lie further
than ``eps`` apart, or whose labels do not meet, is skipped with all below it.
Pairs of blocks that are left compare their whole vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import intermediates, materialize
from ._graph import components
from ._util import hint_if_small, in_order

#: Leading principal dimensions of the grid.
AXES = 8
#: Values of the vectors that the axes are fitted on (any axes give the same links, poor ones more work).
FIT_VALUES = 1 << 20
#: Vectors of a block; children of an interval, and blocks that meet one block in a call.
BLOCK, FAN_BITS = 512, 3
FAN = 1 << FAN_BITS
#: Cosines this close to the threshold are decided by exactly rounded sums, the same in any block.
DOUBT = 1e-9


def usable(v: Column) -> Column:
    """Whether a vector can have a cosine: not null or empty, all finite, not all zero."""
    v = F.coalesce(v, F.array().cast("array<double>"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return finite & F.exists(v, lambda x: x != 0)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; scaled by a power of two first, which loses nothing and avoids overflow."""
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def principal_axes(vectors: DataFrame, axes: int = AXES, fit_values: int = FIT_VALUES) -> np.ndarray:
    """Orthonormal leading principal directions, fitted on at most ``fit_values`` values: whole vectors with
    the smallest hashes, of the commonest length among them."""
    widest = vectors.agg(F.max(F.size("v"))).first()[0]
    if widest is None:
        return np.zeros((0, 0))
    rows = max(2, fit_values // widest)
    picked = [r.v for r in vectors.orderBy(F.xxhash64("v"), "rid").limit(rows).select("v").collect()]
    lengths = [len(v) for v in picked]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    m = _unit(np.array([v for v in picked if len(v) == width], dtype=np.float64))
    m = m - m.mean(axis=0)
    return np.linalg.eigh(m.T @ m)[1][:, ::-1][:, :axes]


def _projected(vectors: DataFrame, basis: np.ndarray, axes: int) -> DataFrame:
    """``vectors`` with p: coordinates on the axes and the norm of what they leave of the unit vector.
    Vectors of another length than the axes' keep their leading coordinates instead."""

    def project(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            lengths = np.diff(column.offsets.to_numpy())
            flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            out = np.zeros((len(lengths), axes + 1))
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                u = _unit(flat[starts[at][:, None] + np.arange(n)].astype(np.float64))
                b = basis if len(basis) == n else np.eye(n)[:, :axes]
                out[at, :b.shape[1]] = u @ b
                out[at, axes] = np.sqrt(np.maximum(0, 1 - (out[at, :axes] ** 2).sum(axis=1)))
            p = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, axes + 1), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, p], names=[*batch.schema.names, "p"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(project, f"{fields}, p array<double>")


def _boxes(blocks: DataFrame, level: int, axes: int) -> DataFrame:
    """Bounds of the intervals of FAN**level blocks: first and last label, lowest and highest coordinates."""
    low, high = F.array(*[F.min(F.col("low")[i]) for i in range(axes)]), F.array(*[F.max(F.col("high")[i]) for i in range(axes)])
    return blocks.groupBy(F.shiftright("block", FAN_BITS * level).alias("i")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), low.alias("low"), high.alias("high"))


def _gap(axes: int) -> Column:
    """Squared distance of two boxes (al, ah) and (bl, bh)."""
    out = F.lit(0.0)
    for i in range(axes):
        g = F.greatest(F.lit(0.0), F.col("al")[i] - F.col("bh")[i], F.col("bl")[i] - F.col("ah")[i])
        out = out + g * g
    return out


def interval_join(blocks: DataFrame, axes: int, eps: float) -> DataFrame:
    """(a, b), a <= b: blocks that may hold vectors within ``eps`` of each other.

    ``blocks``: block (0, 1 ...), first, last (labels), low, high.  Starts with the whole sequence and itself;
    each round cuts intervals into FAN children and drops the pairs whose boxes lie too far apart."""
    n = blocks.count()
    level = 0
    while FAN ** level < n:
        level += 1
    near = (eps + 1e-7) ** 2  # coordinates carry rounding of up to 2e-8
    spark = blocks.sparkSession
    pairs = spark.range(1 if n else 0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for down in range(level - 1, -1, -1):
        boxes = materialize(_boxes(blocks, down, axes))
        known = hint_if_small(boxes, 16 * axes + 128)
        child = F.sequence(F.lit(0).cast("long"), F.lit(FAN - 1).cast("long"))
        pairs = pairs.select(F.explode(F.transform(child, lambda c: F.col("a") * FAN + c)).alias("a"), "b")
        pairs = pairs.select("a", F.explode(F.transform(child, lambda c: F.col("b") * FAN + c)).alias("b")).where("a <= b")
        one = known.select(F.col("i").alias("a"), F.col("last").alias("a_last"), F.col("low").alias("al"), F.col("high").alias("ah"))
        two = known.select(F.col("i").alias("b"), F.col("first").alias("b_first"), F.col("low").alias("bl"), F.col("high").alias("bh"))
        pairs = pairs.join(one, "a").join(two, "b")  # a <= b in the order of labels, so the two bounds tell
        pairs = materialize(pairs.where((F.col("b_first") <= F.col("a_last")) & (_gap(axes) <= near)).select("a", "b"))
    return pairs


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Of two unit-scaled rows by exactly rounded sums."""
    return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y)))


def _links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` link."""
    c = _unit(a) @ _unit(b).T
    out = c >= threshold
    for i, j in np.argwhere(np.abs(c - threshold) < DOUBT):
        x, y = (np.ldexp(m, -np.frexp(np.abs(m).max())[1]) for m in (a[i], b[j]))
        out[i, j] = _cosine(x, y) >= threshold
    return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.tolist()).astype(np.float64)


def _compare(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one block with the blocks dealt to it: for each row with one, the rows it links with here
    (copies counted) and the smallest row that links inside this call reach."""
    found = [pd.DataFrame({"rid": [], "links": [], "least": []})]
    mine = dict(list(left.groupby("space")))
    for space, r in right.groupby("space"):
        if space not in mine:
            continue
        lft = mine[space]
        hit = _links(_matrix(lft["v"]), _matrix(r["v"]), threshold)
        x, y = lft["rid"].to_numpy(), r["rid"].to_numpy()
        hit &= x[:, None] != y[None, :]
        own = (r["block"] == lft["block"].iloc[0]).to_numpy()
        lx, ly = np.minimum(x, np.where(hit, y[None, :], x[:, None]).min(axis=1)), y
        while True:  # smallest label over links until none changes
            new_y = np.minimum(ly, np.where(hit, lx[:, None], ly[None, :]).min(axis=0))
            new_x = np.minimum(lx, np.where(hit, new_y[None, :], lx[:, None]).min(axis=1))
            if (new_x == lx).all() and (new_y == ly).all():
                break
            lx, ly = new_x, new_y
        any_x, any_y = hit.any(axis=1), hit.any(axis=0)
        found.append(pd.DataFrame({"rid": x[any_x], "links": (hit * r["copies"].to_numpy()[None, :]).sum(axis=1)[any_x], "least": lx[any_x]}))
        # a block with itself counted both directions above, but its rows' labels differ by side: both are needed
        back = np.where(own, 0, (hit * lft["copies"].to_numpy()[:, None]).sum(axis=0))
        found.append(pd.DataFrame({"rid": y[any_y], "links": back[any_y], "least": ly[any_y]}))
    return pd.concat(found).astype("int64")


def block_links(sequence: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(rid, links, least) for the pairs of blocks; one call compares a block with at most FAN others."""
    chunk = F.shiftright("b", FAN_BITS).alias("chunk")
    names = ["block", "rid", "space", "copies", "v"]
    left = pairs.select("a", chunk).distinct().join(sequence.select(*names), F.col("a") == F.col("block"))
    again = sequence.select(*[F.col(c).alias(c) for c in names])  # columns of its own: both sides come from one table
    right = pairs.select(F.col("a").alias("a"), F.col("b").alias("b"), chunk).join(again, F.col("b") == F.col("block")).drop("b")

    def compare(lft: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return _compare(lft, r, threshold)

    return left.groupBy("a", "chunk").cogroup(right.groupBy("a", "chunk")).applyInPandas(compare, "rid long, links long, least long")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    * Two vectors link if their labels are equal and not null, their lengths are equal and the cosine of their
      values as doubles is at least ``threshold`` (0 < threshold <= 1).  Cosines within 1e-9 of it are computed
      again by exactly rounded sums, so the answer does not depend on blocks.
    * A vector that is null, empty, all zero, or holds null or non-finite components links with nothing, nor
      does one without a label: no links, its own component.
    * ``n_links`` counts other rows, copies included; ``component_id`` is the smallest id (null: no id at
      all) that links reach; ``kept`` holds where it is the row's own id.  Rows may share an id.
    * An empty table gives an empty result.  Other columns are not read.

    Scale: equal vectors of a label meet in a hash grouping (combined per task) and are one row from there on, so a
    hot vector costs nothing.  The others are dealt by range; the recursion joins tables of boxes, one row per
    block.  Each surviving block is sent once to each chunk of blocks it meets, and links are reduced to one count
    and one least neighbour a row inside a call, never written as pairs.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull())
    # two hashes of 64 bits name a vector; a collision is found below
    name = [F.when(F.col("ok"), F.xxhash64(F.lit(i), F.col("label"), F.col("v"))).alias(f"h{i}") for i in (1, 2)]
    ids = materialize(rows.select("vec_id", *name))
    named = rows.where("ok").select("label", "v", *name)
    one = named.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("label").alias("label"), F.min("v").alias("v"),
                                        (F.min("v") == F.max("v")).alias("same"))
    one = one.withColumn("copies", F.when(F.col("same"), F.col("copies")).otherwise(F.raise_error(F.lit("two vectors share 128 bits of hash")).cast("long")))
    one = materialize(one.select("h1", "h2", "copies", "label", "v", F.monotonically_increasing_id().alias("rid")))
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    basis = principal_axes(one, axes)
    placed = _projected(one.select("rid", "copies", F.to_json(F.struct("label", F.size("v"))).alias("space"), "v"), basis, axes)
    side = max(eps, 1e-3)
    placed = placed.withColumn("cells", F.transform(F.slice("p", 1, axes), lambda x: F.floor(x / side).cast("long")))
    with intermediates() as scope:
        sequence = in_order(placed.withColumn("all", F.lit(0)), "all", ["space", "cells"])
        sequence = sequence.withColumn("block", F.floor(F.col("pos") / block).cast("long"))
        sequence = scope.keep(materialize(sequence.select("block", "rid", "space", "copies", "v", "p")))
    dims = range(axes + 1)
    blocks = materialize(sequence.groupBy("block").agg(
        F.min("space").alias("first"), F.max("space").alias("last"), F.array(*[F.min(F.col("p")[i]) for i in dims]).alias("low"),
        F.array(*[F.max(F.col("p")[i]) for i in dims]).alias("high")))
    pairs = interval_join(blocks, axes + 1, eps)
    found = materialize(block_links(sequence, pairs, threshold))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rid").alias("a"), F.col("least").alias("b")))
    known = one.select("h1", "h2", "copies", "rid").join(links, "rid", "left").join(groups.withColumnRenamed("node", "rid"), "rid", "left")
    known = materialize(known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                     F.coalesce("component", "rid").alias("component")).where("n_links > 0"))
    out = materialize(ids.join(hint_if_small(known, 64), ["h1", "h2"], "left"))
    least = materialize(out.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("component_id")))
    out = out.join(hint_if_small(least, 48), "component", "left")
    mine = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"),
                      F.col("vec_id").eqNullSafe(mine).alias("kept"))
