"""Operator 10, n-gram Jaccard join: exact links between sets of word shingles.

Sets are dealt to size bands, and each band's universe of shingles is cut into
tiles small enough that two linked sets must agree on some of them.  Sets that
meet in a tile are compared: sizes, then the bit counts of hashed bitmap
signatures, which bound the overlap from above, then the exact intersection of
the sorted arrays.

Why no link is lost.  Sets of sizes a <= b link only if b <= a / t, and then
differ in at most k = (a + b) * (1 - t) / (1 + t) shingles.  A band cuts the
universe into m > k parts by hash; linked sets agree on at least m - k parts
(content and all, empty parts included).  With the parts of each set in one
global order, the first k + 1 of both must therefore share one.  The order puts
parts with many shingles first, so common phrases and empty parts make few
tiles.  A set joins its own band and, if it is small for it, the band below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release
from ._graph import components
from ._util import hint_if_small
from ._words import U, _ranges, mix, parity_bitmaps, set_keys, shingle_sets, text_slices

#: Bits of a signature, at least (it has one for each member of a larger set).
SIGNATURE_BITS = 1024
#: Bytes of sets that one comparing task holds.
CHUNK_BYTES = 8 << 20
#: Sets of a cluster up to which it is compared together with others, by members and by signatures, and members that are
#: intersected at once.
FEW, FEW_MARKS, MEMBERS = 32, 128, 1 << 20
#: Sets of a cluster beyond which the sets of each tile are compared, not all of the cluster.
SPREAD = 4096


def bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Rows (smallest size, first size above, k, parts) of the size bands for a threshold in percent."""
    out, low = [], 1
    while low < most:
        high = max(low + 1, -(-low * max(150, -(-10000 // percent)) // 100))  # linked sets are one band apart at most
        a = high - 1
        k = (a + a * 100 // percent) * (100 - percent) // (100 + percent)
        out.append((low, high, k, 0 if k == 0 else k + 1 + max(2, (k + 3) // 4)))
        low = high
    return np.array(out, np.int64)


def tile_keys(sets: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, tile) for every tile of every set (``sets`` from ``at[i]`` to ``at[i+1]``, sorted)."""
    table = bands(percent)
    n = np.diff(at)
    own = np.searchsorted(table[:, 0], n, "right") - 1
    rows_out, tiles_out = [], []
    for below in (0, 1):
        band = own - below
        ok = (n > 0) & (band >= 0)
        band = np.maximum(band, 0)
        ok &= table[band, 2] > 0
        if below:
            ok &= n <= (table[band, 1] - 1) * 100 // percent
        rows = np.flatnonzero(ok)
        if not len(rows):
            continue
        size, parts, first_n = n[rows], table[band[rows], 3], table[band[rows], 2] + 1
        members = sets[_ranges(at[rows], size)]
        base = np.concatenate([[0], np.cumsum(parts)])
        # parts are ranges of the hash, so the sorted members come part by part
        part = ((members >> U(32)) * np.repeat(parts, size).astype(U) >> U(32)).astype(np.int64)
        cell = np.repeat(base[:-1], size) + part
        count = np.bincount(cell, minlength=int(base[-1]))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(members, 41))])
        ends = np.cumsum(count)
        content = sums[ends] - sums[ends - count]
        owner = np.repeat(np.arange(len(rows)), parts)
        number = _ranges(np.zeros(len(rows), np.int64), parts)
        tile = mix(mix(content + count.astype(U), 42) + (number + band[rows][owner] * (1 << 40)).astype(U), 43)
        # one key of the row, the shingles and half the tile; a tile's number is part of it, so the rest is the same for any set
        key = np.minimum(count, (1 << 12) - 1)
        order = np.argsort((owner << 44 | ((1 << 12) - 1 - key) << 32).astype(U) | tile >> U(32), kind="stable")
        rank = _ranges(np.zeros(len(rows), np.int64), parts)
        keep = order[rank < np.repeat(first_n, parts)]
        rows_out.append(rows[owner[keep]])
        tiles_out.append(tile[keep])
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(rows_out), np.concatenate(tiles_out)


def _key_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, data, offsets in text_slices(batch.column(1)):
                sets, at = shingle_sets(data, offsets, width)
                k1, k2 = set_keys(sets, at)
                yield pa.record_batch([batch.column(0).slice(a, len(at) - 1), batch.column(2).slice(a, len(at) - 1), pa.array(np.diff(at)),
                                       pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], ["doc_id", "row", "n", "k1", "k2"])
    return run


def _tile_rows(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies in one task make their tiles once
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                sets, at = shingle_sets(data, offsets, width)
                k1, k2 = set_keys(sets, at)
                new = np.zeros(len(k1), bool)
                for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if key not in seen:
                        new[i] = True
                        seen.add(key)
                if len(seen) > 200_000:
                    seen.clear()
                n = np.where(new, np.diff(at), 0)
                members = sets[_ranges(at[:-1], n)]
                rows, tiles = tile_keys(members, np.concatenate([[0], np.cumsum(n)]), percent)
                if len(rows):
                    yield pa.record_batch([pa.array(tiles.view(np.int64)), pa.array(k1.view(np.int64)[rows])], ["tile", "k1"])
    return run


ARRAYS = "k1 long, k2 long, n long, marks binary, members binary"


def array_batch(sets: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Keys, sizes, signatures and sorted arrays of sets, as rows of ARRAYS."""
    k1, k2 = set_keys(sets, at)
    marks = parity_bitmaps(sets, at, SIGNATURE_BITS)

    def binary(words: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, 8 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(words))])
    return pa.record_batch([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(at)),
                            binary(np.concatenate([np.zeros(0, U), *marks]), np.cumsum([len(m) for m in marks], dtype=np.int64)),
                            binary(sets[at[0]:at[-1]], at[1:] - at[0])],
                           ["k1", "k2", "n", "marks", "members"])


def _array_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                yield array_batch(*shingle_sets(data, offsets, width))
    return run


def link_pairs(sizes: np.ndarray, marks: list[np.ndarray], members: list[np.ndarray] | None, side: np.ndarray | None,
               percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets among themselves or, with ``side`` given, those of
    side 0 with those of side 1, as index pairs.  Pairs already connected by links
    found before are not tested again; every other pair is.  Without ``members`` a
    pair counts if its signatures do not rule a link out."""
    root, links = np.arange(len(sizes)), []
    order = np.argsort(sizes, kind="stable")
    ranked, words = sizes[order], np.array([len(m) for m in marks])
    # signatures by length, with those of twice the length folded to it
    alike, at = {}, {}
    for w in np.unique(words).tolist():
        some = np.flatnonzero((words == w) | (words == 2 * w))
        alike[w] = np.stack([marks[j] if words[j] == w else marks[j][:w] ^ marks[j][w:] for j in some])
        at[w] = np.full(len(sizes), -1)
        at[w][some] = np.arange(len(some))
    for i, x in enumerate(order):
        last = np.searchsorted(ranked, sizes[x] * 100 // percent, "right")
        others = order[i + 1:last]
        if side is not None:
            others = others[side[others] != side[x]]
        others = others[root[others] != root[x]]
        if not len(others):
            continue
        total = sizes[x] + sizes[others]
        w = int(words[x])  # the others are no smaller, and less than twice as large
        mine, place = alike[w], at[w]
        differ = np.bitwise_count(mine[place[others]] ^ mine[place[x]]).sum(axis=1, dtype=np.int64)
        overlap_most = (total - differ) // 2
        others = others[100 * overlap_most >= percent * (total - overlap_most)]
        for y in others.tolist():
            if root[y] == root[x]:
                continue
            if members is not None:
                both = len(np.intersect1d(members[x], members[y], assume_unique=True))
                if 100 * both < percent * (sizes[x] + sizes[y] - both):
                    continue
            links.append((int(x), y))
            root[root == root[y]] = root[x]
    return links


def _pairs_of(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside each run of ``counts`` rows from ``starts``."""
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in np.unique(counts[counts > 1]).tolist():
        i, j = np.triu_indices(c, 1)
        from_row = starts[counts == c][:, None]
        x.append((from_row + i).ravel())
        y.append((from_row + j).ravel())
    return np.concatenate(x), np.concatenate(y)


def _shared(members: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Members that the sets x[i] and y[i] have in common, for each i."""
    ids = np.unique(members, return_inverse=True)[1].astype(U)
    n, out = np.diff(at), np.zeros(len(x), np.int64)
    block = np.cumsum(n[x] + n[y]) // MEMBERS
    for pick in np.split(np.arange(len(x)), np.flatnonzero(np.diff(block)) + 1):
        pair = np.arange(len(pick), dtype=U) << U(32)
        both = np.sort(np.concatenate([np.repeat(pair, n[rows]) + ids[_ranges(at[rows], n[rows])] for rows in (x[pick], y[pick])]))
        out[pick] = np.bincount((both[1:][both[1:] == both[:-1]] >> U(32)).astype(np.int64), minlength=len(pick))
    return out


def few_links(starts: np.ndarray, counts: np.ndarray, sizes: np.ndarray, marks: np.ndarray, members: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``link_pairs`` connects in each of many small clusters, runs of ``counts`` rows from ``starts``: pairs
    of a row and the first one connected with it.  ``marks``: a row of equally many words for each set;
    ``members``: all sets end to end."""
    x, y = _pairs_of(starts, counts)
    near = np.maximum(sizes[x], sizes[y]) <= np.minimum(sizes[x], sizes[y]) * 100 // percent
    x, y = x[near], y[near]
    differ = np.zeros(len(x), np.int64)
    for w in range(marks.shape[1]):
        differ += np.bitwise_count(marks[x, w] ^ marks[y, w])
    total = sizes[x] + sizes[y]
    most = (total - differ) // 2
    may = 100 * most >= percent * (total - most)
    x, y, total = x[may], y[may], total[may]
    if members is not None and len(x):
        both = _shared(members, np.concatenate([[0], np.cumsum(sizes)]), x, y)
        linked = 100 * both >= percent * (total - both)
        x, y = x[linked], y[linked]
    first = _first(x, y, len(sizes))
    rows = np.flatnonzero(first != np.arange(len(first)))
    return first[rows], rows


def _first(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers below ``n`` that the links x[i], y[i] connect with each."""
    first = np.arange(n)
    while (first[x] != first[y]).any():
        low = np.minimum(first[x], first[y])
        np.minimum.at(first, first[x], low)
        np.minimum.at(first, first[y], low)
        first = first[first]
    while (first != first[first]).any():
        first = first[first]
    return first


def stars(x: np.ndarray, y: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row of the smallest key, row) that connect the rows that x[i], y[i] connect."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    order = np.lexsort((k2[nodes], k1[nodes]))
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    first = _first(rank[ends[:len(x)]], rank[ends[len(x):]], len(nodes))
    rows = np.flatnonzero(first != np.arange(len(first)))
    return nodes[order[first[rows]]], nodes[order[rows]]


DEALT = ["cluster", "band", "chunk", "band2", "chunk2"]


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of a binary column, end to end, as 64-bit words."""
    whole = pa.concat_arrays(column.chunks).cast(pa.large_binary())
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]].copy().view(U)


def _compare(percent: int, exact: bool):
    """Links of whole clusters, rows sorted by DEALT.  A task holds a batch and a cluster's rows at most."""
    def one(table: pa.Table) -> list[tuple[int, int]]:
        _, band, chunk, band2, chunk2 = (table.column(c)[0].as_py() for c in DEALT)
        side = None if (band, chunk) == (band2, chunk2) else table.column("side").to_numpy()
        if side is not None and not 0 < side.sum() < len(side):
            return []
        marks = [np.frombuffer(x, U) for x in table.column("marks").to_pylist()]
        members = [np.frombuffer(x, U) for x in table.column("members").to_pylist()] if exact else None
        return link_pairs(table.column("n").to_numpy(), marks, members, side, percent)

    def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        keys = [table.column(c).to_numpy() for c in DEALT]
        new = np.ones(len(table), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(table)))
        long = pc.binary_length(table.column("marks")).to_numpy() != SIGNATURE_BITS // 8
        apart = (keys[1] != keys[3]) | (keys[2] != keys[4])
        few = (counts <= (FEW if exact else FEW_MARKS)) & ~np.logical_or.reduceat(long | apart, starts)
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rows = _ranges(starts[few & (counts > 1)], counts[few & (counts > 1)])
        if len(rows):
            some, n = table.take(pa.array(rows)), counts[few & (counts > 1)]
            i, j = few_links(np.cumsum(n) - n, n, some.column("n").to_numpy(), _flat(some.column("marks")).reshape(len(rows), -1),
                             _flat(some.column("members")) if exact else None, percent)
            x.append(rows[i])
            y.append(rows[j])
        for a, c in zip(starts[~few].tolist(), counts[~few].tolist()):
            pairs = np.array(one(table.slice(a, c)), np.int64).reshape(-1, 2)
            x.append(a + pairs[:, 0])
            y.append(a + pairs[:, 1])
        k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
        x, y = stars(np.concatenate(x), np.concatenate(y), k1, k2)
        yield pa.record_batch([pa.array(v) for v in (k1[x], k2[x], k1[y], k2[y])], ["a1", "a2", "b1", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in DEALT]
            other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last cluster may go on in the next batch
            if pending and (cut or any(pending[-1].column(c)[-1].as_py() != k[0] for c, k in zip(DEALT, keys))):
                yield from work([*pending, batch.slice(0, cut)])
                pending = []
            elif cut:
                yield from work([batch.slice(0, cut)])
            pending.append(batch.slice(cut))
        if pending:
            yield from work(pending)
    return run


def size_bands(percent: int, most: int = 1 << 40) -> list[int]:
    """Lowest sizes of bands of which linked sets lie in the same or in neighbours."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def _size_banded(one: DataFrame, large: DataFrame, percent: int) -> tuple[DataFrame, Column]:
    """The sets with their band and chunk, and the tasks each of them goes to."""
    limit = F.lit(CHUNK_BYTES // 2)
    one = one.join(hint_if_small(large, 24), "cluster", "left")
    lows = F.array(*[F.lit(x) for x in size_bands(percent)])
    one = one.withColumn("band", F.when(F.col("large"), F.size(F.filter(lows, lambda x: x <= F.col("n")))).otherwise(0))
    chunks = materialize(one.where("large").groupBy("cluster", "band").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("chunks")))

    def with_chunks(df: DataFrame, step: int, name: str) -> DataFrame:
        c = chunks.select("cluster", (F.col("band") - step).alias("band"), F.col("chunks").alias(name))
        return df.join(hint_if_small(c, 40), ["cluster", "band"], "left")
    one = with_chunks(with_chunks(with_chunks(one, 0, "here"), 1, "above"), -1, "below")
    one = one.withColumn("here", F.coalesce("here", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("k1", "k2"), F.col("here")).cast("int"))
    band, chunk = F.col("band"), F.col("chunk")

    def meet(n: str, make) -> Column:
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)).otherwise(
            F.array().cast("array<struct<band:int,chunk:int,band2:int,chunk2:int,side:int>>"))

    def task(b, c, b2, c2, side) -> Column:
        return F.struct(b.alias("band"), c.alias("chunk"), b2.alias("band2"), c2.alias("chunk2"), side.cast("int").alias("side"))
    met = F.concat(meet("here", lambda c: task(band, F.least(chunk, c), band, F.greatest(chunk, c), chunk > c)),
                   meet("above", lambda c: task(band, chunk, band + 1, c, F.lit(0))),
                   meet("below", lambda c: task(band - 1, c, band, chunk, F.lit(1))))
    return one, met


def compared(sets: DataFrame, weight: Column, percent: int, exact: bool) -> DataFrame:
    """(node, component) of the sets that a comparison inside ``cluster`` connects.

    A cluster of at most CHUNK_BYTES / 2 (by ``weight``) is one task.  A larger one is
    cut by size band, and its bands into chunks of that weight; a chunk meets
    itself, the other chunks of its band and those of the bands beside it.  So a
    task holds two chunks at most, whatever the cluster.
    """
    one = sets.withColumn("weight", weight)
    limit = F.lit(CHUNK_BYTES // 2)
    large = materialize(one.groupBy("cluster").agg(F.sum("weight").alias("w")).where(F.col("w") > limit).select("cluster", F.lit(True).alias("large")))
    if large.isEmpty():
        nil = F.lit(0)
        met = F.array(F.struct(*[nil.alias(c) for c in ("band", "chunk", "band2", "chunk2", "side")]))
    else:
        one, met = _size_banded(one, large, percent)
    values = ["k1", "k2", "n", "marks", *(["members"] if exact else [])]
    dealt = one.select("cluster", *values, F.explode(met).alias("met")).select("cluster", "met.*", *values)
    # dealt by the whole key, else the tasks of a cluster would follow one another in one
    links = dealt.repartition(*DEALT).sortWithinPartitions(*DEALT).mapInArrow(_compare(percent, exact), "a1 long, a2 long, b1 long, b2 long")
    key = lambda x, y: F.struct(F.col(x).alias("k1"), F.col(y).alias("k2"))
    return components(materialize(links).select(key("a1", "a2").alias("a"), key("b1", "b2").alias("b")))


def _tiles_of(tiles_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = _flat(pa.chunked_array([batch.column(2)]))
                n = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) // 8
                rows, tiles = tiles_of(sets, np.concatenate([[0], np.cumsum(n)]))
                rows = pa.array(rows)
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(tiles.view(np.int64))], ["k1", "k2", "tile"])
    return run


def _by_tile(arrays: DataFrame, tiles_of) -> DataFrame:
    """The sets without their members, those of clusters of more than SPREAD sets once for each tile that another
    one has too, with the tile for their cluster.  Chance meetings make such a cluster: it grows faster
    than the table and the pairs in it with its square, but a set shares its tiles with few others."""
    sizes = arrays.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > SPREAD)
    large = hint_if_small(materialize(sizes.select("cluster")), 16)
    if large.isEmpty():
        return arrays.drop("members")
    spread = arrays.join(large, "cluster", "left_semi")
    tiles = materialize(spread.select("k1", "k2", "members").mapInArrow(_tiles_of(tiles_of), "k1 long, k2 long, tile long"))
    again = materialize(tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("tile"))
    dealt = materialize(tiles.join(hint_if_small(again, 16), "tile").select("k1", "k2", F.col("tile").alias("cluster")))
    release(tiles, again)
    met = spread.drop("members", "cluster").join(hint_if_small(dealt, 40), ["k1", "k2"])
    return arrays.drop("members").join(large, "cluster", "left_anti").unionByName(met)


def resolve(met: DataFrame, arrays_of, percent: int, tiles_of=None) -> DataFrame:
    """(k1, k2, component) of the sets that link with another one.

    ``met`` holds pairs (a, b) of first keys: every pair that may link is
    connected through it.  Half a key is enough here, since sets that share it
    all join the comparison.  Connected sets form a cluster.  The signatures split
    clusters first: a link's two sets pass the bound, so what passing pairs connect
    holds every link.  Then the arrays of each such part are intersected.
    ``arrays_of(keys)`` gives rows of ARRAYS for a table of first keys.

    With ``tiles_of`` (sets and offsets -> row and tile, like ``tile_keys``; what ``met`` was made of), sets of
    large clusters are told apart by signature only where they share a tile, not through others.
    """
    clusters = materialize(components(met).select(F.col("node").alias("k1"), F.col("component").alias("cluster")))
    arrays = materialize(arrays_of(clusters.select("k1")).join(hint_if_small(clusters, 24), "k1"))
    marks = arrays.drop("members") if tiles_of is None else _by_tile(arrays, tiles_of)
    passing = compared(marks, F.length("marks") + 50, percent, False)
    passing = passing.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), F.xxhash64("component").alias("cluster"))
    arrays = arrays.drop("cluster").join(hint_if_small(passing, 40), ["k1", "k2"])
    found = compared(arrays, F.length("members") + F.length("marks") + 50, percent, True)
    return found.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "component")


def tile_meetings(tiles: DataFrame) -> DataFrame:
    """Distinct (a, b): the smallest key of a tile with each other key in it, so a
    tile of c sets gives c - 1 rows."""
    low = tiles.select("tile", F.col("k1").alias("b"), F.min("k1").over(Window.partitionBy("tile")).alias("a"))
    return low.where("a <> b").select("a", "b").distinct()


def jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their
    distinct ``width``-word shingles (A-Z lower-cased; fewer words: the whole
    sequence is the one shingle).  component_id is the smallest doc_id reachable
    by links.  A text without words, or null, has no shingles and links with
    nothing.  Documents with equal sets are one node, so copies cost a row each
    and no pair.  Rows that share a doc_id are rows of their own; a null id
    never is a component id while another one is there.  Other columns of
    ``docs`` are not read.

    Scale: texts are read three times and never shuffled (unless the list of
    documents that meet another one is too large to broadcast; then they are
    joined).  The tile table, about 0.17 rows a word at 90 %, is the one large
    shuffle.  Arrays exist only for sets that meet another one.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100")
    # a row is told by its id and text: ids may be null or repeat
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    id_type = d.schema["doc_id"].dataType.simpleString()
    nodes = materialize(d.mapInArrow(_key_rows(width), f"doc_id {id_type}, row long, n long, k1 long, k2 long"))
    tiles = d.select("text").mapInArrow(_tile_rows(width, percent), "tile long, k1 long")
    met = materialize(tile_meetings(tiles))

    def arrays_of(keys: DataFrame) -> DataFrame:
        one = nodes.where("n > 0").join(keys, "k1").groupBy("k1", "k2").agg(F.min("row").alias("row"))
        rows = materialize(one.select("row").distinct())
        texts = d.join(hint_if_small(rows, 24), "row").select("text")
        found = texts.mapInArrow(_array_rows(width), ARRAYS)
        return found.join(keys, "k1", "left_semi").dropDuplicates(["k1", "k2"])

    linked = materialize(resolve(met, arrays_of, percent))
    # the smallest id of each linked set's component, and of each other set
    sets = nodes.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low"))
    known = materialize(sets.join(linked, ["k1", "k2"], "left").withColumn(
        "component", F.coalesce("component", F.struct("k1", "k2"))))
    low = known.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = known.join(low, "component").select("k1", "k2", "component_id")
    return nodes.join(ids, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
