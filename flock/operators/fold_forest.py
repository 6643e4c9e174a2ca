"""The random forests of all folds of a cross-validation and of the whole table, grown together.

A fit is a forest of shallow class trees (Gini): fit f < folds leaves the rows of fold f out, the last fit takes all.
Tree t of every fit draws the same rows (``forest.weights``) and the same features at a node, so as long as fits split
a node alike they have the same rows there but for their folds: one slot holds the sums of each of their folds and of the
rest, and a fit's sums are the whole less its fold's.  Fits that split a node in other ways go on in slots of their own.
Every forest is the one that growing it alone gives.

A round grows all trees by a level: tasks lead chunks of rows down the slots so far and sum the drawn features of the
open ones in arrays; an exchange brings a tree's arrays together, where the splits are searched.  Only splits, at most
fits x trees x 2^depth rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest as fo
from . import trees as tr

#: Cells that a task holds (16 bytes each) and trees that it grows in one reading.
MAX_CELLS, BLOCK = 1 << 21, 25
#: Rows that are led down the trees together, and rows of a task (fewer tasks exchange fewer arrays).
CHUNK, TASK_ROWS = 1 << 18, 1 << 19
#: A row's weight and, PACK times it, that of the second class are one number while a chunk is summed.
PACK = 1 << 26
_BEST = "tree int, slot int, fit int, feature int, left binary, la double, lb double, ra double, rb double"


@dataclass
class Slot:
    """A node of a tree as some fits have it; ``splits``: (feature, left bins as bits, left slot, right slot)."""

    node: int
    fits: list[int]
    number: int = -1  # of an open one
    splits: list[tuple[int, bytes, "Slot | None", "Slot | None"]] = field(default_factory=list)


@dataclass
class FoldForests:
    """``nodes[fit][tree][node]``: (feature, left bins as bits, share of the second class on the left, on the right);
    ``share``: that of the whole table, the answer of a tree without splits."""

    features: list[tr.Feature]
    settings: fo.Settings
    folds: int
    nodes: list[dict[int, dict[int, tuple[int, bytes, float, float]]]]
    roots: list[list[float]]

    def tables(self, fit: int) -> list[tuple[np.ndarray, ...]]:
        """Of each tree: feature, left bins, children and value of its nodes; a leaf is its own child."""
        width, out = max(tr.widths(self.features)), []
        for t in range(self.settings.trees):
            splits, kids, feature, left, value, at = self.nodes[fit].get(t, {}), [[0, 0]], [0], [0], [self.roots[fit][t]], {1: 0}
            left = [np.zeros(width, bool)]
            for k in sorted(splits):
                f, bits, low, high = splits[k]
                i, n = at[k], len(kids)
                feature[i], left[i], kids[i] = f, np.unpackbits(np.frombuffer(bits, np.uint8), count=width).astype(bool), [n, n + 1]
                at[2 * k], at[2 * k + 1] = n, n + 1
                kids += [[n, n], [n + 1, n + 1]]
                feature += [0, 0]
                left += [np.zeros(width, bool)] * 2
                value += [low, high]
            out.append((np.array(feature), np.array(left), np.array(kids), np.array(value)))
        return out

    def share_of(self, fit: int):
        """For bins (rows x features): the mean share of the second class over the trees."""
        tables, depth = self.tables(fit), self.settings.max_depth

        def run(bins: np.ndarray) -> np.ndarray:
            rows, total = np.arange(len(bins)), np.zeros(len(bins))
            for feature, left, kids, value in tables:
                at = np.zeros(len(bins), np.int64)
                for _ in range(min(depth, len(kids) // 2)):
                    at = kids[at, np.where(left[at, bins[rows, feature[at]]], 0, 1)]
                total += value[at]
            return total / max(1, len(tables))
        return run

    def right_in_folds(self, rows: DataFrame) -> dict[int, tuple[int, int]]:
        """Fold -> its rows, and those of them that its own fit gives their class."""
        p, each = len(self.features), [self.share_of(f) for f in range(self.folds)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros((2, len(each)), np.int64)
            for _, target, fold, bins in _chunks(batches, p):
                for f in np.unique(fold):
                    here = fold == f
                    count[:, f] += here.sum(), ((each[f](bins[here]) > 0.5) == target[here]).sum()
            yield pa.record_batch([pa.array(np.arange(len(each)), pa.int32()), pa.array(count[0]), pa.array(count[1])], names=["fold", "n", "right"])

        sums = rows.select("key", "target", "fold", "bins").mapInArrow(run, "fold int, n long, right long").groupBy("fold")
        return {r.fold: (r.n, r.right) for r in sums.agg(F.sum("n").alias("n"), F.sum("right").alias("right")).collect()}

    def second_class(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with ``out``: whether the fit of the whole table gives a row the second class."""
        p, share = len(self.features), self.share_of(self.folds)
        names = [*df.columns, out]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
                yield pa.record_batch([*batch.columns[:-1], pa.array(share(bins) > 0.5)], names=names)

        binned = fo.with_bins(df, self.features, "_fold_forest_bins")
        return binned.mapInArrow(run, df.withColumn(out, F.lit(True)).schema)


def fit(rows: DataFrame, features: list[tr.Feature], settings: fo.Settings, folds: int) -> FoldForests:
    """The forests of ``rows`` (key, target, fold, bins): a stored result of ``forest.rows_to_draw``, read in every round."""
    rows = rows.select("key", "target", "fold", "bins")
    few = rows.coalesce(max(1, -(-rows.count() // TASK_ROWS)))
    widths, least = tr.widths(features), max(1, settings.node_size)
    text = [f.levels is not None for f in features]
    forests = FoldForests(features, settings, folds, [{} for _ in range(folds + 1)], [[0.0] * settings.trees for _ in range(folds + 1)])
    roots = {t: Slot(1, list(range(folds + 1))) for t in range(settings.trees)}
    open_ = {t: [root] for t, root in roots.items()}
    while open_:
        blocks: list[dict[int, Slot]] = []
        cells = MAX_CELLS
        for t, slots in open_.items():
            mine = 0
            for i, s in enumerate(slots):
                s.number = i
                mine += (len(s.fits) + 1) * sum(widths[f] for f in _drawn(s, len(features), settings, t))
            if cells + mine > MAX_CELLS or len(blocks[-1]) == BLOCK:
                blocks.append({})
                cells = 0
            blocks[-1][t] = roots[t]
            cells += mine
        sums = reduce(DataFrame.unionAll, [few.mapInArrow(_summed(features, settings, folds, block), "tree int, slot int, data binary") for block in blocks])
        asked = {t: [(s.node, s.fits) for s in slots] for t, slots in open_.items()}
        found = sums.groupBy("tree").applyInPandas(_searched(widths, text, settings, folds, asked), _BEST).collect()
        ways: dict[tuple[int, int], dict[tuple[int, bytes], list]] = {}
        for r in found:
            slot = open_[r.tree][r.slot]
            if slot.node == 1:
                forests.roots[r.fit][r.tree] = (r.lb + r.rb) / max(r.la + r.ra, 1.0)
            if r.feature >= 0:
                left = bytes(r.left)
                forests.nodes[r.fit].setdefault(r.tree, {})[slot.node] = (r.feature, left, r.lb / r.la, r.rb / r.ra)
                ways.setdefault((r.tree, r.slot), {}).setdefault((r.feature, left), []).append(r)
        following: dict[int, list[Slot]] = {}
        for (t, i), alike in sorted(ways.items()):
            slot = open_[t][i]
            for (feature, left), them in sorted(alike.items()):
                kids: list[Slot | None] = []
                for node, sums_of in ((2 * slot.node, lambda r: (r.la, r.lb)), (2 * slot.node + 1, lambda r: (r.ra, r.rb))):
                    may = sorted(r.fit for r in them for a, b in [sums_of(r)] if 0 < b < a and a >= 2 * least)
                    kids.append(Slot(node, may) if may and node.bit_length() <= settings.max_depth else None)
                    if kids[-1] is not None:
                        following.setdefault(t, []).append(kids[-1])
                if any(kids):
                    slot.splits.append((feature, left, *kids))
        for slots in open_.values():
            for s in slots:
                s.number = -1
        open_ = following
    return forests


def _drawn(slot: Slot, features: int, settings: fo.Settings, tree: int) -> np.ndarray:
    return fo.drawn_features(np.array([slot.node]), features, settings, tree)[0]


def _chunks(batches: Iterator[pa.RecordBatch], features: int):
    """(key, target, fold, bins) of CHUNK rows or a little more at a time."""
    parts: list[tuple] = []
    held = 0
    for batch in batches:
        if batch.num_rows:
            key, target, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            bins = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, features)
            parts.append((key, target > 0, fold, bins.astype(np.min_scalar_type(int(bins.max(initial=0))))))
            held += batch.num_rows
        if held >= CHUNK:
            yield tuple(np.concatenate(x) for x in zip(*parts))
            parts, held = [], 0
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def _summed(features: list[tr.Feature], settings: fo.Settings, folds: int, block: dict[int, Slot]):
    """For ``mapInArrow`` over (key, target, fold, bins): of each open slot of the trees, weight and weight of the second
    class for (drawn feature, rest or a fit's fold, bin), one array a slot."""
    p, widths = len(features), tr.widths(features)

    def add(slot: Slot, tree: int, at: np.ndarray, columns: list[np.ndarray], fold: np.ndarray, packed: np.ndarray, sums: dict) -> None:
        if slot.number >= 0:
            parts = np.zeros(folds, np.int64)
            mine = [f for f in slot.fits if f < folds]
            parts[mine] = np.arange(1, len(mine) + 1)
            part, w, one = parts[fold[at]], packed[at], []
            for f in _drawn(slot, p, settings, tree):
                one.append(np.bincount(part * widths[f] + columns[f][at], w, (len(mine) + 1) * widths[f]))
            one = np.concatenate(one)
            b = np.floor(one / PACK)
            total = sums.setdefault((tree, slot.number), np.zeros((2, len(one)), np.int64))
            total[0] += (one - b * PACK).astype(np.int64)
            total[1] += b.astype(np.int64)
        for feature, left, low, high in slot.splits:
            goes = np.unpackbits(np.frombuffer(left, np.uint8)).astype(bool)[columns[feature][at]]
            for kid, side in ((low, goes), (high, ~goes)):
                if kid is not None:
                    add(kid, tree, at[side], columns, fold, packed, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for key, target, fold, bins in _chunks(batches, p):
            columns = [np.ascontiguousarray(bins[:, f]) for f in range(p)]
            for t, root in block.items():
                w = fo.weights(key, settings.seed, t)
                add(root, t, np.flatnonzero(w), columns, fold, w * np.where(target, PACK + 1.0, 1.0), sums)
        for (t, number), total in sums.items():
            yield pa.record_batch([pa.array([t], pa.int32()), pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["tree", "slot", "data"])
    return run


def _searched(widths: list[int], text: list[bool], settings: fo.Settings, folds: int, asked: dict[int, list[tuple[int, list[int]]]]):
    """For ``applyInPandas`` over the sums of a tree: the best split of every fit in each of its open slots."""
    least, width = max(1, settings.node_size), max(widths)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tree, sums, out = int(group["tree"].iloc[0]), {}, []
        for number, data in zip(group["slot"], group["data"]):
            one = np.frombuffer(data, np.int64)
            sums[number] = sums[number] + one if number in sums else one
        for number, one in sums.items():
            node, fits = asked[tree][number]
            n = sum(f < folds for f in fits)
            cells, begin = one.reshape(2, -1), 0
            blocks = []
            for f in fo.drawn_features(np.array([node]), len(widths), settings, tree)[0].tolist():
                h = cells[:, begin:begin + (n + 1) * widths[f]].reshape(2, n + 1, widths[f]).astype(float)
                begin += (n + 1) * widths[f]
                whole = h.sum(axis=1, keepdims=True)
                blocks.append((f, np.concatenate([whole - h[:, 1:], whole], axis=1)[:, :len(fits)]))  # the whole table's fit is the last
            out += [(tree, number, fit, *best) for fit, best in zip(fits, best_splits(blocks, text, least, width))]
        return pd.DataFrame(out, columns=["tree", "slot", "fit", "feature", "left", "la", "lb", "ra", "rb"])
    return run


def best_splits(blocks: list[tuple[int, np.ndarray]], text: list[bool], least: float, width: int) -> list[tuple]:
    """(feature or -1, left bins as bits, sums on the left and on the right) for each fit, from (feature, sums (2, fits, bins)).
    Bins of a text feature are tried in the order of their share of the second class.  Ties: first feature, first cut."""
    fits = np.arange(blocks[0][1].shape[1])
    a, b = blocks[0][1].sum(axis=2)
    base = tr.gini_worth(a, b)
    gain, best = np.full(len(fits), 1e-9), [(-1, b"", 0.0, 0.0, float(x), float(y)) for x, y in zip(a, b)]
    for f, h in blocks:
        bins = np.broadcast_to(np.arange(h.shape[2]), h.shape[1:])
        if text[f]:
            with np.errstate(invalid="ignore"):
                bins = np.argsort(np.where(h[0] > 0, h[1] / h[0], np.inf), axis=1, kind="stable")  # bins without rows go right
            h = np.stack([np.take_along_axis(x, bins, axis=1) for x in h])
        la, lb = h.cumsum(axis=2)
        ra, rb = a[:, None] - la, b[:, None] - lb
        g = np.where((la >= least) & (ra >= least), tr.gini_worth(la, lb) + tr.gini_worth(ra, rb) - base[:, None], -np.inf)
        cut = g.argmax(axis=1)
        for i in np.flatnonzero(g[fits, cut] > gain * (1 + 1e-12)):
            c = cut[i]
            left = np.zeros(width, bool)
            left[bins[i, :c + 1]] = True
            gain[i], best[i] = g[i, c], (f, np.packbits(left).tobytes(), *(float(x[i, c]) for x in (la, lb, ra, rb)))
    return best
