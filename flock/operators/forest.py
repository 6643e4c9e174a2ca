"""Random forests of fully grown class trees (Gini), as tables of their splits.

A row's weight in a tree is a Poisson(1) draw by a hash of the row and the tree, and a node's features are drawn by a
hash of the tree and the node: the forest does not change with the layout of the table.  Equal rows draw apart.

While a node holds more than ``MAX_ROWS`` rows it is split in a round over the table, like the trees in ``trees``: tasks
sum the node's drawn features per bin, and only these sums are exchanged.  The rows of a smaller node meet in one task
(at most ``MAX_ROWS`` of them, a few bytes a feature), which grows all that is below it, a level of nodes at a time.  So
small nodes, of which a full tree has about as many as rows, cost their rows and no histograms; rows x trees is written
to one exchange, and rows x trees x depth is the work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trees as tr

#: Rows of a node that a task grows to the end.
MAX_ROWS = 1 << 18
#: Trees that a task draws rows for in one reading.
BLOCK = 20
#: Chance of at most 0, 1, 2, ... draws of a row.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
_SPLITS = "tree int, node long, feature int, left_bins array<int>, n double, a double, b double, gain double"


@dataclass(frozen=True)
class Settings:
    trees: int
    mtry: int
    node_size: int = 1
    max_depth: int = 30
    seed: int = 987

    def rules(self) -> tr.Rules:
        return tr.Rules(tr.gini_worth, min_a=max(1, self.node_size), max_depth=self.max_depth, min_gain=1e-9)


@dataclass
class Forest:
    """``splits``: (tree, node, feature, left_bins, n, a, b, gain), a row for every node that is split, not computed yet;
    ``gains``: (tree, feature, gain), the sums of it."""

    features: list[tr.Feature]
    settings: Settings
    splits: DataFrame
    gains: DataFrame

    def importance(self) -> list[tuple[str, float]]:
        """Share of every feature in the gain of a tree's splits, mean over the trees that are split."""
        share = F.col("gain") / F.sum("gain").over(Window.partitionBy("tree"))
        sums = self.gains.select("feature", share.alias("share")).groupBy("feature").agg(F.sum("share").alias("share"))
        found = {r.feature: r.share for r in sums.collect()}
        whole = math.fsum(found.values()) or 1.0
        return [(f.name, found.get(i, 0.0) / whole) for i, f in enumerate(self.features)]


def with_bins(df: DataFrame, features: list[tr.Feature], out: str) -> DataFrame:
    """``df`` with the array ``out``: a missing value or unseen level has a bin of its own, the last one."""
    last = F.array(*[F.lit(w - 1) for w in tr.widths(features)])
    return tr.binned(df, features, out).withColumn(out, F.zip_with(out, last, lambda b, w: F.when(b == tr.MISSING, w).otherwise(b)))


def rows_to_draw(df: DataFrame, target: Column, features: list[tr.Feature], keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, target, bins) of all rows and the columns ``keep``, bins as ``with_bins`` has them; equal rows have keys of
    their own."""
    rows = with_bins(df.withColumn("_target", target.cast("double")), features, "_bins")
    same = rows.select(F.xxhash64(*df.columns).alias("_key"), "_target", F.col("_bins").alias("bins"), *keep).groupBy("_key", "_target", "bins", *keep).agg(
        F.count(F.lit(1)).alias("_count"))
    each = same.select("_key", F.col("_target").alias("target"), "bins", *keep, F.explode(F.sequence(F.lit(1), F.col("_count").cast("int"))).alias("_copy"))
    return each.select(F.xxhash64("_key", "target", "bins", "_copy").alias("key"), "target", "bins", *keep)


def fit(rows: DataFrame, features: list[tr.Feature], settings: Settings) -> Forest:
    """The forest of ``rows`` (a stored result of ``rows_to_draw``, read in every round)."""
    known: dict[int, dict[int, tr.Node]] = {}
    open_ = {t: [1] for t in range(settings.trees)}  # nodes for one task each
    wanted = dict(open_) if rows.count() > MAX_ROWS else {}
    rules = settings.rules()
    while wanted:
        found = _large_nodes(rows, features, settings, rules, wanted, known)
        wanted = {}
        for t, k, node, left in found:
            open_[t].remove(k)
            if node.feature < 0:
                continue
            known.setdefault(t, {})[k] = node
            for child, n in ((2 * k, left), (2 * k + 1, node.n - left)):
                open_[t].append(child)
                if n > MAX_ROWS and child.bit_length() <= settings.max_depth:
                    wanted.setdefault(t, []).append(child)
    parts = [rows.mapInArrow(_dealt(features, settings, {t: open_[t] for t in range(i, min(i + BLOCK, settings.trees)) if open_[t]}, known),
                             "tree int, node long, data binary") for i in range(0, settings.trees, BLOCK)]
    dealt = reduce(DataFrame.unionAll, parts).groupBy("tree", "node")
    top = [(t, k, v.feature, list(v.left_bins), v.n, v.a, v.b, v.gain) for t, nodes in known.items() for k, v in nodes.items()]
    top = rows.sparkSession.createDataFrame(top, _SPLITS)
    splits = dealt.applyInPandas(_finished(features, settings, _as_splits), _SPLITS).unionAll(top)
    gains = dealt.applyInPandas(_finished(features, settings, _as_gains), "tree int, feature int, gain double")
    gains = gains.unionAll(top.select("tree", "feature", "gain")).groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    return Forest(features, settings, splits, gains)


# ---- draws ---------------------------------------------------------------------------

def _mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads near values (the finish of splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _start(seed: int, tree: int, salt: int) -> np.ndarray:
    """One number a tree."""
    return _mixed(_mixed(np.array([(seed * 2 + salt) % (1 << 64)], dtype=np.uint64)) + np.array([tree], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def weights(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for the tree."""
    u = (_mixed(keys.view(np.uint64) ^ _start(seed, tree, 0)) >> np.uint64(11)) * 2.0 ** -53
    return np.searchsorted(_POISSON, u, side="right")


def drawn_features(nodes: np.ndarray, features: int, settings: Settings, tree: int) -> np.ndarray:
    """(nodes, mtry): the features that each node of a tree may be split by, ascending."""
    z = _mixed(nodes.astype(np.uint64) ^ _start(settings.seed, tree, 1))[:, None] + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.sort(np.argsort(_mixed(z), axis=1)[:, :settings.mtry], axis=1)


def _batches(batches: Iterator[pa.RecordBatch], features: int):
    for batch in batches:
        if batch.num_rows:
            key, target = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield key, target > 0, batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, features)


# ---- nodes of many rows -----------------------------------------------------------------

def _large_nodes(rows: DataFrame, features: list[tr.Feature], settings: Settings, rules: tr.Rules, wanted: dict[int, list[int]],
                 known: dict[int, dict[int, tr.Node]]) -> list[tuple[int, int, tr.Node, float]]:
    """(tree, node, its split, rows on the left) of the wanted nodes, by one reading of the table for every part of them."""
    nodes = [(t, k) for t, ks in wanted.items() for k in ks]
    most = max(1, min(tr.MAX_CELLS // (settings.mtry * max(tr.widths(features))), math.ceil(len(nodes) * BLOCK / settings.trees)))
    parts = []
    for i in range(0, len(nodes), most):
        part: dict[int, list[int]] = {}
        for t, k in nodes[i:i + most]:
            part.setdefault(t, []).append(k)
        parts.append(rows.mapInArrow(_summed(features, settings, part, known), tr._CELLS))
    text = {i for i, f in enumerate(features) if f.levels is not None}
    cells = reduce(DataFrame.unionAll, parts).groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "nab"])
    found = cells.groupBy("tree", "node").applyInPandas(lambda hist: tr.best_split(hist, text, rules), tr._BEST).collect()
    return [(r.tree, r.node, tr.Node(r.n, r.a, r.b, r.gain, r.feature, tuple(r.left_bins), r.missing_left), r.ln) for r in found]


def _routes(features: list[tr.Feature], wanted: dict[int, list[int]], known: dict[int, dict[int, tr.Node]]) -> dict[int, Callable]:
    widths = [w + 1 for w in tr.widths(features)]  # missing values have a bin of their own here
    return {t: tr.router(ks, known.get(t, {}), widths) for t, ks in wanted.items()}


def _summed(features: list[tr.Feature], settings: Settings, wanted: dict[int, list[int]], known: dict[int, dict[int, tr.Node]]):
    """For ``mapInArrow`` over (key, target, bins): rows, weight and weight of the second class in each bin of the drawn
    features of the wanted nodes."""
    p, width, routes = len(features), max(tr.widths(features)), _routes(features, wanted, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = {t: drawn_features(np.array(ks), p, settings, t) for t, ks in wanted.items()}
        sums = {t: np.zeros((3, d.size * width)) for t, d in drawn.items()}
        for key, target, bins in _batches(batches, p):
            for t, d in drawn.items():
                w = weights(key, settings.seed, t)
                at = np.where(w > 0, routes[t](bins), -1)
                here = np.flatnonzero(at >= 0)
                a = w[here].astype(float)
                b, slots = a * target[here], at[here]
                for j in range(d.shape[1]):
                    cell = (slots * d.shape[1] + j) * width + bins[here, d[slots, j]]
                    for total, x in zip(sums[t], (None, a, b)):
                        total += np.bincount(cell, x, len(total))
        for t, d in drawn.items():
            found = np.flatnonzero(sums[t][0])
            slot = found // width
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(found), t), pa.int32()), pa.array(np.array(wanted[t])[slot // d.shape[1]], pa.int64()),
                pa.array(d.reshape(-1)[slot], pa.int32()), pa.array(found % width, pa.int32()),
                *[pa.array(total[found], pa.float64()) for total in sums[t]]], names=["tree", "node", "feature", "bin", "n", "a", "b"])
    return run


# ---- nodes of few rows ------------------------------------------------------------------

def _kind(features: list[tr.Feature]) -> np.dtype:
    """Of a bin, and of twice the weight of a row."""
    return np.min_scalar_type(max(63, *tr.widths(features)))


def _dealt(features: list[tr.Feature], settings: Settings, wanted: dict[int, list[int]], known: dict[int, dict[int, tr.Node]]):
    """For ``mapInArrow`` over (key, target, bins): the drawn rows of each wanted node, many in one value: bins, then
    twice the weight and 1 for the second class."""
    p, kind, routes = len(features), _kind(features), _routes(features, wanted, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, target, bins in _batches(batches, p):
            packed = np.empty((len(key), p + 1), dtype=kind)
            packed[:, :p] = bins
            out: tuple[list, list, list] = [], [], []
            for t, ks in wanted.items():
                w = weights(key, settings.seed, t)
                packed[:, p] = 2 * w + target
                at = np.where(w > 0, routes[t](bins), -1)
                for i, k in enumerate(ks):
                    data = packed[at == i]
                    if len(data):
                        for column, value in zip(out, (t, k, data.tobytes())):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                                             names=["tree", "node", "data"])
    return run


def _finished(features: list[tr.Feature], settings: Settings, result: Callable):
    """For ``applyInPandas``: all splits below one node, as ``result`` of their columns."""
    p, kind = len(features), _kind(features)
    text = np.array([f.levels is not None for f in features])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
        data = np.frombuffer(b"".join(group["data"]), dtype=kind).reshape(-1, p + 1)
        return result(tree, grow_below(data[:, :p], data[:, p].astype(np.int64), text, settings, tree, node))
    return run


def _as_splits(tree: int, levels: list[dict]) -> pd.DataFrame:
    out = {c: [x for level in levels for x in level[c]] for c in ("node", "feature", "left_bins", "n", "a", "b", "gain")}
    return pd.DataFrame({"tree": [tree] * len(out["node"])} | out | {"left_bins": pd.Series(out["left_bins"], dtype=object)})


def _as_gains(tree: int, levels: list[dict]) -> pd.DataFrame:
    sums: dict[int, float] = {}
    for level in levels:
        for f in np.unique(level["feature"]):
            sums[int(f)] = sums.get(int(f), 0.0) + float(level["gain"][level["feature"] == f].sum())
    return pd.DataFrame({"tree": [tree] * len(sums), "feature": list(sums), "gain": list(sums.values())})


class _LeftBins:
    """The bins that go left, of the splits of a level: a list for each, made when asked for."""

    def __init__(self, cut: np.ndarray, sets: dict[int, np.ndarray]):
        self.cut, self.sets = cut, sets

    def __iter__(self):
        return (self.sets[i].tolist() if i in self.sets else list(range(c + 1)) for i, c in enumerate(self.cut.tolist()))


def grow_below(bins: np.ndarray, code: np.ndarray, text: np.ndarray, settings: Settings, tree: int, root: int) -> list[dict]:
    """The splits below ``root`` from its rows, a dictionary of columns for every level.

    The rows of a level are sorted by (node, bin) for each drawn feature at once; running sums at the last row of a
    bin are what a cut there has on its left.  Bins of a text feature are tried in the order of their share of the
    second class."""
    width = int(bins.max(initial=0)) + 1
    least = max(1, settings.node_size)
    at, ids, levels = np.zeros(len(bins), dtype=np.int64), np.array([root], dtype=np.int64), []
    rows = np.arange(len(bins))
    for _ in range(root.bit_length(), settings.max_depth + 1):
        a = np.bincount(at, code >> 1, len(ids))
        b = np.bincount(at, (code >> 1) * (code & 1), len(ids))
        may = (b > 0) & (b < a) & (a >= 2 * least)
        if not may.any():
            break
        stay = may[at]
        rows, code, at = rows[stay], code[stay], (np.cumsum(may) - 1)[at[stay]]
        ids, a, b = ids[may], a[may], b[may]
        n = np.bincount(at, minlength=len(ids))
        drawn = drawn_features(ids, len(text), settings, tree)
        base = tr.gini_worth(a, b)
        gain, feature, cut = np.full(len(ids), 1e-9), np.full(len(ids), -1), np.zeros(len(ids), dtype=np.int64)
        sets: dict[int, np.ndarray] = {}
        for j in range(drawn.shape[1]):
            cell = bins[rows, drawn[at, j]].astype(np.int64)
            ordered = np.sort(((at * width + cell) << 6) | code)
            key = ordered >> 6
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            w = (ordered & 63) >> 1
            la, lb = np.cumsum(w)[ends], np.cumsum(w * (ordered & 1))[ends]
            key = key[ends]
            node = key // width
            words = text[drawn[node, j]]
            if words.any():  # bins of text features change places inside their node
                sa, sb = np.diff(la, prepend=0), np.diff(lb, prepend=0)
                order = np.lexsort((key, np.where(words, sb / sa, 0.0), node))
                key, la, lb = key[order], np.cumsum(sa[order]), np.cumsum(sb[order])
            first = np.flatnonzero(np.diff(node, prepend=-1))
            la, lb = la - (np.cumsum(a) - a)[node], lb - (np.cumsum(b) - b)[node]
            ra, rb = a[node] - la, b[node] - lb
            g = np.where((la >= least) & (ra >= least), tr.gini_worth(la, lb) + tr.gini_worth(ra, rb) - base[node], -np.inf)
            most = np.maximum.reduceat(g, first)
            better = most > gain * (1 + 1e-12)
            best = np.flatnonzero((g == most[node]) & better[node])
            best = best[np.unique(node[best], return_index=True)[1]]  # the first cut of the equal ones
            here = node[best]
            gain[here], feature[here], cut[here] = g[best], drawn[here, j], key[best] % width
            for i, end in zip(here[words[best]].tolist(), best[words[best]].tolist()):
                sets[i] = np.sort(key[first[i]:end + 1] % width)
            for i in here[~words[best]].tolist() if sets else ():
                sets.pop(i, None)
        split = np.flatnonzero(feature >= 0)
        number = np.full(len(ids), -1)
        number[split] = np.arange(len(split))
        levels.append({"node": ids[split], "feature": feature[split], "n": n[split], "a": a[split], "b": b[split], "gain": gain[split],
                       "left_bins": _LeftBins(cut[split], {int(number[i]): s for i, s in sets.items()})})
        stay = feature[at] >= 0
        rows, code, at = rows[stay], code[stay], at[stay]
        cell = bins[rows, feature[at]]
        left = cell <= cut[at]
        if sets:
            keys = np.sort(np.concatenate([i * width + s for i, s in sets.items()]))
            words = text[feature[at]]
            mine = at[words] * width + cell[words]
            left[words] = keys[np.minimum(np.searchsorted(keys, mine), len(keys) - 1)] == mine
        at = 2 * number[at] + ~left
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], axis=1).reshape(-1)
    return levels
