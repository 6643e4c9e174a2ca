"""Histogram trees grown level by level: L6 (class trees), L12-L14 (second-order boosting).

Rows carry the bin of every feature (an array) and the sums a split is judged
by: class weights for a class tree, gradient and Hessian for boosting.  In a
round each task leads its rows down the splits so far and sums those in open
nodes per (tree, node, feature, bin) in arrays of bounded size; only these sums
meet in the exchange, and the split of a node is then searched in its own
histogram (features x bins rows, whatever the data).  Only the chosen splits, a
row per node, reach the driver; the data is read once a round and never moved.
Several trees (ten seeds, say) grow in the same rounds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import ranks

#: Bins of a numeric feature: every value has its own while there are no more than this.
MAX_BINS = 256
MISSING = -1


@dataclass(frozen=True)
class Feature:
    """A numeric feature with its cut points, or a text feature with its levels (bin = place in the list)."""

    name: str
    cuts: tuple[float, ...] = ()
    levels: tuple[str, ...] | None = None


def fit_bins(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[Feature]:
    """Cut points half way between neighbouring values; a column of more than ``max_bins`` values is cut at
    ranks n/max_bins apart, exactly counted.  At most ``max_bins`` values (or the text levels) a feature reach
    the driver."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    numeric = [c for c in features if c not in text]
    cuts: dict[str, list[float]] = {c: [] for c in numeric}
    if numeric:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "key", "value")
        counts = ranks.counted(long.where(~F.isnan("value")))
        many = counts.groupBy("key").agg(F.count(F.lit(1)).alias("values"))
        running = ranks.running_counts(counts).join(F.broadcast(many), "key")  # a row per feature
        bin_ = F.when(F.col("values") <= max_bins, F.col("value")).otherwise(F.ceil(F.col("cum") * max_bins / F.col("n")).cast("double"))
        edges = running.groupBy("key", bin_.alias("bin")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
        found: dict[str, list[tuple[float, float]]] = {c: [] for c in numeric}
        for r in edges.collect():
            found[r["key"]].append((r["low"], r["high"]))
        for c, e in found.items():
            e.sort()
            cuts[c] = [a[1] + (b[0] - a[1]) / 2 for a, b in zip(e, e[1:])]
    levels = {c: tuple(sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())) for c in features if c in text}
    return [Feature(c, levels=levels[c]) if c in text else Feature(c, tuple(cuts[c])) for c in features]


def binned(df: DataFrame, features: list[Feature], out: str = "bins") -> DataFrame:
    """``df`` with the array ``out``: each feature's bin, MISSING for a null, a NaN or a level not seen."""
    numeric = [f for f in features if f.levels is None]
    tmp = {f.name: f"_bin_{i}" for i, f in enumerate(features)}
    if numeric:
        wide = df.withColumns({f"_x{tmp[f.name]}": F.coalesce(F.col(f.name).cast("double"), F.lit(float("nan"))) for f in numeric})
        inf = float("inf")
        splits = [[-inf, *f.cuts, inf] if f.cuts else [-inf, 0.0, inf] for f in numeric]
        df = Bucketizer(splitsArray=splits, inputCols=[f"_x{tmp[f.name]}" for f in numeric], outputCols=[tmp[f.name] for f in numeric],
                        handleInvalid="keep").transform(wide)
    one = []
    for f in features:
        if f.levels is None:
            b = F.col(tmp[f.name]).cast("int")
            one.append(F.when(F.isnan(F.col(f"_x{tmp[f.name]}")), MISSING).when(F.lit(not f.cuts), 0).otherwise(b))
        else:
            known = F.array(*[F.lit(x) for x in f.levels]).cast("array<string>")
            at = F.coalesce(F.array_position(known, F.col(f.name)), F.lit(0)).cast("int")
            one.append(F.when(at > 0, at - 1).otherwise(MISSING))
    return df.withColumn(out, F.array(*one).cast("array<int>")).drop(*tmp.values(), *[f"_x{t}" for t in tmp.values()])


@dataclass
class Node:
    """``a`` and ``b``: the node's sums (class weights, or Hessian and gradient)."""

    n: float
    a: float
    b: float
    gain: float = 0.0
    feature: int = -1
    left_bins: tuple[int, ...] = ()
    missing_left: bool = False


@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of k are 2 k and 2 k + 1; leaves have no feature."""

    nodes: dict[int, Node] = field(default_factory=dict)

    def leaves(self) -> list[int]:
        return [k for k, node in self.nodes.items() if node.feature < 0]

    def route(self, bins: Column, value: Callable[[Node], float]) -> Column:
        """``value`` of the leaf that a row's bins reach."""
        def at(k: int) -> Column:
            node = self.nodes[k]
            return F.lit(value(node)) if node.feature < 0 else F.when(goes_left(bins, node), at(2 * k)).otherwise(at(2 * k + 1))
        return at(1)


def goes_left(bins: Column, node: Node) -> Column:
    b = bins[node.feature]
    left = set(node.left_bins)
    inside = (b <= max(left)) & (b >= 0) if left == set(range(max(left, default=-1) + 1)) and left else b.isin(*left) if left else F.lit(False)
    return (inside | (b == MISSING)) if node.missing_left else inside


@dataclass(frozen=True)
class Rules:
    """``score(a, b)``: what a set of rows is worth (larger is better); a split gains the children's worth over the node's.
    ``min_rows`` a side, ``min_a`` of the first sum a side; a node of fewer than ``min_split`` rows is not split."""

    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    min_rows: int = 1
    min_a: float = 0.0
    min_split: int = 2
    max_depth: int = 30
    max_leaves: int | None = None
    #: Whether a node may be split at all, given the root.
    worth: Callable[[Node, Node], bool] = lambda node, root: True
    min_gain: float = 1e-12


_BEST = "tree int, node long, n double, a double, b double, gain double, feature int, left_bins array<int>, missing_left boolean, ln double, la double, lb double"


def best_split(hist: pd.DataFrame, text: set[int], rules: Rules) -> pd.DataFrame:
    """The best split of one node from its histogram rows (feature, bin, n, a, b).

    Bins of a text feature are tried in the order of their b / a, which finds the best two sets for two classes.
    Missing values go to the side that gains more (the right one in a tie).  Ties: first feature, first cut."""
    hist = hist.sort_values(["feature", "bin"])
    at, bin_, sums = hist["feature"].to_numpy(), hist["bin"].to_numpy(), hist[["n", "a", "b"]].to_numpy(dtype=float)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    whole = sums[at == at[0]].sum(axis=0)
    n, a, b = map(float, whole)
    best = (rules.min_gain, -1, (), False, 0.0, 0.0, 0.0)
    base = float(rules.score(np.array(a), np.array(b)))
    for lo, hi in zip(starts, [*starts[1:], len(at)]):
        f, h, values = int(at[lo]), sums[lo:hi], bin_[lo:hi]
        miss = np.zeros(3)
        if values[0] == MISSING:
            miss, h, values = h[0], h[1:], values[1:]
        if f in text:
            order = np.lexsort((values, h[:, 2] / np.where(h[:, 1] == 0, 1e-300, h[:, 1])))
            h, values = h[order], values[order]
        cum = h.cumsum(axis=0)
        for to_left in ((False, True) if miss[0] else (False,)):
            left = cum + miss if to_left else cum
            right = whole - left
            ok = (left[:, 0] >= rules.min_rows) & (right[:, 0] >= rules.min_rows) & (left[:, 1] >= rules.min_a) & (right[:, 1] >= rules.min_a)
            if not ok.any():
                continue
            gain = np.where(ok, rules.score(left[:, 1], left[:, 2]) + rules.score(right[:, 1], right[:, 2]) - base, -np.inf)
            i = int(gain.argmax())
            if gain[i] > best[0] * (1 + 1e-12):
                bins = values[:i + 1] if f in text else np.arange(values[i] + 1)
                best = (float(gain[i]), f, tuple(int(x) for x in bins), to_left, *map(float, left[i]))
    gain, feature, bins, to_left, ln, la, lb = best
    return pd.DataFrame({"tree": [hist["tree"].iloc[0]], "node": [hist["node"].iloc[0]], "n": [n], "a": [a], "b": [b],
                         "gain": [gain if feature >= 0 else 0.0], "feature": [feature], "left_bins": [list(bins)], "missing_left": [to_left],
                         "ln": [ln], "la": [la], "lb": [lb]})


#: Histogram cells (nodes x bins of all features) that one task holds for a tree; more nodes go to several readings.
MAX_CELLS = 1 << 21
_CELLS = "tree int, node long, feature int, bin int, n double, a double, b double"


def widths(features: list[Feature]) -> list[int]:
    """Cells of each feature: its bins and one for MISSING, which comes first."""
    return [max(len(f.cuts) + 1 if f.levels is None else len(f.levels), 1) + 1 for f in features]


def _histograms(rows: dict[int, DataFrame], wanted: dict[int, list[int]], known: dict[int, dict[int, Node]], features: list[Feature]) -> DataFrame:
    """Of the wanted nodes of all trees: each task leads its rows down the known splits and sums them per (tree, node,
    feature, bin); the sums of all tasks meet in one exchange, a row a cell."""
    cells_of = widths(features)
    most = max(1, MAX_CELLS // max(1, sum(cells_of)))
    each = [rows[t].select("bins", F.col("a").cast("double"), F.col("b").cast("double")).mapInArrow(
        _partial_sums(t, nodes[i:i + most], known.get(t, {}), cells_of), _CELLS)
        for t, nodes in wanted.items() for i in range(0, len(nodes), most)]
    cells = reduce(DataFrame.unionAll, each)
    return cells.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "nab"])


def router(wanted: list[int], known: dict[int, Node], widths: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """For the bins of many rows (rows x features): the place in ``wanted`` of the node that each row comes to, -1 if none."""
    slots = {k: i for i, k in enumerate(wanted)}  # the wanted nodes, then the splits above them
    for k in wanted:
        while k > 1:
            k >>= 1
            slots.setdefault(k, len(slots))
    inner = list(slots)[len(wanted):]
    feature = np.array([0] * len(wanted) + [known[k].feature for k in inner])
    child = np.full((len(slots), 2), -1)  # left, right; -1: no wanted node lies there
    left = np.zeros((len(slots), max(widths, default=1)), dtype=bool)
    for k in inner:
        child[slots[k]] = [slots.get(2 * k, -1), slots.get(2 * k + 1, -1)]
        left[slots[k], [b + 1 for b in known[k].left_bins]] = True
        left[slots[k], MISSING + 1] = known[k].missing_left

    def run(bins: np.ndarray) -> np.ndarray:
        at = np.full(len(bins), slots[1])
        moving = np.flatnonzero(at >= len(wanted))
        while len(moving):
            k = at[moving]
            k = child[k, np.where(left[k, bins[moving, feature[k]] + 1], 0, 1)]
            at[moving] = k
            moving = moving[k >= len(wanted)]
        return at
    return run


def _partial_sums(tree: int, wanted: list[int], known: dict[int, Node], widths: list[int]):
    """For ``mapInArrow`` over (bins, a, b): the sums of a task's rows for the wanted nodes of one tree."""
    route = router(wanted, known, widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((3, len(wanted) * w)) for w in widths]
        for batch in batches:
            bins = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(widths))
            at = route(bins)
            here = np.flatnonzero(at >= 0)
            if not len(here):
                continue
            at, cell = at[here], bins[here] + 1
            a, b = (np.nan_to_num(batch.column(i).to_numpy(zero_copy_only=False)[here]) for i in (1, 2))
            for f, w in enumerate(widths):
                key = at * w + cell[:, f]
                for total, weights in zip(sums[f], (None, a, b)):
                    total += np.bincount(key, weights, len(total))
        for f, w in enumerate(widths):
            found = np.flatnonzero(sums[f][0])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(found), tree), pa.int32()), pa.array([wanted[i] for i in found // w], pa.int64()),
                pa.array(np.full(len(found), f), pa.int32()), pa.array(found % w - 1, pa.int32()),
                *[pa.array(total[found], pa.float64()) for total in sums[f]]], names=["tree", "node", "feature", "bin", "n", "a", "b"])
    return run


def grow(rows: dict[int, DataFrame], features: list[Feature], rules: Rules) -> dict[int, Tree]:
    """A tree for each table (bins array<int>, a double, b double) that has rows, all grown in the same rounds.

    With ``max_leaves`` a tree grows best first: the open node that gains most is split next.  A round asks for
    the splits of every node that may be next, so a tree of 14 leaves takes about as many rounds as it is deep."""
    text = {i for i, f in enumerate(features) if f.levels is not None}
    known: dict[int, dict[int, Node]] = {}
    sums: dict[tuple[int, int], tuple[float, float, float]] = {}

    def search(hist: pd.DataFrame) -> pd.DataFrame:
        return best_split(hist, text, rules)

    def ask(wanted: dict[int, list[int]]) -> None:
        for r in _histograms(rows, wanted, known, features).groupBy("tree", "node").applyInPandas(search, _BEST).collect():
            known.setdefault(r.tree, {})[r.node] = Node(r.n, r.a, r.b, r.gain, r.feature, tuple(r.left_bins), r.missing_left)
            if r.feature >= 0:
                sums[r.tree, 2 * r.node], sums[r.tree, 2 * r.node + 1] = (r.ln, r.la, r.lb), (r.n - r.ln, r.a - r.la, r.b - r.lb)

    ask({t: [1] for t in rows})
    while True:
        shapes = {t: _expand(known[t], {k: s for (u, k), s in sums.items() if u == t}, rules) for t in known}
        wanted = {t: missing for t, (_, missing) in shapes.items() if missing}
        if not wanted:
            return {t: tree for t, (tree, _) in shapes.items()}
        ask(wanted)


def _expand(known: dict[int, Node], sums: dict[int, tuple[float, float, float]], rules: Rules) -> tuple[Tree, list[int]]:
    """The tree that the known splits give, and the nodes whose split must be known to be sure of it."""
    root = known[1]
    tree, open_, missing, leaves = Tree(), [], [], 1

    def add(k: int) -> None:
        node = Node(*sums[k]) if k > 1 else Node(root.n, root.a, root.b)
        tree.nodes[k] = node
        may = node.n >= rules.min_split and k.bit_length() <= rules.max_depth and rules.worth(node, root)
        if may and k in known:
            if known[k].feature >= 0:
                heapq.heappush(open_, (-known[k].gain, k))
        elif may:
            missing.append(k)

    add(1)
    last = 0
    while open_ and (rules.max_leaves is None or leaves < rules.max_leaves):
        _, last = heapq.heappop(open_)
        tree.nodes[last] = known[last]
        leaves += 1
        for child in (2 * last, 2 * last + 1):
            add(child)
    # with all leaves given out, only the children of the last split need no split of their own
    full = rules.max_leaves is not None and leaves >= rules.max_leaves
    return tree, ([] if full and all(k >> 1 == last for k in missing) else missing)


# ---- class trees -------------------------------------------------------------------

def gini_worth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus the Gini impurity of n = a rows, b of them of the second class, times n."""
    return -2 * b * (a - b) / np.where(a == 0, 1, a)


def _risk(node: Node) -> float:
    return min(node.b, node.a - node.b)


def class_rules(min_split: int = 10, min_bucket: int = 3, max_leaves: int | None = None, max_depth: int = 30, cp: float = 0.01) -> Rules:
    """Gini splits; a node whose own errors are at most ``cp`` of the root's is left alone."""
    return Rules(gini_worth, min_rows=min_bucket, min_split=min_split, max_depth=max_depth, max_leaves=max_leaves,
                 worth=lambda node, root: _risk(node) > cp * _risk(root))


def prune(tree: Tree, cp: float) -> Tree:
    """Cost-complexity pruning: the split whose leaves save least errors apiece goes first, while that is at
    most ``cp`` of the root's errors."""
    nodes = dict(tree.nodes)
    limit = cp * _risk(nodes[1])
    below: dict[int, tuple[float, int]] = {}  # errors and number of the leaves under each node
    saves: dict[int, float] = {}  # errors that each split saves for every leaf it adds

    def sum_up(k: int) -> None:
        if nodes[k].feature < 0:
            below[k] = _risk(nodes[k]), 1
            return
        (r, m), (s, n) = below[2 * k], below[2 * k + 1]
        below[k] = r + s, m + n
        saves[k] = (_risk(nodes[k]) - below[k][0]) / (below[k][1] - 1)

    def drop(k: int) -> None:
        if nodes[k].feature >= 0:
            saves.pop(k)
            for c in (2 * k, 2 * k + 1):
                drop(c)
                del nodes[c], below[c]

    for k in sorted(nodes, reverse=True):  # children before their parents
        sum_up(k)
    while saves:
        weakest, k = min((v, k) for k, v in saves.items())
        if weakest > limit:
            break
        drop(k)
        v = nodes[k]
        nodes[k] = Node(v.n, v.a, v.b)
        while k:  # only the nodes above have changed
            sum_up(k)
            k >>= 1
    return Tree(nodes)


def majority(node: Node) -> float:
    """1 if most rows are of the second class (ties: the first)."""
    return 1.0 if node.b > node.a - node.b else 0.0


# ---- second-order boosting ---------------------------------------------------------

@dataclass
class Booster:
    features: list[Feature]
    eta: float
    reg: float
    rounds: list[Tree] = field(default_factory=list)

    def weight(self, node: Node) -> float:
        return -self.eta * node.b / (node.a + self.reg)

    def margin(self, bins: Column, rounds: int | None = None) -> Column:
        out = F.lit(0.0)
        for tree in self.rounds[:rounds]:
            out = out + tree.route(bins, self.weight)
        return out


def log_loss(margin: Column, label: Column) -> Column:
    """Of the probability 1 / (1 + exp(-margin)) and a label of 0 or 1; no overflow."""
    signed = F.when(label > 0, -margin).otherwise(margin)
    return F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))


def boost(rows: dict[int, DataFrame], features: list[Feature], rounds: int = 2, eta: float = 0.3, max_depth: int = 3, reg: float = 1.0,
          min_child: float = 1.0) -> dict[int, Booster]:
    """Second-order boosting of logistic loss: one booster for each table (bins, label 0/1).

    Every round sums gradients p - y and Hessians p (1 - p) per (booster, node, feature, bin); gain is
    G^2 / (H + reg) of both sides over the node's, leaves weigh -eta G / (H + reg), missing values go where they
    gain more.  Margins start at 0 (probability 0.5) and are an expression of the trees so far."""
    rules = Rules(lambda a, b: b * b / (a + reg), min_a=min_child, max_depth=max_depth, min_split=1, min_gain=1e-9)
    out = {t: Booster(features, eta, reg) for t in rows}
    for _ in range(rounds):
        stats = {}
        for t, booster in out.items():
            p = 1 / (1 + F.exp(-booster.margin(F.col("bins"))))
            stats[t] = rows[t].select("bins", (p * (1 - p)).alias("a"), (p - F.col("label")).alias("b"))
        for t, tree in grow(stats, features, rules).items():
            out[t].rounds.append(tree)
    return out


def gain_cover_frequency(booster: Booster) -> list[tuple[str, float, float, float]]:
    """(feature, gain, cover, frequency) of the features that split, each as a share, largest gain first."""
    total: dict[int, list[float]] = {}
    for tree in booster.rounds:
        for node in tree.nodes.values():
            if node.feature >= 0:
                t = total.setdefault(node.feature, [0.0, 0.0, 0.0])
                t[0], t[1], t[2] = t[0] + node.gain, t[1] + node.a, t[2] + 1
    sums = [math.fsum(t[i] for t in total.values()) for i in range(3)]
    rows = [(booster.features[f].name, *[t[i] / sums[i] for i in range(3)]) for f, t in total.items()]
    return sorted(rows, key=lambda r: (-r[1], r[0]))
