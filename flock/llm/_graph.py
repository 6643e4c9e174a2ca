"""Connected components of a table of links, without the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from ._util import hint_if_small

#: Links that one task connects at once.
AT_ONCE = 1 << 17


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of the nodes of all links, those connected with one label."""
    at: dict = {}
    nodes, up = [], []

    def top(node) -> int:
        key = tuple(node.values()) if isinstance(node, dict) else node
        i = at.setdefault(key, len(nodes))
        if i == len(nodes):
            nodes.append(node)
            up.append(i)
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for x, y in zip(*[c.to_pylist() for c in batch.columns]):
            up[top(x)] = top(y)
    if nodes:
        yield pa.record_batch([pa.array(nodes, kind), pa.array([nodes[top(x)] for x in nodes], kind)], ["node", "label"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that links with another; the component is
    the smallest node that links reach.

    Each round contracts the links: a node goes over to the first one among itself and
    its neighbours, links run between the nodes gone over to, and those inside one
    node vanish.  AT_ONCE links or fewer left go to one task.  In the first round the smallest node is the first, so stars
    around their smallest node are done; later ones order the nodes by a hash of their own,
    which leaves at most three quarters of them on average, however the links run.  So
    all rounds together cost a few times the first one.  The way back gives each node
    what the one it went over to became.  All are tables; the driver sees whether links are
    left.  A lost executor costs one round.
    """
    def pairs(df: DataFrame, a: str, b: str) -> DataFrame:
        return materialize(df.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x <> y").distinct())

    def order(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(len(rounds)), c) if rounds else F.lit(0).cast("long"), F.col(c).alias("node"))

    edges, rounds = pairs(links, a, b), []
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        near = both.groupBy("x").agg(F.min(order("y")).alias("near"))
        rounds.append(materialize(near.select(F.col("x").alias("node"), F.least(order("x"), "near")["node"].alias("label"))))
        known = hint_if_small(rounds[-1], 64)
        left = edges.join(known.select(F.col("node").alias("x"), F.col("label").alias("p")), "x")
        left = pairs(left.join(known.select(F.col("node").alias("y"), F.col("label").alias("q")), "y"), "p", "q")
        release(edges)
        held = left.count()
        if held <= AT_ONCE:
            if held:
                schema = ", ".join(f"{c} {left.schema['x'].dataType.simpleString()}" for c in ("node", "label"))
                rounds.append(materialize(left.coalesce(1).mapInArrow(_connect, schema)))
            release(left)
            break
        edges = left

    def back(earlier: DataFrame, later: DataFrame) -> DataFrame:
        """``earlier`` with what its labels became; those with no links left are what they were."""
        to = hint_if_small(later, 64).select(F.col("node").alias("label"), F.col("label").alias("to"))
        out = materialize(earlier.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        release(earlier, later)
        return out

    out = rounds.pop()
    if rounds:
        while len(rounds) > 1:
            out = back(rounds.pop(), out)
        # the smallest node of all is a label of the first round, and one of a component's nodes in the next
        low = materialize(out.groupBy("label").agg(F.min("node").alias("low")))
        named = materialize(out.join(hint_if_small(low, 64), "label").select("node", F.col("low").alias("label")))
        release(out, low)
        out = back(rounds.pop(), named)
    return out.select("node", F.col("label").alias("component"))
