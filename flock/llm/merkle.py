"""Operator 11, Merkle dataset manifest by cogrouped subtree exchange.

Every group's leaves, in the order of their ids, are the bottom of a binary
hash tree; the groups' roots, in the order of the groups, are the bottom of
one more.  A tree is cut into superblocks of ``2**LEVELS`` neighbours.  On the
way up each superblock is reduced to one node, tier by tier, until each tree is
one node.  On the way down a tier's nodes are cogrouped with what their
superblock needs from outside (the siblings above it), so a tier of
``2**LEVELS`` times as many nodes gets its own; the last cogrouping, of leaves
and outer nodes, finishes local reduction, proof joining and folding together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import intermediates, materialize
from ._util import in_order

#: Levels of a superblock: at most 1024 nodes meet in one call.
LEVELS = 10
#: Fixed order of a leaf's values.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "tree long, pos long, n long, digest string"
_OUTER = "tree long, block long, path array<string>, subroot string, root string"


def _h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """sha256 of the values, each as ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    one = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*one), 256)


def _levels(nodes: pd.DataFrame, most: int) -> list[list[str]]:
    """The levels of one superblock from its nodes up, at most ``most`` above them; ``n`` counts the tree's
    nodes of this tier, so a small tree stops at its root."""
    out = [nodes["digest"].tolist()]
    for _ in range(min(most, (int(nodes["n"].iloc[0]) - 1).bit_length())):
        low = out[-1]
        out.append([_h(*low[i:i + 2]) for i in range(0, len(low), 2)])
    return out


def _reduce(nodes: pd.DataFrame, most: int) -> pd.DataFrame:
    nodes = nodes.sort_values("pos")
    first, top = nodes.iloc[0], _levels(nodes, most)[-1][0]
    return pd.DataFrame({"tree": [first["tree"]], "pos": [first["pos"] >> most], "n": [-(-int(first["n"]) >> most)], "digest": [top]})


def _local_paths(levels: list[list[str]], i: int) -> list[str]:
    """Siblings of node ``i`` from its own level up: L or R and the digest, or nothing for one that is alone."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append(("L" if j < i else "R") + level[j] if j < len(level) else "")
        i >>= 1
    return out


def _fold(digest: str, path: list[str]) -> str:
    for s in path:
        digest = _h(s[1:], digest) if s[:1] == "L" else _h(digest, s[1:])
    return digest


def _hand_down(nodes: pd.DataFrame, outer: pd.DataFrame, most: int) -> pd.DataFrame:
    """The outer rows of the superblocks that these nodes are."""
    nodes, above = nodes.sort_values("pos"), outer.iloc[0]
    levels = _levels(nodes, most)
    paths = [_local_paths(levels, i) + list(above["path"]) for i in range(len(nodes))]
    return pd.DataFrame({"tree": nodes["tree"].to_numpy(), "block": nodes["pos"].to_numpy(), "path": paths,
                         "subroot": above["subroot"], "root": above["root"]})


def _finish(leaves: pd.DataFrame, outer: pd.DataFrame, most: int) -> pd.DataFrame:
    """Reduction inside the superblock, whole proofs, and each leaf folded up to the root."""
    leaves, above = leaves.sort_values("pos"), outer.iloc[0]
    levels, rest = _levels(leaves, most), list(above["path"])
    rest_text, proofs, folded = "".join(s[1:] for s in rest), [], []
    for i, claimed in enumerate(leaves["claimed"]):
        path = _local_paths(levels, i)
        proofs.append(_h("".join(s[1:] for s in path), rest_text))
        folded.append(_fold(levels[0][i] if pd.isna(claimed) else claimed, path + rest))
    return pd.DataFrame({"id": leaves["id"].to_numpy(), "leaf": levels[0], "subroot": above["subroot"], "root": above["root"],
                         "proof_sha256": proofs, "folded_root": folded, "verified": np.array(folded) == above["root"]})


def _top_of_groups(nodes: pd.DataFrame, outer: pd.DataFrame, most: int) -> pd.DataFrame:
    """One outer row per group tree, whose block 0 is the whole of its top tier: the path of its subroot."""
    nodes = nodes.sort_values("pos")
    return _hand_down(nodes, outer, most).assign(tree=nodes["of"].to_numpy(), block=0, subroot=nodes["digest"].to_numpy())


def _tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Written tables of nodes, from ``nodes`` up to the tier in which each tree is one node."""

    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        return _reduce(block, most)

    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        t = out[-1].select("tree", "pos", "n", "digest")
        out.append(materialize(t.groupBy("tree", F.shiftright("pos", most).alias("block")).applyInPandas(reduce, _NODES)))
    return out


def _cogroup(nodes: DataFrame, outer: DataFrame, function, most: int, schema: str) -> DataFrame:
    def finish(block: pd.DataFrame, needed: pd.DataFrame) -> pd.DataFrame:
        return function(block, needed, most)

    left = nodes.withColumn("block", F.shiftright("pos", most)).groupBy("tree", "block")
    return left.cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, schema)


def _down(tiers: list[DataFrame], top: DataFrame, most: int) -> DataFrame:
    """Outer rows for the superblocks of the lowest tier; ``top`` holds one per tree (block 0)."""
    outer = top
    for nodes in reversed(tiers[1:]):
        outer = materialize(_cogroup(nodes, outer, _hand_down, most, _OUTER))
    return outer


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS,
                    altered: Column | None = None, changes: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    * A leaf is the hash of ``fields`` in that order (see ``leaf``).  Groups are the values of ``group_col``;
      inside one, leaves ascend by id, null first; rows of one id by their hash.  Groups ascend by their UTF-8
      bytes, null first.
    * Two neighbours become the hash of their digests, a last one alone the hash of its own; a tree of one
      leaf is that leaf.
    * ``proof_sha256`` hashes the siblings from the leaf to the root; ``folded_root`` is computed from leaf and
      siblings.  Where ``altered`` holds, the folded leaf has ``changes`` (field: value) in place of the values
      stored; ``verified`` tells whether the root comes out.
    * Null values have a form of their own in a leaf, so null and empty differ.  An empty table gives an empty
      result.  Other columns are not read, whatever their names.

    Scale: only ids and digests travel: once dealt by range, once per way by superblock.  A superblock is
    2**levels nodes (1024) whatever the groups' sizes, so a hot group is many tasks; each tier is a table in the
    checkpoint folder as many times smaller than the one below.
    """
    changes = changes or {}
    changed = leaf(*[changes.get(f, F.col(f)) for f in fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("key"), leaf(*map(F.col, fields)).alias("digest"),
                       (F.lit(None).cast("string") if altered is None else F.when(altered, changed)).alias("claimed"))
    id_type = rows.schema["id"].dataType
    with intermediates() as scope:
        ordered = in_order(rows, "key", ["id", "digest"])
        # ids travel as text: a null beside whole numbers would turn them into floating point
        leaves = scope.keep(materialize(ordered.select("tree", "pos", "n", F.col("id").cast("string").alias("id"), "digest", "claimed")))
    tiers = _tiers(leaves, levels)
    subroots = tiers[-1].select(F.col("tree").alias("of"), F.col("digest"))
    groups = in_order(subroots.withColumn("one", F.lit(0)), "one", ["of"])
    groups = materialize(groups.select(F.col("tree"), "pos", "n", "of", "digest"))
    upper = _tiers(groups, levels)
    roots = upper[-1].select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("path"),
                             F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    above = _down(upper, materialize(roots), levels)
    # each group's own way to the root is the outer path of its tree
    top = materialize(_cogroup(groups, above, _top_of_groups, levels, _OUTER))
    out = _cogroup(leaves, _down(tiers, top, levels), _finish, levels,
                   "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.select(F.col("id").cast(id_type).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

