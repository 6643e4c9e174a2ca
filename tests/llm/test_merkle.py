"""Operator 11 against plain Python trees, on awkward rows and beyond one superblock."""

import collections
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from flock.llm._util import in_order
from flock.llm.merkle import merkle_manifest

from .conftest import DOCS, rows


def h(*digests):
    return sha256("".join(digests).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n = row
    out = ""
    for v in (doc_id, source, lang, n, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def levels(low):
    out = [low]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    """(sibling or nothing, whether it lies on the left) from a leaf up."""
    out = []
    for level in tree[:-1]:
        j = i ^ 1
        out.append((level[j] if j < len(level) else "", j < i))
        i //= 2
    return out


def tampered(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0


def brute(table):
    groups = collections.defaultdict(list)
    for r in table:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = way(trees[g], i) + way(top, k)
            digest = leaf(r[:4] + (r[4] + 1,)) if tampered(r) and r[4] is not None else leaf(r)
            for s, left in path:
                digest = h(s, digest) if left else h(digest, s)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, h(*[s for s, _ in path]), digest, digest == root))
    return sorted(out, key=str)


def manifest(df, **options):
    return merkle_manifest(df, **options, altered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
                           changes={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})


def got(df, **options):
    return sorted((tuple(r) for r in manifest(df, **options).collect()), key=str)


def test_awkward_rows(docs):
    assert got(docs.withColumn("pos", F.lit(1)).withColumn("tree", F.lit(2))) == brute(rows())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 17, 33])
def test_trees_of_many_superblocks(spark, n):
    table = [(i * 3, f"t{i}", ["é", "en", None, ""][i % 4] if i % 2 else "en", None, i) for i in range(n)]
    assert got(spark.createDataFrame(table, DOCS).repartition(3), levels=1 if n < 9 else 2) == brute(table)


def test_more_than_one_superblock(spark):
    table = [(i, "same", "en", "a", 1) for i in range(1500)] + [(7, "same", "en", "a", 1)] * 700 + [(i, "x", "de", None, None) for i in range(1025)]
    assert got(spark.createDataFrame(table, DOCS).repartition(5)) == brute(table)


def test_every_group_of_its_own(spark):
    table = [(i % 9, "x", f"l{i:05d}", None, i) for i in range(1100)]
    assert got(spark.createDataFrame(table, DOCS).repartition(4)) == brute(table)


def test_largest_length_and_untouched(spark, empty):
    table = [(i, "x", "en", "a", 2 ** 63 - 1) for i in range(30)]
    out = manifest(spark.createDataFrame(table, DOCS)).collect()
    assert {r.doc_id for r in out if not r.verified} == {r[0] for r in table if tampered(r)} != set()
    assert all(r.verified for r in merkle_manifest(spark.createDataFrame(table, DOCS)).collect())
    assert manifest(empty).count() == 0


def test_in_order(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("b", 2), ("a", 2), ("a", None)] + [("c", 5)] * 50, "g string, v int").repartition(4)
    out = sorted((r.tree, r.pos, r.n, r.g, r.v) for r in in_order(df, "g", ["v"]).collect())
    assert out[:5] == [(0, 0, 2, None, 1), (0, 1, 2, None, 3), (2, 0, 2, "a", None), (2, 1, 2, "a", 2), (4, 0, 1, "b", 2)]
    assert out[5:] == [(5, i, 50, "c", 5) for i in range(50)]
