"""Operator 12 against all pairs."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flock.llm.near_vectors import _compare, interval_join, near_vectors, principal_axes

SCHEMA = "vec_id long, embedding array<float>, label int"


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(table, threshold):
    n = len(table)
    vs = [np.array(np.float32(v), dtype=float) if fine(v) else None for _, v, _ in table]
    near = collections.defaultdict(set)
    for i in range(n):
        for j in range(i):
            if vs[i] is None or vs[j] is None or table[i][2] is None or table[i][2] != table[j][2] or len(vs[i]) != len(vs[j]):
                continue
            c = math.fsum(vs[i] * vs[j]) / (math.sqrt(math.fsum(vs[i] ** 2)) * math.sqrt(math.fsum(vs[j] ** 2)))
            if c >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [table[k][0] for k in seen if table[k][0] is not None]
        comp = min(ids) if ids else None
        out.append((table[i][0], len(near[i]), comp, table[i][0] == comp))
    return sorted(out, key=str)


def cloud(seed, n, dims, labels, spread=0.08):
    """Chains and clumps around a few centres, copies and scaled copies among them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + spread * rng.normal(size=dims) * (1 + i % 5)
        if i % 11 == 3 and out:
            v = np.array(out[rng.integers(len(out))][1])
        if i % 17 == 5 and out:
            v = 2.0 * np.array(out[rng.integers(len(out))][1])
        out.append((int(i * 7 % n), [float(np.float32(x)) for x in v], [None, 1, 2, 3][rng.integers(4)] if labels else 1))
    return out


AWKWARD = [(1000, None, 1), (1001, [], 1), (1002, [0.0, 0.0], 1), (1003, [1.0, None], 1), (1004, [1.0, float("nan")], 1),
           (1005, [1.0, float("inf")], 1), (1006, [1.0, 2.0], None), (1007, [1.0, 2.0], 1), (1007, [1.0, 2.0], 1), (None, [1.0, 2.0], 1),
           (None, [5.0, 1.0, 1.0], 2), (1008, [3e38, 1e38], 1), (1009, [3e-40, 1e-40], 1), (1010, [-0.0, 1.0], 4), (1011, [0.0, 1.0], 4),
           (1012, [1.0], 5), (1013, [2.0], 5), (1014, [-1.0], 5)]


def got(df, **options):
    return sorted((tuple(r) for r in near_vectors(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed,dims,threshold,block", [(1, 24, 0.98, 512), (2, 24, 0.98, 16), (3, 5, 0.98, 16), (4, 12, 0.9, 8), (5, 3, 0.995, 8)])
def test_all_pairs(spark, seed, dims, threshold, block):
    table = cloud(seed, 300, dims, True) + AWKWARD
    df = spark.createDataFrame(table, SCHEMA).repartition(3).withColumn("block", F.lit(1)).withColumn("rid", F.lit("r")).withColumn("copies", F.lit(0))
    want = brute(table, threshold)
    assert sum(r[1] > 0 for r in want) > 50
    assert got(df, threshold=threshold, block=block) == want


def test_a_hot_vector_and_a_hot_clump(spark):
    rng = np.random.default_rng(9)
    clump = [(i, [float(np.float32(x)) for x in np.ones(16) + 0.05 * rng.normal(size=16)], 1) for i in range(300)]
    table = clump + [(1000 + i, [1.0] * 15 + [-9.0], 1) for i in range(200)] + cloud(10, 60, 16, False)
    assert got(spark.createDataFrame(table, SCHEMA).repartition(4), block=32) == brute(table, 0.98)


def test_empty_and_text_labels(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "é"), (2, [1.0, 0.01], "é"), (3, [1.0, 0.0], "e")], "vec_id long, embedding array<double>, label string")
    assert got(df) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert near_vectors(df.limit(0)).count() == 0
    assert near_vectors(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 3


def test_distant_blocks_are_skipped(spark):
    """Six far clumps of one label: only blocks of one clump meet."""
    rng = np.random.default_rng(2)
    centres = 5 * rng.normal(size=(6, 8))
    rows = [(b, c) for c in range(6) for b in range(c * 4, c * 4 + 4)]
    low = {b: [float(x) for x in centres[c] - 0.05] for b, c in rows}
    df = spark.createDataFrame([(b, "x", "x", low[b], [x + 0.1 for x in low[b]]) for b, _ in rows],
                               "block long, first string, last string, low array<double>, high array<double>")
    pairs = {(r.a, r.b) for r in interval_join(df, 8, 0.2).collect()}
    assert pairs == {(a, b) for a, ca in rows for b, cb in rows if a <= b and ca == cb}


def test_axes(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(500, 6)) * np.array([9, 5, 1, 0.1, 0.1, 0.1]) + 1
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "rid long, v array<double>")
    basis = principal_axes(df, 2)
    assert basis.shape == (6, 2) and np.allclose(basis.T @ basis, np.eye(2)) and abs(basis[0, 0]) > 0.9
    assert principal_axes(df, 2, fit_values=60).shape == (6, 2)


def test_no_rows_of_links():
    import pandas as pd

    a = pd.DataFrame({"block": [0], "rid": [1], "space": ["x"], "copies": [1], "v": [np.array([1.0, 0.0])]})
    out = _compare(a, a.assign(space="y"), 0.98)
    assert len(out) == 0 and list(out.columns) == ["rid", "links", "least"] and set(map(str, out.dtypes)) == {"int64"}
