"""The comparison of op3's paragraphs grows with what meets, not with the square of what chance connects."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flock.llm import _graph as graph
from flock.llm import jaccard_join as join
from flock.llm import substring_dedup as module
from flock.llm._words import shingle_sets


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(6))


def chained(n):
    """Paragraphs in which each shares six words with the next one, and every tenth has a near copy."""
    rng = random.Random(7)
    phrases = [[word(rng) for _ in range(7)] for _ in range(n + 1)]
    own = [phrases[i] + [word(rng) for _ in range(4)] + phrases[i + 1] for i in range(n)]
    return [" ".join(w) for w in own], [" ".join(own[i] + ["more"]) for i in range(0, n, 10)]


def sets_of(spark, texts):
    rows = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        rows += join.array_batch(*shingle_sets(data, np.array([0, len(data)]), 5)).to_pylist()
    return spark.createDataFrame([tuple(r[c] for c in ("k1", "k2", "n", "marks", "members")) for r in rows], join.ARRAYS)


def linked(found):
    out = {}
    for r in found.collect():
        out.setdefault(tuple(r.component), set()).add(r.k1)
    return sorted(sorted(x) for x in out.values())


@pytest.fixture
def chain(spark):
    texts, near = chained(300)
    arrays = sets_of(spark, texts + near).cache()
    keys = [r.k1 for r in arrays.select("k1").collect()]
    met = spark.createDataFrame([(keys[0], k) for k in keys[1:]], "a long, b long")
    return arrays, met, len(near)


def test_clusters_by_chance_are_compared_by_tile(chain, monkeypatch):
    arrays, met, near = chain
    arrays_of = lambda keys: arrays
    want = linked(join.resolve(met, arrays_of, 80))
    assert len(want) == near
    rows, cluster = [], arrays.withColumn("cluster", F.lit(1).cast("long"))
    monkeypatch.setattr(join, "SPREAD", 50)
    for r in join._by_tile(cluster, module.meeting_keys).groupBy("cluster").count().collect():
        rows.append(r["count"])
    assert sum(c * (c - 1) // 2 for c in rows) < 10 * arrays.count() < arrays.count() ** 2 // 2
    assert linked(join.resolve(met, arrays_of, 80, module.meeting_keys)) == want


def test_links_of_a_task_are_stars_around_their_smallest_key():
    k1, k2 = np.array([5, 3, 9, 3, 7, 1]), np.array([0, 2, 0, 1, 0, 0])
    x, y = join.stars(np.array([0, 1, 2]), np.array([1, 2, 3]), k1, k2)
    assert sorted(zip(x.tolist(), y.tolist())) == [(3, 0), (3, 1), (3, 2)]
    assert [len(v) for v in join.stars(np.zeros(0, np.int64), np.zeros(0, np.int64), k1, k2)] == [0, 0]


@pytest.mark.parametrize("at_once", [0, 1 << 17])
def test_components_of_paths_take_few_rounds(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, keep=graph.materialize: written.append(1) or keep(df))
    n, rng = 3000, random.Random(3)
    links = [(i, i + 1) for i in range(n)] + [(n + 5, n + 5), (n + 7, None)] + [(n + 20, n + 10 + i) for i in range(5)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").selectExpr("named_struct('k1', a, 'k2', 0L) a", "if(b is null, null, named_struct('k1', b, 'k2', 0L)) b")
    got = {r.node.k1: r.component.k1 for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {n + 10 + i: n + 10 for i in range(5)} | {n + 20: n + 10}
    assert len(written) < 60


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_rows_without_a_list_are_not_dealt(spark):
    docs = spark.range(500).withColumnRenamed("id", "row")
    lists = spark.sql("SELECT id * 2 AS row, sequence(1, 20000) AS wanted FROM range(300)")
    got = module._with_lists(docs, lists, wanted=8)
    assert sorted(r.row for r in got.select("row").collect()) == [2 * i for i in range(250)]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_have_one_order_for_all_sets():
    """Sets of many members beside small ones, in a batch or alone, get the same tiles."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (9, 30, 49, 700, 20_000)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rows, tiles = join.tile_keys(np.concatenate(sets), at, 80)
    for i, s in enumerate(sets):
        assert join.tile_keys(s, np.array([0, len(s)]), 80)[1].tolist() == tiles[rows == i].tolist()


def test_one_pass_for_sentences_and_lines():
    texts = ["One two three four five six. Seven eight nine ten eleven twelve thirteen fourteen.\nA line of its own that has ten words in all.", "", "few words"]
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "row", "text"])
    rows = [r for b in module._sentence_rows(iter([batch])) for r in b.to_pylist()]
    assert [(r["line"], r["ordinal"], r["word"], r["k1"] is None, r["p1"] is None) for r in rows] == [
        (0, 0, 0, False, True), (0, 1, 6, False, False), (1, 2, 14, False, True), (0, -1, None, True, False), (1, -1, None, True, False)]
