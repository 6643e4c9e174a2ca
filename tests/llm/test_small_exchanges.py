"""op3 at size: few bytes are shuffled and kept, and what meets and links stays the same."""

import random
import time

import numpy as np
import pyarrow as pa

from flock.llm import jaccard_join as join
from flock.llm import substring_dedup as module
from flock.llm._words import U, set_keys, shingle_sets
from flock.session import CLEANUP_CONF, materialize


def parts(pairs, nodes=()):
    """Connected groups of two or more."""
    root = {n: n for n in nodes}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = {}
    for n in root:
        out.setdefault(find(n), set()).add(n)
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(7)) for _ in range(n))


def test_arrays_of_wanted_paragraphs_only():
    rng = random.Random(1)
    lines = [sentence(rng, 12) for _ in range(30)]
    texts = ["\n".join(lines[:20] + lines[:3]), "\n".join(lines[10:])]
    keys = {line: int(k) for line in lines for k in set_keys(*module._paragraphs(np.frombuffer(line.encode(), np.uint8), np.array([0, len(line)]))[:2])[0].view(np.int64)}
    wanted = [[keys[lines[0]], keys[lines[15]]], [keys[lines[29]]]]
    batch = pa.record_batch([pa.array(texts), pa.array(wanted, pa.list_(pa.int64()))], ["text", "wanted"])
    got = [r["k1"] for b in module._array_rows(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
    assert sorted(got) == sorted(wanted[0] + wanted[1])


def test_packed_tiles_meet_like_rows(monkeypatch):
    rng = random.Random(2)
    base = [sentence(rng, rng.randint(8, 70)) for _ in range(60)]
    near = [" ".join(w if i != 3 else "changed" for i, w in enumerate(b.split())) for b in base[:30]]
    texts = ["\n".join(rng.choices(base + near, k=6)) for _ in range(120)]
    batches = [pa.record_batch([pa.array(texts[i:i + 40])], ["text"]) for i in (0, 40, 80)]
    rows = [(r["tile"], r["k1"]) for b in batches for x in module._band_rows(iter([b])) for r in x.to_pylist()]
    first = {}
    want = parts([(first.setdefault(t, k), k) for t, k in rows])
    assert want
    for packed in (50, 1 << 20):
        monkeypatch.setattr(module, "PACKED", packed)
        sent = [x for b in batches for x in module._packed_rows(4)(iter([b]))]
        assert sum(len(p) for b in sent for p in b.column(1).to_pylist()) == 14 * len(rows)
        pairs = []
        for bucket in range(4):
            mine = [b.filter(pa.array([x == bucket for x in b.column(0).to_pylist()])) for b in sent]
            pairs += [(r["a"], r["b"]) for b in module._meeting_rows(iter(mine)) for r in b.to_pylist()]
        assert parts(pairs) == want


def cluster_rows(seed):
    """Clusters of near sets, sorted as they come to a comparing task."""
    rng, rows = random.Random(seed), []
    for cluster in range(rng.randint(1, 12)):
        core = sentence(rng, rng.choice([8, 20, 60, 1300])).split()
        for _ in range(rng.choice([1, 2, 5, 40])):
            words = [w if rng.random() > 0.01 else sentence(rng, 1) for w in core[:len(core) - rng.randint(0, 2)]]
            text = " ".join(words).encode()
            rows += [{"cluster": cluster, "band": 0, "chunk": 0, "band2": 0, "chunk2": 0, "side": 0} | r
                     for r in join.array_batch(*shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 5)).to_pylist()]
    return rows


def test_clusters_compared_together_link_like_one_by_one():
    schema = pa.schema([(c, pa.int64()) for c in join.DEALT] + [("side", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()),
                        ("marks", pa.binary()), ("members", pa.binary())])
    for seed in range(25):
        rows = cluster_rows(seed)
        cuts = sorted(random.Random(seed).choices(range(len(rows) + 1), k=3))
        batches = [pa.RecordBatch.from_pylist(rows[a:b], schema) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        for exact in (False, True):
            want = []
            for cluster in {r["cluster"] for r in rows}:
                mine = [r for r in rows if r["cluster"] == cluster]
                links = join.link_pairs(np.array([r["n"] for r in mine]), [np.frombuffer(r["marks"], U) for r in mine],
                                        [np.frombuffer(r["members"], U) for r in mine] if exact else None, None, 80)
                want += [((cluster, mine[x]["k1"]), (cluster, mine[y]["k1"])) for x, y in links]
            of = {r["k1"]: r["cluster"] for r in rows}
            got = [((of[r["a1"]], r["a1"]), (of[r["b1"]], r["b1"])) for b in join._compare(80, exact)(iter(batches)) for r in b.to_pylist()]
            assert parts(got) == parts(want)


def test_long_lists_are_not_broadcast(spark):
    rows = spark.sql("SELECT id AS row, sequence(1, 20000) AS wanted FROM range(300)")
    hints = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" not in hints(module._hint_lists(rows, wanted=8))
    assert "broadcast" in hints(module._hint_lists(rows.limit(3), wanted=8))
    assert "broadcast" in hints(module._hint_lists(rows.limit(0), wanted=8))


def test_written_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get(CLEANUP_CONF, None)
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    held = files()
    out = materialize(spark.range(5000).repartition(7, "id"))
    assert spark.conf.get(CLEANUP_CONF, None) == before
    for _ in range(50):
        if files() <= held:
            break
        time.sleep(0.2)
    assert files() <= held and out.count() == 5000
