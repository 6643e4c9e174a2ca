"""op3: how far the ends of anchors go on in other documents, against all pairs."""

import random

import pyarrow as pa

from flock.llm import substring_dedup as module


def ends(rows):
    """Rows of ENDS, sorted, from (g, words, doc_id, row, low, high)."""
    raw = sorted(((g, b"".join(w.to_bytes(module.WORD_BYTES, "big") for w in words), *rest) for g, words, *rest in rows), key=lambda r: r[:2])
    g, more, doc, row, low, high = (list(c) for c in zip(*raw))
    run = [hash((a, b)) >> 1 for a, b in zip(g, more)]
    return pa.record_batch([pa.array(g, pa.int64()), pa.array(run, pa.int64()), pa.array(more, pa.binary()), pa.array(doc, pa.int64()),
                            pa.array(row, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], module.ENDS)


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n // module.WORD_BYTES


def brute(batch):
    rows, out = batch.to_pylist(), []
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["row"])
    for r in rows:
        own = len(r["more"]) // module.WORD_BYTES
        near = [(x, shared(r["more"], x["more"])) for x in rows if x["g"] == r["g"]]
        smaller = max([n for x, n in near if key(x) < key(r)], default=0)
        other = max([n for x, n in near if {x["row"], x["low"], x["high"]} != {r["row"]}], default=0)
        out.append((own, smaller, other))
    return out


def random_rows(seed):
    rng = random.Random(seed)
    docs = [(None if rng.random() < 0.1 else rng.randint(1, 9), row) for row in range(rng.randint(1, 12))]
    out = []
    for _ in range(rng.randint(1, 60)):
        doc, row = rng.choice(docs)
        words = [rng.randint(1, 2) for _ in range(rng.choice([1, 2, 5, 24]))]
        out.append((rng.randint(-2, 2), words, doc, row, row, row + (rng.random() < 0.1)))
    return out


def test_reaches_of_all_pairs():
    for seed in range(200):
        batch = ends(random_rows(seed))
        assert [tuple(int(v) for v in x) for x in zip(*module.reaches(pa.Table.from_batches([batch])))] == brute(batch)


def test_groups_that_cross_batches():
    for seed in range(200):
        batch = ends(random_rows(seed))
        cuts = sorted(random.Random(seed).choices(range(len(batch) + 1), k=4))
        parts = [batch.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, len(batch)])]
        got = [tuple(r.values()) for b in module._reach_rows(iter(parts)) for r in b.to_pylist()]
        want = [(r["row"], r["run"], s, o) for r, (n, s, o) in zip(batch.to_pylist(), brute(batch)) if s < n]
        assert sorted(got) == sorted(want)


def test_equal_ends_of_a_task_fold_to_the_first_place():
    batch = ends([(1, [1, 2], 5, 50, 50, 50), (1, [1, 2], None, 70, 70, 70), (1, [1, 2], 4, 40, 40, 40), (1, [1, 3], 9, 90, 90, 90)])
    got = sorted(module._fold(pa.Table.from_batches([batch])).to_pylist(), key=lambda r: r["more"])
    assert [(r["doc_id"], r["row"], r["low"], r["high"]) for r in got] == [(None, 70, 40, 70), (9, 90, 90, 90)]
