"""Every operator against a brute-force version on awkward rows, and on an empty table."""

import collections
import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from flock.llm import _words
from flock.llm._graph import components
from flock.llm.exact_dedup import exact_dedup
from flock.llm.jaccard_join import bands, jaccard_join, link_pairs, size_bands
from flock.llm.line_dedup import html_lines, line_dedup, page_line_dedup
from flock.llm.mixing import mix
from flock.llm.packing import best_fit_pack, pack_counts, piece_lengths
from flock.llm.quality import classify_quality, features
from flock.llm.sharding import shard_by_bytes
from flock.llm.substring_dedup import cut_passages, repeated_passages
from flock.llm.topk import exact_topk

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def shingles(text, width):
    w = WORD.findall(lower(text or ""))
    return frozenset([tuple(w[i:i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([tuple(w)] if w else []))


def key(t):
    return tuple((v is None, str(v)) for v in t)


def test_exact_dedup(docs, empty):
    texts = collections.defaultdict(list)
    for r in rows():
        texts[r[1] or ""].append(r[0])
    got = collections.defaultdict(list)
    for r in exact_dedup(docs, keep="max").collect():
        got[r.text_sha256].append(r)
    assert len(got) == len(texts)
    for text, ids in texts.items():
        g = got[sha256(text.encode()).hexdigest()]
        assert sorted(map(str, ids)) == sorted(str(x.doc_id) for x in g)
        assert {x.group_size for x in g} == {len(ids)} and sum(x.kept for x in g) == 1
        assert {x.keep_id for x in g} == {max((i for i in ids if i is not None), default=None)}
    low = {r.doc_id: r.keep_id for r in exact_dedup(docs).collect()}
    assert low[3] == 1 and low[6] == 5
    assert exact_dedup(empty).count() == 0


def test_line_dedup(spark, empty):
    pages = [(i, "h", f"menu\nown {i}\n\n  menu \nsome {i % 2}") for i in range(10)]
    pages += [(20, "h", None), (21, "h", ""), (22, None, "menu"), (23, "k", "menu"), (24, "h", "menu")]
    df = spark.createDataFrame(pages, "page long, host string, text string").selectExpr("*", "1 AS _bad", "'z' AS n_lines")
    got = {r.page: r for r in line_dedup(df, max_ratio=0.5, min_pages=3).collect()}
    assert [got[i].text for i in range(10)] == [f"own {i}\n\nsome {i % 2}" for i in range(10)]
    assert (got[3].n_lines, got[3].n_dropped) == (5, 2)
    assert (got[20].text, got[20].n_lines) == (None, 0) and (got[21].text, got[21].n_lines) == ("", 1)
    assert got[22].text == "menu" and got[23].text == "menu" and got[24].text == ""
    assert line_dedup(empty).count() == 0
    # outer blanks alone make lines equal, and a line's place in its page does not matter
    padded = spark.createDataFrame([(i, "h", f"own {i}\n all rights {i % 2} \nlast 2{i}") for i in range(20)], "page long, host string, text string")
    assert {r.page: r.text for r in line_dedup(padded).collect()} == {i: f"own {i}\nlast 2{i}" for i in range(20)}


def test_page_lines(spark):
    html = "<html><title>A&amp;B</title><script>var x='<p>';</script><!-- <p>no</p> --><p>one <b>two</b><br>three</p><style>p{}</style></html>"
    df = spark.createDataFrame([(1, "HTTPS://u@Ex.org:80/x", html), (2, None, None), (3, "nothing", "")], "page_id long, url string, html string")
    assert df.select(html_lines(df.html)).first()[0] == "A&B\none two\nthree"
    got = {r.page_id: r.host for r in page_line_dedup(df).collect()}
    assert got == {1: "ex.org", 2: None, 3: None}


def test_mix(docs, empty):
    got = mix(docs).collect()
    size = collections.Counter()
    for r in rows():
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        c = (total - sum(2 * size[s] for s in full)) / max(1e-300, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if s not in full and c * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    target = {s: float(2 * size[s]) if s in full else c * weight[s] for s in order}
    taken, most = collections.Counter(), collections.Counter()
    source = collections.defaultdict(set)
    for r in rows():
        source[r[0]].add(r[3])
    assert len(got) == len(rows())
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        s = next(x for x in source[r.doc_id] if size[x] == r.source_size)
        assert math.isclose(r.target, target[s], rel_tol=1e-12)
        taken[s] += r.taken
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in order)
    again = mix(docs.repartition(5)).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mix(empty).count() == 0


def test_shards(spark, docs, empty):
    got = shard_by_bytes(docs, 4).collect()
    assert len(got) == len(rows())
    want = sorted(((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows()))
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    slots, place, load = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        place[r.text_crc32].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in place.values())
    # the smallest capacity by trying every cut of the groups in their order, after groups too large for a share
    groups = collections.Counter()
    for r in rows():
        groups[r[1] or ""] += len((r[1] or "").encode()) + 1
    sizes = sorted(groups.values(), reverse=True)
    shards = 4
    while shards > 1 and sizes[0] * shards >= sum(sizes):
        sizes, shards = sizes[1:], shards - 1

    def needs(c):
        n, left = 1, c
        for s in sizes:
            n, left = (n, left - s) if s <= left else (n + 1, c - s)
        return n
    capacity = next(c for c in range(max(sizes), sum(sizes) + 1) if needs(c) <= shards)
    assert max(sorted(load.values(), reverse=True)[4 - shards:]) == capacity
    assert shard_by_bytes(empty).count() == 0


def test_jaccard_join(docs, empty):
    for width, percent in ((3, 90), (5, 80), (1, 50)):
        table = [(r[0], shingles(r[1], width)) for r in rows()]
        root = list(range(len(table)))
        for i, (_, a) in enumerate(table):
            for j, (_, b) in enumerate(table[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    x, y = root[i], root[j]
                    root = [y if r == x else r for r in root]
        low = {}
        for i, (doc, _) in enumerate(table):
            low[root[i]] = min(low.get(root[i], math.inf), math.inf if doc is None else doc)
        want = sorted((str(doc), len(s), str(low[root[i]] if low[root[i]] != math.inf else None)) for i, (doc, s) in enumerate(table))
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join(docs, width, percent).collect())
        assert got == want, (width, percent)
    assert jaccard_join(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_linked_sets_share_a_tile(percent):
    from flock.llm.jaccard_join import tile_keys

    rng = np.random.default_rng(percent)
    for n in [*range(2, 40), 97, 250, 1000]:
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(12):
            cut, add = rng.integers(0, n // 8 + 2), rng.integers(0, n // 8 + 2)
            b = np.concatenate([a[min(cut, n - 1):], rng.integers(0, 2**63, add).astype(np.uint64)])
            sets = [np.unique(a), np.unique(b)]
            both, union = len(np.intersect1d(*sets)), len(np.union1d(*sets))
            if 100 * both >= percent * union and both < union:
                rows_, tiles = tile_keys(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), percent)
                assert set(tiles[rows_ == 0].tolist()) & set(tiles[rows_ == 1].tolist()), (n, cut, add)


def test_links_across_chunks():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[i:], rng.integers(0, 2**63, i).astype(np.uint64)])) for i in range(8)]
    direct = {(i, j) for i in range(8) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 95 * len(np.union1d(sets[i], sets[j]))}
    sizes, at = np.array([len(x) for x in sets]), np.cumsum([0, *map(len, sets)])
    marks = _words.parity_bitmaps(np.concatenate(sets), at, 2048)
    halves = np.array([0, 0, 0, 0, 1, 1, 1, 1])
    found = link_pairs(sizes, marks, sets, None, 95) + link_pairs(sizes, marks, sets, halves, 95)
    passed = link_pairs(sizes, marks, None, None, 95)
    assert len(passed) >= len(link_pairs(sizes, marks, sets, None, 95))
    assert all((max(p), min(p)) in direct for p in found)
    root = list(range(8))
    for x, y in found:
        root = [root[x] if r == root[y] else r for r in root]
    assert all(root[i] == root[j] for i, j in direct)
    assert (bands(90)[:, 3] > bands(90)[:, 2]).sum() == (bands(90)[:, 2] > 0).sum()


def test_large_clusters_are_cut(docs, monkeypatch):
    """Chunks of a few bytes: every set meets the others across chunks and size bands."""
    from flock.llm import jaccard_join as module

    want = sorted(map(key, jaccard_join(docs, 1, 50).collect()))
    monkeypatch.setattr(module, "CHUNK_BYTES", 2500)
    assert sorted(map(key, jaccard_join(docs, 1, 50).collect())) == want
    lows = size_bands(80)
    for n in range(1, 400):
        band = sum(x <= n for x in lows)
        assert sum(x <= n * 100 // 80 for x in lows) <= band + 1


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in range(len(root)):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root


def test_word_hashes():
    import pyarrow as pa

    texts = ["A b  c\nA b", None, "", "a B", "\t", "x" * 5000 + " y", "a b c a b"]
    for _, data, offsets in _words.text_slices(pa.array(texts)):
        sets, at = _words.shingle_sets(data, offsets, 2)
        k1, k2 = _words.set_keys(sets, at)
        assert np.diff(at).tolist() == [len(shingles(t, 2)) for t in texts]
        assert (k1[0], k2[0]) == (k1[6], k2[6]) and k1[0] != k1[3] and k1[1] == k1[2] == k1[4] == 0


def test_passages(docs, empty):
    got = repeated_passages(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {1, 2, 3, 4, 12, 13} <= set(by) and set(by) <= {1, 2, 3, 4, 12, 13}
    assert [r.kept for r in by[1]] == [True] and [r.kept for r in by[12]] == [True] and not any(r.kept for r in by[13])
    assert {r.keep_doc_id for r in by[13]} == {12} and {r.keep_doc_id for r in by[3]} == {1}
    text = {r[0]: r[1] for r in rows()}
    for r in by[13]:
        span = text[13].encode()[r.start:r.start + r.length].decode()
        assert span in text[12] and len(span.split()) == r.n_words >= 30
    cut = {r.doc_id: r.text for r in cut_passages(docs, repeated_passages(docs)).collect()}
    assert cut[1] == text[1] and cut[3] == "" and cut[5] is None and len(cut[13]) < len(text[13])
    assert repeated_passages(empty).count() == 0


def test_pack_counts():
    rng = random.Random(2)
    for capacity in (10, 64, 2048):
        for _ in range(30):
            counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 60))}
            used, seen = collections.defaultdict(list), collections.Counter()
            for n, lo, hi, each, base, at in pack_counts(counts, capacity):
                for r in range(lo, hi):
                    used[base + (r - lo) // each].append((at + (r - lo) % each * n, n))
                seen[n] += hi - lo
            assert seen == counts
            for items in used.values():
                items.sort()
                assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(items[-1]) <= capacity
            bound = max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
            assert len(used) <= 1.5 * bound + 1
    assert piece_lengths(2048 * 2 + 5, 2048) == [5, 2048, 2048] and piece_lengths(1, 2048) == [1]


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = []
    for r in rows():
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        start = 0
        for i, n in enumerate(piece_lengths(len(ids), 2048)):
            want.append((r[0], i, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            start += n
    got = best_fit_pack(docs).collect()
    assert sorted(map(key, (r[:5] for r in got))) == sorted(map(key, want))
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for items in used.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(items[-1]) <= 2048
    assert best_fit_pack(empty).count() == 0


def test_topk(spark):
    rng = random.Random(8)
    vec = [(i, [rng.choice([-1.5, 0.0, 0.25, 0.5, 2.0]) for _ in range(6)]) for i in range(0, 700, 3)]
    vec += [(100, None), (200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (300, [float("nan")] * 6), (400, [float("inf")] * 6), (500, []), (None, [2.0] * 6),
            (600, [2.0] * 6), (600, [2.0] * 6), (700, [1.0, 2.0])]
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in vec if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (i, v) in enumerate(good):
        if i is not None and i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for m, (j, w) in enumerate(good) if m != n and len(w) == len(v))
            want += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(s[:10])]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>").selectExpr("*", "1 AS group", "2 AS row").repartition(3)
    got = [tuple(r) for r in exact_topk(df).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert exact_topk(df.limit(0)).count() == 0


def test_topk_prunes_exactly():
    from flock.llm.topk import scan

    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, (1500, 8)) + 400 * rng.integers(-1, 2, (1500, 1))
    ids, q = np.arange(1500), v[:40]
    for got, scores in zip(scan(q, ids[:40], np.full(40, -(1 << 62)), v, ids, ids, 5), q @ v.T):
        me = next(i for i in range(40) if (q[i] @ v.T == scores).all())
        order = [i for i in np.lexsort((ids, -scores)) if i != me][:5]
        assert got[0].tolist() == order and got[1].tolist() == scores[order].tolist()


def test_quality(spark, docs, empty):
    rng = random.Random(6)
    texts = [(i, (prose_bad if i % 4 == 0 else prose_good)(rng), "en", "a", 1) for i in range(300)]
    df = spark.createDataFrame(texts + rows(), "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    got = classify_quality(df, labels, per_class=60).collect()
    assert len(got) == 300 + len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    ids = {t[0]: t[1] for t in texts}
    held = [r for r in got if r.held_out and r.doc_id in ids]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    first = {r.doc_id: r for r in classify_quality(spark.createDataFrame(texts, df.schema), labels, per_class=60).collect()}
    assert sum(first[r.doc_id].predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)
    assert classify_quality(empty, labels, 60).count() == 0
    assert {r.score for r in classify_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert features(["", " "])[0].size == 0 and len(features(["ab"])[0]) == 1 + 2 + 1


def prose_good(rng):
    return " ".join(rng.choice(["the", "river", "flows", "under", "an", "old", "bridge"]) for _ in range(rng.randint(5, 60)))


def prose_bad(rng):
    return " ".join(rng.choice(["BUY!!", "CHEAP!!", "the", "NOW!!", "river"]) for _ in range(rng.randint(5, 60)))
