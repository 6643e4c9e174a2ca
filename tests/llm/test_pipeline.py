"""The whole pipeline against plain Python on a small corpus, and on empty tables."""

import collections
import math
import random
import zlib
from hashlib import md5

import numpy as np

import corpus_pipeline
from flock.llm.packing import piece_lengths
from flock.llm.quality import features, train_quality

from .conftest import DOCS, rows
from .test_operators import WORD, key, prose_bad, prose_good, shingles

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = random.Random(11)
    out = rows()
    for i in range(1000, 1120):
        text = (prose_bad if i % 4 == 0 else prose_good)(rng)
        if i % 3 == 0:
            text += "\n all rights reserved \nlast " + str(i)
        out.append((i, text, "en", "ab"[i % 2], 7))
    long = " ".join(f"the river{j} flows" for j in range(60))
    return out + [(1200, long, "en", "c", 1), (1201, long + " on", "en", "c", 1), (1201, long + " on", "en", "c", 1), (1202, long, None, None, None)]


def kept_by_quality(docs, model):
    table, offset = model
    for d in docs:
        bucket = features([d[1] or ""])[1]
        z = (table[bucket].sum() / len(bucket) if len(bucket) else 0.0) + offset
        if 1 / (1 + math.exp(-z)) >= 0.5:
            yield d


def less_lines(docs):
    pages, seen = collections.Counter(), collections.Counter()
    for d in docs:
        pages[d[3]] += 1
        seen.update((d[3], x) for x in {y.strip(" ") for y in (d[1] or "").split("\n")} if x)
    bad = {k for k, c in seen.items() if k[0] is not None and c >= 5 and c > 0.1 * pages[k[0]]}
    for d in docs:
        text = d[1] if d[1] is None else "\n".join(x for x in d[1].split("\n") if (d[3], x.strip(" ")) not in bad)
        yield (d[0], text, d[2], d[3])


def row_key(d):
    return (d[0] is not None, d[0] or 0, md5((d[1] or "").encode()).hexdigest())


def one_of_each(docs):
    sets, group = [shingles(d[1], 5) for d in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    best = {}
    for i, d in enumerate(docs):
        if not sets[i]:
            yield d
        elif group[i] not in best or row_key(d) < row_key(best[group[i]]):
            best[group[i]] = d
    yield from best.values()


def mixed(docs):
    size = collections.Counter()
    for d in docs:
        size[d[3]] += len(WORD.findall(d[1] or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, full, total = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, set(), 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in full)) / max(1e-300, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in order:
        rate = (2.0 if s in full else level * weight[s] / size[s]) if size[s] else 0.0
        base, so_far = math.floor(rate + 1e-9), 0
        name = lambda d: md5(f"{{{'null' if d[0] is None else d[0]}, {row_key(d)[2]}}}".encode()).hexdigest()
        for d in sorted((d for d in docs if d[3] == s), key=name):
            n = len(WORD.findall(d[1] or ""))
            so_far += n
            yield from [d] * (base + (n > 0 and so_far - n / 2 <= max(0.0, (rate - base) * size[s])))


def pieces(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in docs:
        ids, start = np.array([*tok.encode(d[1] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for i, n in enumerate(piece_lengths(len(ids), 2048)):
            yield (d[0], i, start, n, zlib.crc32(ids[start:start + n].tobytes()))
            start += n


def write(df, path):
    df.write.parquet(str(path))


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), DOCS).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(1000, 1120)], LABELS)
    write(docs, tmp_path / "documents.parquet")
    write(labels, tmp_path / "labels.parquet")
    good = list(kept_by_quality(corpus(), train_quality(docs, labels)))
    lines = list(less_lines(good))
    alone = list(one_of_each(lines))
    assert 0 < len(alone) < len(lines) < len(corpus()) and any(a[1] != b[1] for a, b in zip(good, lines))
    want = list(pieces(mixed(alone)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(key, (r[:5] for r in got))) == sorted(map(key, want))
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for items in used.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(items[-1]) <= 2048


def test_empty_pipeline(spark, tmp_path):
    write(spark.createDataFrame([], DOCS), tmp_path / "documents.parquet")
    write(spark.createDataFrame([], LABELS), tmp_path / "labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
