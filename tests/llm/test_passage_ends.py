"""op3 finds verbatim stretches that sentences and lines do not bound."""

import random

import numpy as np

from flock.llm.substring_dedup import GRAM_WORDS, WINDOW, anchors, passages_of, repeated_passages

from .conftest import DOCS


def plain(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(words))


def found(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()], DOCS).repartition(3)
    out = {}
    for r in repeated_passages(df, **more).collect():
        raw = texts[r.doc_id].encode()
        out.setdefault(r.doc_id, []).append((raw[r.start:r.start + r.length].decode(), r.n_words, r.kept, r.keep_doc_id))
    return {k: sorted(v) for k, v in out.items()}


def test_stretches_inside_lines(spark):
    one, two, three = plain(1, 52), plain(2, 60).replace(" ", "。 "), plain(3, 50)
    texts = {1: plain(11, 40) + " " + one + " " + plain(12, 30), 2: plain(13, 7) + ", " + one + " " + plain(14, 90),
             3: "x. " + two + " " + plain(15, 20), 4: plain(16, 33) + "\n" + two + " y. " + plain(17, 9),
             5: three, 6: plain(18, 70) + " " + three, 7: plain(19, 300)}
    got = found(spark, texts)
    assert got == {1: [(one, 52, True, 1)], 2: [(one, 52, False, 1)], 3: [(two, 60, True, 3)], 4: [(two, 60, False, 3)],
                   5: [(three, 50, True, 5)], 6: [(three, 50, False, 5)]}


def test_ends_differ_by_document(spark):
    """The longer stretch of two documents is kept once where the first document has less of it."""
    core, left, right = plain(4, 60), plain(5, 15), plain(6, 40)
    texts = {1: plain(21, 50) + " " + core + " " + plain(22, 50), 2: plain(23, 50) + f" {left} {core} {right} " + plain(24, 50),
             3: plain(25, 50) + f" {left} {core} {right} " + plain(26, 50)}
    got = found(spark, texts)
    assert got[1] == [(core, 60, True, 1)]
    assert got[2] == sorted([(left, 15, True, 2), (core, 60, False, 1), (right, 40, True, 2)])
    assert [(x[0], x[1], x[2]) for x in got[3]] == [(f"{left} {core} {right}", 115, False)]


def test_runs_of_one_word(spark):
    texts = {1: plain(31, 30) + " " + " ".join(["la"] * 80), 2: " ".join(["la"] * 60) + " " + plain(32, 30)}
    got = found(spark, texts)
    assert all(x[2] for x in got[1]) and [(x[1], x[2]) for x in got[2]] == [(60, False)]


def test_shared_words_share_an_anchor():
    rng = np.random.default_rng(1)
    for _ in range(60):
        shared = rng.integers(1, 2**62, GRAM_WORDS + WINDOW - 1).astype(np.uint64)
        sides = [np.concatenate([rng.integers(1, 2**62, rng.integers(0, 40)).astype(np.uint64), shared,
                                 rng.integers(1, 2**62, rng.integers(0, 40)).astype(np.uint64)]) for _ in (0, 1)]
        both = anchors(np.concatenate(sides), np.array([0, len(sides[0]), len(sides[0]) + len(sides[1])]))
        ours = [set(both[1][(both[0] < len(sides[0])) == bool(k)].tolist()) for k in (0, 1)]
        assert ours[0] & ours[1]


def test_parts_of_a_passage():
    at = lambda w: (w * 10 - 1 << 32) + w * 10
    row = lambda a, b, kept, ordinal=-1: (a, b, at(a), at(b), kept, ordinal, a)
    got = passages_of([row(0, 50, True), row(20, 30, False), row(60, 70, True), row(75, 90, True, 4), row(95, 112, True, 5)], 30)
    assert sorted(x[:2] + x[4:5] for x in got) == [(0, 20, True), (20, 30, False), (30, 50, True), (75, 112, True)]
