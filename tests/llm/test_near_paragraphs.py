"""op3 finds near-equal short lines, and near-equal sentences inside a line."""

import numpy as np
import pyarrow as pa
import pytest

from flock.llm import substring_dedup as module
from flock.llm._words import text_slices

from .test_passage_ends import found, plain


def test_listings_share_near_equal_lines(spark):
    rows = [plain(40 + i, 19) for i in range(10)]
    texts = {k: plain(60 + k, 30) + ".\n" + "\n".join(f"{r} day{k}{i}" for i, r in enumerate(rows)) + "\n" + plain(70 + k, 30) for k in (1, 2)}
    got = found(spark, texts)
    assert [x[1:] for x in got[1]] == [(200, True, 1)] and [x[1:] for x in got[2]] == [(200, False, 1)]


@pytest.mark.parametrize("words, report", [(60, 30), (20, 15)])
def test_sentence_with_a_changed_word(spark, words, report):
    body = plain(80, words - 1)
    texts = {k: f"{plain(81 + k, 12)}. first{k} {body}. {plain(91 + k, 14)}." for k in (1, 2)}
    got = found(spark, texts, passage_words=report)
    assert [x for x in got[1]] == [(f"first1 {body}.", words, True, 1)] and [x[1:] for x in got[2]] == [(words, False, 1)]


def test_line_and_its_sentence_both_stay_in_the_first_place(spark):
    body = plain(100, 58)
    texts = {1: f"{plain(101, 9)}\n{body} here. So it is.\n{plain(102, 9)}", 2: f"{plain(103, 9)}\n{body} there.\n{plain(104, 9)}"}
    got = found(spark, texts)
    assert all(x[2] for x in got[1]) and not any(x[2] for x in got[2])


@pytest.mark.parametrize("n", [8, 20, 43, 44, 48, 53, 54, 60])
def test_every_length_meets(n):
    """A paragraph and one with a word more at its end: both sides of TILED and BANDED."""
    text = plain(110 + n, n)
    keys = []
    for t in (text, text + " more"):
        batches = list(module._band_rows(iter([pa.record_batch([pa.array([t])], ["text"])])))
        keys.append({x for b in batches for x in b.column(0).to_pylist()})
    assert keys[0] & keys[1]
    for _, data, offsets in text_slices(pa.array([text, "a b. " + text + "\n" + text, ""])):
        sets, at, owner, line, ordinal = module._paragraphs(data, offsets)
        assert owner.tolist() == sorted(owner.tolist()) or np.all(owner >= 0)
        assert (owner.tolist()[0], line.tolist()[0], ordinal.tolist()[0]) == (0, 0, -1)
