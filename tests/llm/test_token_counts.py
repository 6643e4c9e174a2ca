"""Edits on a kept tree against encoding the edited text anew."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flock.llm import token_counts as tc
from flock.llm._bpe import default_ranks, encoder

from .conftest import rows

encode = encoder(default_ranks())
TEXT = st.text(alphabet=st.sampled_from(list("ab  \n\t'srevlmd1.!é中\xa0 \x1c")), max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 130), st.integers(0, 20), TEXT), max_size=4), st.sampled_from([3, 16]))
def test_edits_equal_reencoding(text, edits, leaf):
    old, tc.LEAF_CHARS = tc.LEAF_CHARS, leaf
    try:
        tree = tc.TokenTree(text, encode)
        for start, n, put in edits:
            start = min(start, len(tree.text))
            end = min(len(tree.text), start + n)
            want = tree.text[:start] + put + tree.text[end:]
            tree.edit(start, end, put)
            assert tree.text == want and tree.total == len(encode(want)) and tree.chars[1] == len(want)
    finally:
        tc.LEAF_CHARS = old


def test_long_text_reencodes_little():
    text = " ".join(random.Random(1).choice(["alpha", "beta", "gamma,"]) for _ in range(20_000))
    tree = tc.TokenTree(text, encode)
    tree.edit(50_000, 50_010, "edited words here")
    assert tree.total == len(encode(tree.text)) and tree.reencoded < 4 * tc.LEAF_CHARS
    with pytest.raises(ValueError):
        tree.edit(5, 10**9, "")


def test_counts_and_kept_trees(spark, docs, empty):
    secret = "mail me@x.org or 10.0.0.1, key 0123456789abcdef0123456789abcdef0 card 4785380592391139."
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, secret)], "doc_id long, text string"))
    got = {r.doc_id: r for r in tc.edited_token_counts(df).collect()}
    for i, text, *_ in rows():
        edits = tc.redactions(text or "")
        new = text or ""
        for a, b, put in reversed(edits):
            new = new[:a] + put + new[b:]
        assert (got[i].tokens_before, got[i].n_edits, got[i].tokens_after, got[i].chars_after) == (
            len(encode(text or "")), len(edits), len(encode(new)), len(new))
    assert got[50].n_edits == 4 and got[50].tokens_after < got[50].tokens_before
    trees = tc.token_trees(df)
    edits = spark.createDataFrame([(11, 5, 9, "xx"), (11, 1000, 1000, " more words "), (11, 1001, 1001, "!"), (8, 0, 3, None), (999, 0, 1, "x")],
                                  "doc_id long, start int, end int, put string")
    after = {r.doc_id: r for r in tc.apply_edits(trees, edits).collect()}
    assert after[11].n_edits == 3 and after[8].text == "" and after[8].n_tokens == 0
    assert all(r.n_tokens == len(encode(r.text)) for r in after.values())
    assert after[11].reencoded_chars < len(after[11].text) / 4
    assert tc.edited_token_counts(empty).count() == 0
