"""Operator 2, token counts that follow edits.

A document keeps a segment tree over runs of pre-tokens: a leaf holds the
characters and tokens of its run, an inner node the sums of its two children.
An edit finds its leaves by the character sums, re-encodes the text between the
nearest leaf bounds that it leaves standing, and updates the sums on the path.

Leaf bounds stand where a white space character follows another character.
There every pattern of the tokenizer ends a pre-token and starts the next, so
the runs on both sides encode alone as they do in the whole text.  A bound
depends on these two characters only: an edit that leaves both in place leaves
the bound valid.  They are the boundary context.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import default_ranks, encoder

#: Characters of a leaf, about; a leaf that grows past four times that is split.
LEAF_CHARS = 512
Edit = tuple[int, int, str]
#: What the redaction edits of ``redactions`` match, and put in place.
REDACTED = [(re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "<email>"),
            (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "<ip>"),
            (re.compile(r"\b[0-9a-f]{32,}\b"), "<key>"),
            (re.compile(r"\b\d{13,19}\b"), "<number>")]


def redactions(text: str) -> list[Edit]:
    """Edits that mask addresses, keys and long numbers: (start, end, replacement), apart and in order."""
    found = sorted((m.start(), m.end(), put) for pattern, put in REDACTED for m in pattern.finditer(text))
    out: list[Edit] = []
    for edit in found:
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def cut_runs(text: str, size: int) -> list[str]:
    """``text`` cut at bounds, in runs of ``size`` characters or more."""
    runs, start, at = [], 0, size
    while at < len(text):
        if text[at] in " \n\t" and not text[at - 1].isspace():
            runs.append(text[start:at])
            start, at = at, at + size
        else:
            at += 1
    return [*runs, text[start:]] if start < len(text) else runs


class TokenTree:
    """Segment tree of one text.  ``chars`` and ``tokens`` are heaps: node i has children 2i and 2i + 1."""

    def __init__(self, text: str, encode: Callable[[str], list[int]], chars: list[int] | None = None, tokens: list[int] | None = None):
        self.text, self.encode, self.reencoded = text, encode, 0
        if chars is None:
            runs = cut_runs(text, LEAF_CHARS)
            self._build([len(r) for r in runs], [len(encode(r)) for r in runs])
        else:
            self.chars, self.tokens, self.width = list(chars), list(tokens), len(chars) // 2

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        pad = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars + pad, [0] * self.width + tokens + pad
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos`` (the last one for the end of the text) and its start."""
        i, start = 1, 0
        pos = max(0, min(pos, len(self.text) - 1))
        while i < self.width:
            i *= 2
            if pos >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i, start

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace characters [start, end) by ``put``."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError(f"edit [{start}, {end}) lies outside a text of {len(self.text)} characters")
        first, low = self.leaf_at(start)
        if low > 0 and start <= low:  # the character before the bound stays, the one after it does not
            first, low = self.leaf_at(low - 1)
        last, at = self.leaf_at(max(start, end - 1))
        high = at + self.chars[last]
        while high < len(self.text) and end >= high:
            last, at = self.leaf_at(high)
            high = at + self.chars[last]
        run = self.text[low:start] + put + self.text[end:high]
        self.text = self.text[:start] + put + self.text[end:]
        self.reencoded += len(run)
        if len(run) > 4 * LEAF_CHARS:  # more leaves: the other leaves keep their counts
            runs = cut_runs(run, LEAF_CHARS)
            side = [(self.chars[i], self.tokens[i]) for i in range(self.width, 2 * self.width)]
            a, b = first - self.width, last - self.width + 1
            leaves = [x for x in side[:a] if x[0]] + [(len(r), len(self.encode(r))) for r in runs] + [x for x in side[b:] if x[0]]
            self._build([x[0] for x in leaves], [x[1] for x in leaves])
            return
        for i in range(first, last + 1):
            self.chars[i] = self.tokens[i] = 0
        self.chars[first], self.tokens[first] = len(run), len(self.encode(run))
        a, b = first // 2, last // 2
        while a >= 1:
            for i in range(a, b + 1):
                self._sum(i)
            a, b = a // 2, b // 2

    def edit_all(self, edits: list[Edit]) -> int:
        """Apply edits whose places refer to the text as it is now, from the last to the
        first; one that overlaps the next is left out.  The number applied."""
        done, bound = 0, len(self.text) + 1
        for start, end, put in sorted(edits, reverse=True):
            if end <= bound and (start, end) != (bound, bound):
                self.edit(start, end, put)
                done, bound = done + 1, start
        return done


_TREE = "chars array<int>, tokens array<int>"


def _tree_rows(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        for batch in batches:
            trees = [TokenTree(t or "", encode) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.chars for t in trees], pa.list_(pa.int32())),
                                              pa.array([t.tokens for t in trees], pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "chars", "tokens"])
    return run


def token_trees(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, text, chars, tokens): the tree of every document, to be kept with it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_tree_rows(ranks or default_ranks()), f"doc_id {kind}, text string, {_TREE}")


def _edited_rows(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        for batch in batches:
            d, trees, done = batch.to_pydict(), [], []
            for text, chars, tokens, edits in zip(d["text"], d["chars"], d["tokens"], d["edits"]):
                tree = TokenTree(text or "", encode, chars, tokens)
                done.append(tree.edit_all([(e["start"], e["end"], e["put"] or "") for e in edits or []]))
                trees.append(tree)
            yield pa.record_batch([batch.column("doc_id"), pa.array([t.text for t in trees], pa.string()),
                                   pa.array([t.chars for t in trees], pa.list_(pa.int32())), pa.array([t.tokens for t in trees], pa.list_(pa.int32())),
                                   pa.array([t.total for t in trees], pa.int64()), pa.array(done, pa.int32()),
                                   pa.array([t.reencoded for t in trees], pa.int64())],
                                  ["doc_id", "text", "chars", "tokens", "n_tokens", "n_edits", "reencoded_chars"])
    return run


def apply_edits(trees: DataFrame, edits: DataFrame, ranks: str | None = None) -> DataFrame:
    """Kept trees after a table of edits (doc_id, start, end, put): doc_id, text, chars,
    tokens, n_tokens, n_edits, reencoded_chars.

    Places count characters of the kept text.  Of edits that overlap, the later
    one wins.  Rows that share a doc_id all get its edits.  Documents without
    edits pass through; edits of unknown or null ids do nothing.
    """
    kind = trees.schema["doc_id"].dataType.simpleString()
    grouped = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "put")).alias("edits"))  # a document's own
    return trees.select("doc_id", "text", "chars", "tokens").join(grouped, "doc_id", "left").mapInArrow(
        _edited_rows(ranks or default_ranks()),
        f"doc_id {kind}, text string, {_TREE}, n_tokens long, n_edits int, reencoded_chars long")


def _count_rows(ranks: str, find: Callable[[str], list[Edit]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                tree = TokenTree(text or "", encode)
                before = tree.total
                done = tree.edit_all(find(tree.text))
                rows.append((before, done, tree.total, len(tree.text), tree.reencoded))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]],
                                  ["doc_id", "tokens_before", "n_edits", "tokens_after", "chars_after", "reencoded_chars"])
    return run


def edited_token_counts(docs: DataFrame, find: Callable[[str], list[Edit]] = redactions, ranks: str | None = None) -> DataFrame:
    """Token counts of every document before and after the edits that ``find`` gives for
    its text (by default: redaction): doc_id, tokens_before, n_edits, tokens_after,
    chars_after, reencoded_chars.

    Only reencoded_chars characters are encoded again.  A null text counts as
    empty (0 tokens).  Repeated rows give a row each; other columns are not
    read.  One pass over whole texts, no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _count_rows(ranks or default_ranks(), find),
        f"doc_id {kind}, tokens_before long, n_edits long, tokens_after long, chars_after long, reencoded_chars long")
