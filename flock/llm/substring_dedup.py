"""Operator 3, substring dedup: passages that repeat across documents.

Paragraphs come at two grains, lines and the sentences of a line.  Those of
NEAR_WORDS words or more are sets of five-word shingles; large sets get MinHash
signatures cut into bands tuned for high recall, small ones the tiles of
operator 10, which lose no pair.  Paragraphs that collide are joined, verified by
exact Jaccard, and clustered by connected components.  Equal sentences, shorter
ones too, are one cluster.

Verbatim stretches need no paragraphs.  Of every WINDOW neighbouring runs of
GRAM_WORDS words the one with the smallest hash is an anchor, wherever it
stands, so two texts that share GRAM_WORDS + WINDOW - 1 words in a row share an
anchor, and the anchors of a stretch leave no word between them.  Only its ends
remain: there the words beyond the anchors are sorted, and neighbours in that order
tell how far each anchor's run goes on in another document too.

Each cluster keeps its first paragraph, each run of words its first document;
the others are removals.  Neighbouring repeated sentences and stretches form a
passage, and passages that are long enough are reported and can be cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import intermediates, materialize, release
from ._util import BROADCAST_BYTES, hint_if_small, unused
from ._words import U, _ranges, mix, set_keys, sets_of_spans, span_hashes, text_slices, word_spans
from .jaccard_join import ARRAYS, array_batch, resolve, tile_keys

WIDTH, PERCENT = 5, 80
#: Recall of a pair at 0.8: 1 - (1 - 0.8**5)**16 = 99.8 %, at 0.85 99.99 %.
BANDS, BAND_ROWS = 16, 5
#: Words of a paragraph compared by its shingles (fewer have no room for a changed one at
#: 0.8), and of a sentence that counts alone.
NEAR_WORDS, SENTENCE_WORDS = 8, 5
#: Sets of fewer shingles than the first get tiles, sets of as many as the second bands:
#: two linked sets have tiles both or bands both.
TILED, BANDED = 50, 40
#: Words of a reported passage.  A passage loses the sentences that it shares with
#: its surroundings at both ends, so this is well under the 50 words aimed at.
PASSAGE_WORDS = 30
#: Words of shorter sentences that may stand between two sentences of a passage: two sentences' worth.
GAP_WORDS = 2 * (SENTENCE_WORDS - 1)
#: Words of an anchor, and runs of words of which one is an anchor (no more than the words).
GRAM_WORDS, WINDOW = 25, 25
#: Bytes of a word's hash where words beyond an anchor are compared (the anchors are equal by 64 bits),
#: and ends that a task holds at once to fold equal ones.
WORD_BYTES, FOLD_ROWS = 6, 100_000
#: Bytes of a tile's hash that travel (a false meeting is compared like a true one), tiles worked on at once, and
#: paragraphs whose tiles go to one task.
TILE_BYTES, PACKED, TASK_PARAGRAPHS = 6, 1 << 18, 50_000
ENDS = ["g", "run", "more", "doc_id", "row", "low", "high"]
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_LOW = 0xFFFFFFFF
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_CLOSE = np.isin(np.arange(256), [ord(c) for c in "\"')]"])
_FACTORS = mix(np.arange(BANDS * BAND_ROWS, dtype=U), 61) | U(1)


def line_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word is the last of its line."""
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.zeros(len(starts), bool)
    last[:-1] = breaks[starts[1:]] > breaks[ends[:-1]]
    last[first[1:][np.diff(first) > 0] - 1] = True
    return last


def _parts(last: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each part (and the end), and each part's text; parts end where ``last`` is set."""
    bounds = np.concatenate([[0], np.flatnonzero(last) + 1])
    return bounds, np.searchsorted(first, bounds[:-1], "right") - 1


def _sentences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """First words of the sentences (and the end), their texts, their lines, and the ordinals of those that count alone."""
    lines = line_ends(data, starts, ends, first)
    tail = data[ends - 1]
    stop = _STOP[tail] | (_CLOSE[tail] & _STOP[data[np.maximum(ends - 2, starts)]])
    # a full stop ends a sentence unless another stands in the four words before it:
    # a rule that looks at near words only cuts a passage alike wherever it stands
    at = np.arange(len(starts))
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(lines | stop, at, -1))[:-1]])  # a text starts like a line
    bounds, owner = _parts(lines | (stop & (at - before >= SENTENCE_WORDS)), first)
    line = np.concatenate([[0], np.cumsum(lines)])[bounds[:-1]]
    alone = np.concatenate([[0], np.cumsum(np.diff(bounds) >= SENTENCE_WORDS)])[:-1]
    head = np.searchsorted(owner, owner)
    return bounds, owner, line - line[head], alone - alone[head]


def _paragraph_sets(words: np.ndarray, bounds: np.ndarray, owner: np.ndarray, line: np.ndarray):
    """Sets of the lines of NEAR_WORDS words or more, and of such sentences that are less than a
    line: sets, offsets, the first sentence of each, and whether it is a line."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    head = np.flatnonzero(new)
    parts = np.diff(np.append(head, len(owner)))
    low = np.concatenate([bounds[head], bounds[:-1]])
    n = np.concatenate([np.diff(np.append(bounds[head], bounds[-1])), np.where(np.repeat(parts, parts) > 1, np.diff(bounds), 0)])
    pick = np.flatnonzero(n >= NEAR_WORDS)
    sets, at = sets_of_spans(words, low[pick], n[pick], WIDTH)
    return sets, at, np.concatenate([head, np.arange(len(owner))])[pick], pick < len(head)


def _paragraphs(data: np.ndarray, offsets: np.ndarray):
    """The paragraphs: sets, offsets, text index, line number, ordinal of the sentence (-1 for a line)."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(1, np.int64), none, none, none
    bounds, owner, line, ordinal = _sentences(data, starts, ends, first)
    sets, at, of, whole = _paragraph_sets(span_hashes(data, starts, ends), bounds, owner, line)
    return sets, at, owner[of], line[of], np.where(whole, -1, ordinal[of])


PARTS = "row long, line int, ordinal int, word int, word_end int, lo long, hi long, k1 long, k2 long, p1 long, p2 long"


def _sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences that count alone: their places, keys (k1, k2) and, if they are paragraphs, the keys of their
    sets (p1, p2); and lines that are paragraphs, without a place or keys and of ordinal -1."""
    for batch in batches:
        for a, data, offsets in text_slices(batch.column(2)):
            starts, ends, first = word_spans(data, offsets)
            if not len(starts):
                continue
            bounds, owner, line, ordinal = _sentences(data, starts, ends, first)
            # a sentence is the sequence of its words: a polynomial of their hashes, twice
            words = span_hashes(data, starts, ends)
            pick = np.flatnonzero(np.diff(bounds) >= SENTENCE_WORDS)
            sets, at, of, whole = _paragraph_sets(words, bounds, owner, line)
            lines, place = of[whole], np.searchsorted(pick, of[~whole])
            sentence = np.arange(len(pick) + len(lines)) < len(pick)
            near = ~sentence
            near[place] = True
            keys = []
            for k in set_keys(sets, at):
                key = np.concatenate([np.zeros(len(pick), U), k[whole]])
                key[place] = k[~whole]
                keys.append(key.view(np.int64))
            rows = np.concatenate([owner[pick], owner[lines]])
            low, high = (np.concatenate([bounds[pick + i], np.zeros(len(lines), np.int64)]) for i in (0, 1))
            word0 = np.where(sentence, first[rows], 0)
            ints = [np.concatenate([line[pick], line[lines]]), np.where(sentence, np.concatenate([ordinal[pick], lines]), -1)]
            text = pa.array(rows + a)
            of_sentence = [*[(x - word0).astype(np.int32) for x in (low, high)], *_bounds(starts, ends, offsets, rows, low, high),
                           *[np.concatenate([_sequences(words, base)(bounds[pick], bounds[pick + 1]).view(np.int64), np.zeros(len(lines), np.int64)]) for base in _BASES]]
            yield pa.record_batch([batch.column(0).take(text), batch.column(1).take(text), *[pa.array(x.astype(np.int32)) for x in ints],
                                   *[pa.array(x, mask=~sentence) for x in of_sentence], *[pa.array(x, mask=~near) for x in keys]],
                                  ["doc_id", *[c.split()[0] for c in PARTS.split(", ")]])


def meeting_keys(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, tile) for every tile of the small sets and every band of the large ones."""
    small = np.flatnonzero(np.diff(at) < TILED)
    n = np.diff(at)[small]
    which, tile = tile_keys(sets[_ranges(at[small], n)], np.concatenate([[0], np.cumsum(n)]), PERCENT)
    which, tiles = [small[which]], [tile]
    rows = np.flatnonzero(np.diff(at) >= BANDED)
    if len(rows):
        n = np.diff(at)[rows]
        members, begin = sets[_ranges(at[rows], n)], np.concatenate([[0], np.cumsum(n)[:-1]])
        for band in range(BANDS):
            key = np.full(len(rows), band, U)
            for factor in _FACTORS[band * BAND_ROWS:(band + 1) * BAND_ROWS]:
                key = mix(key, 62) + np.minimum.reduceat(members * factor, begin)
            which.append(rows)
            tiles.append(mix(key, 63))
    return np.concatenate(which), np.concatenate(tiles)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, recent = np.zeros(0, U), np.zeros(0, U)  # copies in one task make their bands once
    for batch in batches:
        for _, data, offsets in text_slices(batch.column(0)):
            sets, at, *_ = _paragraphs(data, offsets)
            k1, k2 = set_keys(sets, at)
            key, rows = np.unique(mix(k1, 71) + k2, return_index=True)
            new = ~(_has(known, key) | _has(recent, key))
            rows = np.sort(rows[new])
            recent = np.sort(np.concatenate([recent, key[new]]))
            if len(recent) > 20_000:
                known, recent = np.sort(np.concatenate([known, recent])), recent[:0]
            if len(known) > 300_000:
                known = known[:0]
            if not len(rows):
                continue
            n = np.diff(at)[rows]
            which, tile = meeting_keys(sets[_ranges(at[rows], n)], np.concatenate([[0], np.cumsum(n)]))
            yield pa.record_batch([pa.array(tile.view(np.int64)), pa.array(k1[rows[which]].view(np.int64))], ["tile", "k1"])


def _has(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is among the sorted ones."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def _packed_rows(buckets: int):
    """The rows of ``_band_rows``, PACKED at a time, as bytes: for each bucket the tiles in ascending order (TILE_BYTES
    each, byte by byte: the first ones hardly change and compress) and the keys."""
    def pack(tile: np.ndarray, k1: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(tile)
        tile, k1 = tile[order], k1[order]
        bucket = (tile >> U(32)) * U(buckets) >> U(32)
        heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(heads[1:], len(tile))
        raw = tile.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TILE_BYTES]
        data = [raw[a:b].T.tobytes() + k1[a:b].tobytes() for a, b in zip(heads.tolist(), ends.tolist())]
        return pa.record_batch([pa.array(bucket[heads].astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, rows = [], 0
        for batch in _band_rows(batches):
            pending.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows >= PACKED:
                yield pack(*(np.concatenate(c) for c in zip(*[(t.view(U), k) for t, k in pending])))
                pending, rows = [], 0
        if rows:
            yield pack(*(np.concatenate(c) for c in zip(*[(t.view(U), k) for t, k in pending])))
    return run


def meet(tile: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tiles, the smallest key of each, and the distinct pairs of such a key with the others of its tile."""
    order = np.argsort(tile)
    tile, k1 = tile[order], k1[order]
    new = np.concatenate([[True], tile[1:] != tile[:-1]])
    heads = np.flatnonzero(new)
    low = np.minimum.reduceat(k1, heads)
    a = low[np.cumsum(new) - 1]
    a, b = a[a != k1], k1[a != k1]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return tile[heads], low, a[new], b[new]


def _meeting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of keys that share a tile; each tile's keys are connected.  Tiles met are one row each, however many have them."""
    known, pending, rows = (np.zeros(0, U), np.zeros(0, np.int64)), [], 0

    def work() -> Iterator[pa.RecordBatch]:
        nonlocal known, pending, rows
        tile, low, a, b = meet(*(np.concatenate(c) for c in zip(known, *pending)))
        known, pending, rows = (tile, low), [], 0
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        for raw in batch.column(1):
            raw = np.frombuffer(raw.as_buffer(), np.uint8)
            n = len(raw) // (TILE_BYTES + 8)
            tile = np.zeros((n, 8), np.uint8)
            tile[:, :TILE_BYTES] = raw[:TILE_BYTES * n].reshape(TILE_BYTES, n).T
            pending.append((tile.view(">u8").ravel().astype(U), raw[TILE_BYTES * n:].copy().view(np.int64)))
            rows += n
            if rows >= max(PACKED, len(known[0])):
                yield from work()
    if rows:
        yield from work()


def _meetings(texts: DataFrame, paragraphs: int) -> DataFrame:
    """(a, b): the paragraphs' keys that share a tile or a band, connected.  ``texts``: the column text."""
    least = -(-paragraphs // TASK_PARAGRAPHS)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * max(least, parts)
    packed = texts.mapInArrow(_packed_rows(buckets), "bucket int, pairs binary")
    dealt = packed.repartition(least, "bucket") if least > parts else packed.repartition("bucket")
    return dealt.mapInArrow(_meeting_rows, "a long, b long").distinct()


def _array_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of those paragraphs of each text whose first key its list has, equal ones of some texts once."""
    for batch in batches:
        for a, data, offsets in text_slices(batch.column(0)):
            sets, at, owner, *_ = _paragraphs(data, offsets)
            k1, k2 = set_keys(sets, at)
            lists = batch.column(1).slice(a, len(offsets) - 1)
            text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            wanted = mix(mix(text.astype(U), 69) + lists.flatten().to_numpy(zero_copy_only=False).view(U), 70)
            pick = np.flatnonzero(np.isin(mix(mix(owner.astype(U), 69) + k1, 70), wanted))
            if not len(pick):
                continue
            pick = pick[np.unique(np.stack([k1[pick], k2[pick]], 1), axis=0, return_index=True)[1]]
            n = np.diff(at)[pick]
            yield array_batch(sets[_ranges(at[pick], n)], np.concatenate([[0], np.cumsum(n)]))


def _sequences(words: np.ndarray, base: int):
    """(a, b) -> keys of the sequences of words from a to b: polynomials of the words' hashes."""
    up = np.cumprod(np.full(len(words) + 1, base, U))
    down = np.cumprod(np.full(len(words) + 1, pow(base, -1, 1 << 64), U))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(words, base & 255) * up[:-1])])
    return lambda a, b: mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U), 64)


def _bounds(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The places in the text in front of the words a and b (b may be the end): the byte
    where the word before ends and, in the low half, the byte where the word starts."""
    base, top = offsets[owner], offsets[owner + 1]
    ends, starts = np.concatenate([[0], ends]), np.concatenate([starts, [offsets[-1]]])
    return [(np.maximum(ends[w], base) - base << 32) + (np.minimum(starts[w], top) - base) for w in (a, b)]


def _windows(least_or_most, x: np.ndarray, width: int) -> np.ndarray:
    """np.minimum or np.maximum over x[i:i + width], for each i that has as many."""
    span = 1
    while 2 * span <= width:
        x = least_or_most(x[:-span], x[span:])
        span *= 2
    return x if span == width else least_or_most(x[:span - width], x[width - span:])


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words at which anchors start, and the anchors' keys."""
    reach = GRAM_WORDS + WINDOW - 1
    if len(words) < reach:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(len(words) - GRAM_WORDS + 1)
    keys = _sequences(words, _BASES[0])(at, at + GRAM_WORDS)
    low = _windows(np.minimum, keys, WINDOW)
    low[np.arange(len(low)) + reach > np.repeat(first[1:], np.diff(first))[:len(low)]] = 0  # not in one text
    none = np.zeros(WINDOW - 1, U)
    low = _windows(np.maximum, np.concatenate([none, low, none]), WINDOW)
    at = np.flatnonzero((low == keys) & (low > 0))
    return at, keys[at]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, data, offsets in text_slices(batch.column(2)):
            starts, ends, first = word_spans(data, offsets)
            at, keys = anchors(span_hashes(data, starts, ends), first)
            owner = np.searchsorted(first, at, "right") - 1
            rows = pa.array(owner + a)
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - first[owner]).astype(np.int32)),
                                   *[pa.array(x) for x in _bounds(starts, ends, offsets, owner, at, at + GRAM_WORDS)], pa.array(keys.view(np.int64))],
                                  ["doc_id", "row", "word", "lo", "hi", "key"])


def _ends(data: np.ndarray, offsets: np.ndarray, lists: pa.Array):
    """The ends of anchors that may go on (``lists``: each text's, twice their word and one more to the right), with the runs of words that are
    as much longer as the text allows, WINDOW - 1 words at most: text index, first word of the anchor, whether to the right,
    words to go, key of the longest run, and the arrays of the texts' words."""
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    spot = lists.flatten().to_numpy(zero_copy_only=False)
    word, right = (spot >> 1) + first[owner], (spot & 1).astype(bool)
    n = np.clip(np.where(right, first[owner + 1] - word - GRAM_WORDS, word - first[owner]), 0, WINDOW - 1)
    some = n > 0
    owner, word, right, n = owner[some], word[some], right[some], n[some]
    keys = _sequences(words, _BASES[1])(word - np.where(right, 0, n), word + GRAM_WORDS + np.where(right, n, 0))
    return owner, word, right, n, mix(keys + right.astype(U), 65), (starts, ends, first, words)


def _fold(table: pa.Table) -> pa.Table:
    """One row for each longest run: its first place, and the least and the largest ``row`` that have it."""
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("row", "ascending")], null_placement="at_start"))
    run, low, high = (table.column(c).to_numpy() for c in ("run", "low", "high"))
    order = np.argsort(run, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], run[order][1:] != run[order][:-1]]))
    out = table.select(["g", "run", "more", "doc_id", "row"]).take(pa.array(order[heads]))
    return out.append_column("low", pa.array(np.minimum.reduceat(low[order], heads))).append_column("high", pa.array(np.maximum.reduceat(high[order], heads)))


def _end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words beyond each end, nearest first, WORD_BYTES each.  ``g``: the anchor, the side and the nearest word."""
    pending, rows = [], 0
    for batch in batches:
        for a, data, offsets in text_slices(batch.column(2)):
            owner, word, right, n, run, (_, _, _, words) = _ends(data, offsets, batch.column(3).slice(a, len(offsets) - 1))
            if not len(owner):
                continue
            step = np.arange(WINDOW - 1)
            at = np.where(right, word + GRAM_WORDS, word - 1)[:, None] + np.where(right, 1, -1)[:, None] * step
            inside = step < n[:, None]
            beyond = mix(words, 66)[np.where(inside, at, 0)] >> U(64 - 8 * WORD_BYTES)
            raw = beyond.astype(">u8").view(np.uint8).reshape(len(n), WINDOW - 1, 8)[:, :, 8 - WORD_BYTES:][inside]
            cuts = np.concatenate([[0], np.cumsum(n * WORD_BYTES)]).astype(np.int32)
            more = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw))])
            anchor = _sequences(words, _BASES[0])(word, word + GRAM_WORDS)
            g = mix(mix(anchor + right.astype(U), 67) + beyond[:, 0], 68)
            place = pa.array(owner + a)
            row = batch.column(1).take(place)
            pending.append(pa.table([pa.array(g.view(np.int64)), pa.array(run.view(np.int64)), more, batch.column(0).take(place), row, row, row], ENDS))
            rows += len(n)
            if rows > FOLD_ROWS:  # copies in one task are one row
                pending = [_fold(pa.concat_tables(pending))]
                rows = len(pending[0])
                if 2 * rows > FOLD_ROWS:
                    yield from pending[0].combine_chunks().to_batches()
                    pending, rows = [], 0
    if pending:
        yield from _fold(pa.concat_tables(pending)).combine_chunks().to_batches()


def reaches(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ENDS, sorted by (g, more): its words, how many of them a smaller place has too, and how many any other
    row has.  Rows that share their first m words are neighbours, so each m takes a minimum over runs of rows."""
    more = pa.concat_arrays(table.column("more").chunks).cast(pa.large_binary())
    bounds = np.frombuffer(more.buffers()[1], np.int64)[more.offset:more.offset + len(more) + 1]
    n = np.diff(bounds) // WORD_BYTES
    g, row, low, high = (table.column(c).to_numpy() for c in ("g", "row", "low", "high"))
    width = (WINDOW - 1) * WORD_BYTES
    words = np.zeros((len(n), width), np.uint8)
    words[np.arange(width) < (n * WORD_BYTES)[:, None]] = np.frombuffer(more.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    same = (words[1:] == words[:-1]).reshape(len(n) - 1, WINDOW - 1, WORD_BYTES).all(2)
    shared = np.where(same.all(1), WINDOW - 1, same.argmin(1))
    shared = np.where(g[1:] == g[:-1], np.minimum(shared, np.minimum(n[1:], n[:-1])), 0)
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("row", "ascending")], null_placement="at_start").to_numpy()
    place = np.empty(len(n), np.int64)
    place[order] = np.concatenate([[0], np.cumsum(row[order][1:] != row[order][:-1])])
    smaller, other = np.zeros(len(n), np.int32), np.where(low < high, n, 0).astype(np.int32)
    for m in range(1, WINDOW):
        new = np.concatenate([[True], shared < m])
        if new.all():
            break
        heads, part = np.flatnonzero(new), np.cumsum(new) - 1
        far = n >= m
        smaller[far & (np.minimum.reduceat(place, heads)[part] < place)] = m
        wide = np.minimum.reduceat(low, heads) < np.maximum.reduceat(high, heads)
        other[far & wide[part]] = np.maximum(other[far & wide[part]], m)
    return n, smaller, other


def _reach_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends whose longest run no smaller place has, from rows of ENDS sorted by (g, more), groups of ``g`` whole."""
    def work(parts):
        table = pa.Table.from_batches(parts)
        n, smaller, other = reaches(table)
        pick = pa.array(np.flatnonzero(smaller < n))
        out = pa.table([table.column("row"), table.column("run"), pa.array(smaller), pa.array(other)], ["row", "run", "smaller", "other"]).take(pick)
        yield from out.combine_chunks().to_batches()

    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1], "left"))
        if pending and (cut or pending[-1].column(0)[-1].as_py() != g[0]):
            yield from work(pending + [batch.slice(0, cut)])
            pending = []
        elif cut:
            yield from work([batch.slice(0, cut)])
        pending.append(batch.slice(cut))
    if pending:
        yield from work(pending)


def _longer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of words around anchors, lengthened as far as a smaller place has them too, and as far as any other has."""
    for batch in batches:
        for a, data, offsets in text_slices(batch.column(2)):
            owner, word, right, n, run, (starts, ends, first, _) = _ends(data, offsets, batch.column(3).slice(a, len(offsets) - 1))
            known = batch.column(4).slice(a, len(offsets) - 1)
            text = np.repeat(np.arange(len(known)), known.value_lengths().to_numpy(zero_copy_only=False))
            key = known.flatten().to_numpy(zero_copy_only=False)
            reach = batch.column(5).slice(a, len(offsets) - 1).flatten().to_numpy(zero_copy_only=False)
            smaller, other = reach >> 8, reach & 255
            key = mix(mix(text.astype(U), 69) + key.view(U), 70)
            order = np.argsort(key)
            mine = mix(mix(owner.astype(U), 69) + run, 70)
            at = np.minimum(np.searchsorted(key[order], mine), max(len(key) - 1, 0))
            reach = [n, n]  # an end that is not told of has a copy in a smaller place
            if len(key):
                told = key[order][at] == mine
                reach = [np.where(told, x[order][at], n) for x in (smaller, other)]
            for kept, far, pick in ((False, reach[0], reach[0] > 0), (True, reach[1], reach[1] > reach[0])):
                w, o, side, far = word[pick], owner[pick], right[pick], far[pick]
                low, high = w - np.where(side, 0, far), w + GRAM_WORDS + np.where(side, far, 0)
                rows = pa.array(o + a)
                ids = batch.column(0).take(rows)
                ints = [low - first[o], high - first[o]]
                yield pa.record_batch([ids, batch.column(1).take(rows), pa.array(np.full(len(o), kept)), *[pa.array(x.astype(np.int32)) for x in ints],
                                       *[pa.array(x) for x in _bounds(starts, ends, offsets, o, low, high)], ids if kept else pa.nulls(len(o), ids.type)],
                                      ["doc_id", "row", "kept", "word", "word_end", "lo", "hi", "home"])


def _hint_lists(df: DataFrame, **item_bytes: int) -> DataFrame:
    """``hint_if_small`` by the items that the rows' lists hold, so many bytes each."""
    held = df.agg(F.coalesce(F.sum(sum(F.size(c) * n for c, n in item_bytes.items()) + F.lit(40)), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def _with_lists(df: DataFrame, lists: DataFrame, **item_bytes: int) -> DataFrame:
    """``df`` with the lists of its rows.  Where these are too many to broadcast, only the rows that have one are dealt."""
    hinted = _hint_lists(lists, **item_bytes)
    if hinted is lists:
        df = df.join(hint_if_small(lists.select("row"), 16), "row", "left_semi")
    return df.join(hinted, "row")


def _stretches(d: DataFrame, kind: str) -> DataFrame:
    """Runs of words that repeat verbatim in another document, those of one ``kept`` that touch as one."""
    place, text = F.struct("doc_id", "row"), ["doc_id", "row"]

    every = materialize(d.mapInArrow(_anchor_rows, f"doc_id {kind}, row long, word int, lo long, hi long, key long"))
    again = every.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min(place).alias("first")).where("low <> high")
    again = materialize(again.select("key", "first"))
    found = every.join(hint_if_small(again, 40), "key").select(
        *text, "word", (F.col("word") + GRAM_WORDS).alias("word_end"), "lo", "hi", "key", (F.col("row") == F.col("first.row")).alias("kept"), F.col("first.doc_id").alias("home"))
    found = materialize(found)
    release(every, again)
    # anchors near an end of a stretch, and where these anchors stand in all documents
    inside = Window.partitionBy(*text).orderBy("word")
    ends = found.select(*text, "word", "key", (F.col("word") - F.lag("word").over(inside) <= GRAM_WORDS).alias("goes_on"))
    ends = ends.withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(inside))
    whole = Window.partitionBy(*text, "run")
    ends = ends.select("key", (F.col("word") - F.min("word").over(whole) < WINDOW).alias("left"), (F.max("word").over(whole) - F.col("word") < WINDOW).alias("right"))
    ends = materialize(ends.groupBy("key").agg(F.max("left").alias("left"), F.max("right").alias("right")).where("left OR right"))
    spots = found.select("row", "word", "key").join(hint_if_small(ends, 24), "key").select(
        "row", F.explode(F.array_compact(F.array(F.when(F.col("left"), 2 * F.col("word")), F.when(F.col("right"), 2 * F.col("word") + 1)))).alias("spot"))
    spots = materialize(spots.groupBy("row").agg(F.collect_set("spot").alias("spots")))  # a document's own
    release(ends)
    beyond = _with_lists(d, spots, spots=4).select(*text, "text", "spots").mapInArrow(
        _end_rows, f"g long, run long, more binary, doc_id {kind}, row long, low long, high long")
    far = beyond.repartition("g").sortWithinPartitions("g", "more").mapInArrow(_reach_rows, "row long, run long, smaller int, other int")
    far = far.groupBy("row").agg(F.collect_set(F.struct("run", "smaller", "other")).alias("far"))  # a document's own
    # parallel lists: a broadcast of structs would be several times as large
    far = materialize(far.select("row", F.transform("far", lambda x: x["run"]).alias("runs"), F.transform("far", lambda x: 256 * x["smaller"] + x["other"]).alias("reach")))
    both = spots.join(far, "row", "left")
    both = materialize(both.withColumn("runs", F.coalesce("runs", F.array().cast("array<long>"))).withColumn("reach", F.coalesce("reach", F.array().cast("array<int>"))))
    release(far)
    longer = _with_lists(d, both, spots=4, runs=8, reach=4).select(*text, "text", "spots", "runs", "reach").mapInArrow(
        _longer_rows, f"doc_id {kind}, row long, kept boolean, word int, word_end int, lo long, hi long, home {kind}")
    columns = [*text, "kept", "word", "word_end", "lo", "hi", "home"]
    ranges = found.select(columns).unionByName(longer.select(columns))
    alike = Window.partitionBy(*text, "kept").orderBy("word")
    reach = F.max("word_end").over(alike.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("new", F.when(F.col("word") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(alike.rowsBetween(Window.unboundedPreceding, 0)))
    return ranges.groupBy(*text, "kept", "run").agg(*[f(c).alias(c) for f, c in (
        (F.min, "word"), (F.max, "word_end"), (F.min, "lo"), (F.max, "hi"), (F.min, "home"))]).drop("run")


def passages_of(ranges: list[tuple], least: int) -> list[tuple]:
    """(word, word_end, lo, hi, kept, indexes) of the passages of one text.  ``ranges``:
    (word, word_end, lo, hi, kept, ordinal of a sentence or -1, index)."""
    def chains(rows):
        """Rows that touch, or are neighbouring sentences with few words between."""
        out, reach, last, stop = [], -1, -9, 0
        for r in rows:
            if not out or not (r[0] <= reach or (r[5] >= 0 and r[5] - last == 1 and r[0] - stop <= GAP_WORDS)):
                out.append([])
                reach, last = -1, -9
            out[-1].append(r)
            reach = max(reach, r[1])
            if r[5] >= 0:
                last, stop = r[5], r[1]
        return out

    out = []
    for run in chains(sorted(ranges)):
        if max(r[1] for r in run) - run[0][0] < least:
            continue
        spans = {}
        for kept in (False, True):
            spans[kept] = [(c[0][0], max(r[1] for r in c), c[0][2], max(r[3] for r in c), kept, [r[6] for r in c])
                           for c in chains([r for r in run if r[4] == kept])]
        out += spans[False]
        for word, end, lo, hi, kept, index in spans[True]:  # what is left of them
            for gone in spans[False]:
                if gone[1] > word and gone[0] < end:
                    if gone[0] > word:
                        out.append((word, gone[0], lo, gone[2], kept, index))
                    word, lo = gone[1], gone[3]
            if word < end:
                out.append((word, end, lo, hi, kept, index))
    return out


def _passage_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows, owner = batch.column(2), [], []
            values, at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                some = values.slice(a, b - a)
                found = passages_of(list(zip(*[some.field(c).to_pylist() for c in range(6)], range(a, b))), least)
                rows += found
                owner += [i] * len(found)
            word, end, lo, hi = (np.array([r[c] for r in rows], np.int64) for c in range(4))
            homes = np.cumsum([0, *[len(r[5]) for r in rows]])
            index = pa.array([i for r in rows for i in r[5]], pa.int64())
            yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), batch.column(1).take(pa.array(owner, pa.int64())), pa.array(lo & _LOW),
                                   pa.array((hi >> 32) - (lo & _LOW)), pa.array(end - word), pa.array([r[4] for r in rows], pa.bool_()),
                                   pa.ListArray.from_arrays(pa.array(homes, pa.int32()), values.field(6).take(index))],
                                  ["doc_id", "text_key", "start", "length", "n_words", "kept", "homes"])
    return run


def repeated_passages(docs: DataFrame, passage_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that repeat across documents, one row for each place: doc_id, text_key,
    start, length (UTF-8 bytes), n_words, kept, keep_doc_id.

    * A passage is a stretch of neighbouring sentences and verbatim runs of words that
      repeat, of ``passage_words`` words or more; shorter sentences between repeated ones
      belong to it.  Every stretch of GRAM_WORDS + WINDOW - 1 words that stands in
      another document too is found, to its last word, wherever it begins and ends.
      Where one part is the first of its cluster and another not, they are rows
      of their own, and the words of both count.
    * kept: the place that stays, the first of its cluster by (doc_id, place);
      keep_doc_id: where the first places are (the smallest, if several).
    * Paragraphs of one document alone never count, nor do rows that repeat id and
      text (they are one document).  A verbatim run keeps all its places in its first document.  text_key (xxhash64 of id and text) tells apart
      rows that share an id.  Words compare with A-Z lower-cased.
    * Null and empty texts have no passages.  Null ids sort first.  Documents
      without a repeat give no row.  Other columns are not read.

    Scale: texts are read six times and not shuffled (unless the documents with
    anchors that repeat are too many to broadcast; then they are joined).  Shuffled are
    the keys of sentences and of anchors (combined per task, so a hot passage is one row
    per task; an anchor for every 13 words), a row with the next WINDOW - 1 words for an anchor near
    the end of a stretch (equal ones of a task are one; they are dealt by anchor, side and nearest word, so a
    task holds the different ends that share these), and the tile and band rows of paragraphs, packed as bytes, where copies in a task count once.  A
    task keeps one row a tile, however many paragraphs have it.  Arrays exist for paragraphs that meet another one, and clusters
    are verified in bounded chunks.
    """
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    place = F.struct("doc_id", "row", "line", "ordinal")
    parts = materialize(d.mapInArrow(_sentence_rows, f"doc_id {kind}, {PARTS}"))
    sentences = parts.where("k1 IS NOT NULL").drop("p1", "p2")
    lines = parts.where("p1 IS NOT NULL").select("doc_id", "row", "line", "ordinal", F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    # half a key finds what may repeat; whole keys and places of those rows decide
    maybe = sentences.groupBy("k1").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high")
    again = materialize(sentences.join(hint_if_small(materialize(maybe.select("k1")), 16), "k1"))
    equal = again.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.min("row").alias("low"), F.max("row").alias("high"))
    equal = materialize(equal.where("low <> high").select("k1", "k2", "first"))

    met = materialize(_meetings(d.select("text"), lines.count()))

    def arrays_of(keys: DataFrame) -> DataFrame:
        keys = hint_if_small(keys, 16)
        hits.append(materialize(lines.join(keys, "k1")))
        one = hits[0].groupBy("k1", "k2").agg(F.min("row").alias("row"))
        rows = materialize(one.groupBy("row").agg(F.collect_set("k1").alias("wanted")))  # a document's own
        found = _with_lists(d, rows, wanted=8).select("text", "wanted").mapInArrow(_array_rows, ARRAYS)
        return found.join(keys, "k1", "left_semi").dropDuplicates(["k1", "k2"])

    with intermediates() as scope:  # the clusters, arrays and rounds of the comparison go with it
        hits: list[DataFrame] = []  # the paragraphs that meet another one
        found = resolve(met, arrays_of, PERCENT, meeting_keys)
        linked = materialize(hits[0].join(found, ["k1", "k2"]).select("doc_id", "row", "line", "ordinal", "component"))
        scope.keep(linked)
    heads = linked.groupBy("component").agg(F.min(place).alias("first"), F.min("row").alias("low"), F.max("row").alias("high"))
    heads = heads.where("low <> high")
    near = materialize(linked.join(heads, "component").select(F.col("doc_id").alias("n_doc"), F.col("row").alias("n_row"), F.col("line").alias("n_line"), F.col("ordinal").alias("n_ordinal"), "first"))

    spot = ["doc_id", "row", "ordinal", "word", "word_end", "lo", "hi"]
    by_sentence = again.join(hint_if_small(equal, 64), ["k1", "k2"]).select(
        *spot, (place == F.col("first")).alias("head"), F.col("first.doc_id").alias("home"))
    release(met, linked)
    # a line's sentences; the first paragraph's line and sentence may both be in its cluster, and both stay
    part = (F.col("n_ordinal") < 0) | (F.col("n_ordinal") == F.col("ordinal"))
    same = (F.col("n_ordinal") < 0) | (F.col("first.ordinal") < 0) | (F.col("n_ordinal") == F.col("first.ordinal"))
    by_near = sentences.join(hint_if_small(near, 72), sentences["doc_id"].eqNullSafe(near["n_doc"]) & (F.col("row") == F.col("n_row")) & (F.col("line") == F.col("n_line")) & part).select(
        *spot, ((F.col("row") == F.col("first.row")) & (F.col("line") == F.col("first.line")) & same).alias("head"), F.col("first.doc_id").alias("home"))
    marked = (by_sentence.unionByName(by_near).groupBy("doc_id", "row", "ordinal")
              .agg(*[F.min(c).alias(c) for c in ("word", "word_end", "lo", "hi")], F.min("head").alias("kept"), F.min("home").alias("home")))
    marked = materialize(marked)
    release(parts, again, equal, near)
    ranges = marked.unionByName(_stretches(d, kind).withColumn("ordinal", F.lit(-1)))
    ranges = ranges.groupBy("doc_id", "row").agg(F.collect_list(F.struct("word", "word_end", "lo", "hi", "kept", "ordinal", "home")).alias("ranges"))  # a document's own
    out = ranges.mapInArrow(_passage_rows(passage_words), f"doc_id {kind}, text_key long, start long, length long, n_words long, kept boolean, homes array<{kind}>")
    return out.withColumn("keep_doc_id", F.array_min("homes")).drop("homes")


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the places of ``passages`` that are not kept cut out of ``text``."""
    doc, key, cut = unused(docs, "_doc"), unused(docs, "_key"), unused(docs, "_cut")
    spans = passages.where(~F.col("kept")).groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias(cut))  # a document's own
    hit = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("doc_id", "text") == F.col(key)), "left")
    raw = F.col("text").cast("binary")
    piece = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    start = F.struct(F.lit(b"").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda s, c: F.struct(F.concat(s["done"], piece(s["at"], c["start"])).alias("done"), (c["start"] + c["length"]).alias("at"))
    folded = F.aggregate(F.col(cut), start, step, lambda s: F.concat(s["done"], piece(s["at"], F.octet_length("text").cast("long"))).cast("string"))
    return hit.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(folded)).drop(doc, key, cut)
