"""Whole Arrow batches of texts as numpy arrays of word and shingle hashes.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower
case.  A word's hash is a polynomial over its bytes modulo 2**64, taken as a
difference of prefix sums, so a batch costs a few array passes and no loop
over words.  64-bit hashes stand for words and shingles; a set of shingles is
identified by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at once (longer texts are taken alone, whole).
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shifts and odd factors)."""
    x = x + U((salt * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U)[_LOWER], 7)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE_BYTES + 65536), base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about SLICE_BYTES; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        yield a, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each text (one more at the end)."""
    full = ~_SPACE[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = full[:-1], full[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U), 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text, end to
    end, and the offsets of the texts.  A text with fewer words has its whole
    sequence as its one shingle; a text without words has none."""
    starts, ends, first = word_spans(data, offsets)
    return sets_of_words(span_hashes(data, starts, ends), first, width)


def sets_of_words(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` from word hashes; ``first``: the index of each text's first word, and the end."""
    return sets_of_spans(words, first[:-1], np.diff(first), width)


def sets_of_spans(words: np.ndarray, low: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of runs of ``counts`` words from ``low``, which may overlap: a shingle's hash is made once."""
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(sizes.sum()), U)
    at = np.concatenate([[0], np.cumsum(sizes)])
    long = np.flatnonzero(counts >= width)
    if len(long):
        chain = words[:len(words) - width + 1].copy()
        for j in range(1, width):
            chain = mix(chain * U(3), 11 + j) + words[j:len(words) - width + 1 + j]
        chain = mix(chain, 5)
        place = _ranges(at[long], sizes[long])
        out[place] = chain[np.repeat(low[long] - at[long], sizes[long]) + place]
    for c in range(1, width):
        short = np.flatnonzero(counts == c)
        if len(short):
            chain = words[low[short]].copy()
            for j in range(1, c):
                chain = mix(chain * U(3), 11 + j) + words[low[short] + j]
            out[at[short]] = mix(chain, 100 + c)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][sizes > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[at]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1 ... (sizes[0] numbers), starts[1] ..."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def set_keys(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify each set (0, 0 for an empty one)."""
    n = np.diff(at)
    out = []
    for salt in (21, 22):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets, salt))])
        key = sums[at[1:]] - sums[at[:-1]]
        out.append(np.where(n > 0, mix(key + n.astype(U), salt + 10), U(0)))
    return out[0], out[1]


def signature_bits(n: np.ndarray, least: int) -> np.ndarray:
    """Bits of a signature: a power of two, as many as members and ``least`` or more."""
    return np.maximum(least, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def parity_bitmaps(sets: np.ndarray, at: np.ndarray, least: int) -> list[np.ndarray]:
    """A signature of each set: bit h is 1 when an odd number of members hash to h.  Two
    sets differ in at least as many members as their signatures in bits.  The
    halves of a signature, combined by exclusive or, are the one of half its bits."""
    n = np.diff(at)
    bits = signature_bits(n, least)
    begin = np.concatenate([[0], np.cumsum(bits)])
    place = (mix(sets, 31) >> U(32)).astype(np.int64) & np.repeat(bits - 1, n)
    flags = (np.bincount(np.repeat(begin[:-1], n) + place, minlength=int(begin[-1])) & 1).astype(np.uint8)
    words = np.packbits(flags).view(np.uint64)
    return [words[a // 64:b // 64] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
