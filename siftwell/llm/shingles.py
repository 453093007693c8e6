"""Hashed word shingles of many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z lower-cased. A word's hash is a
polynomial over its bytes, taken from prefix sums of the whole batch; a shingle mixes the
hashes of five words in a row. All arithmetic is modulo 2^64, so hashes are the same everywhere.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = _inverses = np.ones(1, dtype=np.uint64)
_bytes = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, dtype=np.uint64)
_bytes[ord("A") : ord("Z") + 1] = _bytes[ord("a") : ord("z") + 1]
_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def mix(h):
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.append(np.uint64(1), np.full(size - 1, _BASE, dtype=np.uint64)).cumprod(dtype=np.uint64)
        _inverses = np.append(np.uint64(1), np.full(size - 1, _INVERSE, dtype=np.uint64)).cumprod(dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of the text) of every shingle in order; ``offsets`` cut the bytes into texts.

    A text of one to four words has one shingle, the whole sequence; one without words has none.
    """
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if not len(data):
        return none
    gap = _space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(~gap & (edge[:-1] | np.append(True, gap[:-1])))
    ends = np.flatnonzero(~gap & (edge[1:] | np.append(gap[1:], True))) + 1
    if not len(starts):
        return none
    _grow(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_bytes[data] * _powers[: len(data)], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))
    text = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(text, minlength=len(offsets) - 1)
    full = np.flatnonzero(text[: -WIDTH + 1] == text[WIDTH - 1 :]) if len(word) >= WIDTH else np.zeros(0, dtype=np.int64)
    out, owner = [_chain(word, full, WIDTH)], [text[full]]
    first = np.cumsum(n_words) - n_words
    for n in range(1, WIDTH):
        few = np.flatnonzero(n_words == n)
        if len(few):
            out.append(_chain(word, first[few], n))
            owner.append(few)
    hashes, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable") if len(out) > 1 else slice(None)
    return hashes[order], owner[order]


def _chain(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(at), n, dtype=np.uint64)
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + word[at + i]
    return mix(h)


def distinct(hashes: np.ndarray, owner: np.ndarray, n_texts: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    ends = np.searchsorted(owner, np.arange(n_texts + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def of_arrow(column) -> list[np.ndarray]:
    """The sorted distinct shingles of each text of an Arrow string column; null texts have none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return distinct(*shingles(data, offsets - offsets[0]), len(column))
