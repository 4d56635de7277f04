"""Words and shingles of whole texts as 64-bit hashes, in numpy over the texts' bytes.

A word's hash is a polynomial over its bytes modulo 2^64, mixed with its length; it is the same on every machine. Two of
n different words or shingles collide with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from sylva.llm.common import ASCII_LOWER

CHUNK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: What a byte adds to its word's hash, A-Z lower-cased.
LOWER = np.frombuffer(ASCII_LOWER, np.uint8).astype(np.uint64) + np.uint64(1)
#: Words of the contract: anything but ASCII blanks.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: Words for fuzzy matching: letters and digits; other scripts' bytes count as letters.
ALNUM = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
#: Odd multipliers for the places in a shingle.
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def chunks(rows: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, rows) of at most CHUNK_BYTES, or of one row."""
    first, part, size = 0, [], 0
    for i, x in enumerate(rows):
        if part and size + len(x) > CHUNK_BYTES:
            yield first, part
            first, part, size = i, [], 0
        part.append(x)
        size += len(x) + 1
    if part:
        yield first, part


def word_table(rows: list[bytes], chars: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, row, start and end (byte offsets in the row) of all words, in order."""
    raw = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    inside = np.zeros(len(raw) + 1, bool)
    inside[1:] = chars[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # the last byte ends any word, as it is a blank
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(LOWER[raw] * up, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in rows], out=offsets[1:])
    row = np.repeat(np.arange(len(rows)), np.diff(np.searchsorted(starts, offsets)))
    return h, row, starts - offsets[row], ends - offsets[row]


def shingle_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, row and first word of every run of k words within a row."""
    if len(h) < k:
        return h[:0], row[:0], np.zeros(0, np.int64)
    n = len(h) - k + 1
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g += mix(h[j : j + n] * _PLACES[j] + np.uint64(j))
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(g[at]), row[at], at


def shingle_sets(rows: list[bytes], k: int) -> list[np.ndarray]:
    """Each row's distinct k-word shingles, ascending; a shorter row's whole sequence as one; none without words."""
    h, row, _, _ = word_table(rows)
    g, r, _ = shingle_hashes(h, row, k)
    n = np.bincount(row, minlength=len(rows))
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[first], r[first]
    sets = np.split(g, np.searchsorted(r, np.arange(1, len(rows)))) if len(rows) else []
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = h[row == i]
        whole = mix(own * _PLACES[: len(own)] + np.arange(len(own), dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True)
        sets[i] = mix(whole + np.full(1, len(own), np.uint64) * _PLACES[3])
    return sets
