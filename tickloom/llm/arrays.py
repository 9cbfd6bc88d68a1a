"""Word hashing over whole batches of texts with NumPy, shared by operators that read every word.

A batch of texts is one byte array; words are the runs between ASCII white space. Every word gets a
64-bit polynomial hash computed by vector operations, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = SPACE.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240601).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(texts: list[str | None], punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the index of each word's text (null: no word).

    A-Z is lowered. With ``punctuation``, ASCII characters other than letters and digits separate, too.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = (PUNCTUATION if punctuation else SPACE)[data]
    word = ~gap
    starts = np.flatnonzero(word[1:] & gap[:-1]) + 1
    if word[0]:
        starts = np.concatenate(([0], starts))
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.flatnonzero(gap[1:] & word[:-1]) + 1
    length = ends - starts
    inside = np.flatnonzero(word)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, length)
    code = _BYTE_CODE[_ASCII_LOWER[data[inside]]]
    code *= powers(_BASE, int(length.max()))[place]
    h = mix(np.add.reduceat(code, first) + length.astype(np.uint64))
    borders = np.cumsum([len(r) + 1 for r in raw])
    return h, np.searchsorted(borders, starts, side="right")


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, the text of each, and the index of its first word."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1:])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * _BASE + h[at + k]
    return mix(out), doc[at], at


def slices(items: Iterable, size, limit: int = 1 << 21) -> Iterator[list]:
    """Cuts a stream of items into lists of about ``limit`` units (one item may be larger)."""
    held, total = [], 0
    for x in items:
        held.append(x)
        total += size(x)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held
