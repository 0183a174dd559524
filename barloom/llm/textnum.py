"""Words of whole batches of texts as arrays: spans, hashes and rolling windows, a few numpy passes a batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from barloom.llm.common import U64, mix64

#: The bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers from a counter."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


PLACE = odd_constants(1 << 12, 11)
#: Words that are hashed at a time.
WORDS_AT_ONCE = 1 << 14


@dataclass
class Words:
    """Words of a batch: start and end byte in the joined buffer, the text's number, place in the text, 64-bit hash."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray


def words(texts: list[bytes], lower: bool = False) -> Words:
    """All words of the texts. A hash depends on the word's bytes alone."""
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    if lower:
        buffer = LOWER[buffer]
    inside = ~SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, end = edge[::2], edge[1::2]
    text = np.searchsorted(offsets, start, side="right") - 1
    counts = np.bincount(text, minlength=len(texts))[: len(texts)] if len(texts) else np.zeros(0, np.int64)
    place = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = end - start
    factor = PLACE if not len(size) or size.max() <= len(PLACE) else odd_constants(int(size.max()), 11)
    value = np.zeros(len(start), U64)
    for a in range(0, len(start), WORDS_AT_ONCE):  # so that a very long text needs no arrays of its letters
        part = slice(a, a + WORDS_AT_ONCE)
        span = slice(start[part][0], end[part][-1])
        letters = buffer[span][inside[span]].astype(U64) + U64(1)
        begin = np.cumsum(size[part]) - size[part]
        letters *= factor[np.arange(len(letters)) - np.repeat(begin, size[part])]
        value[part] = mix64(np.add.reduceat(letters, begin) + size[part].astype(U64))
    return Words(buffer, start, end, text, place, value, counts, offsets)


def windows(w: Words, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, by first word, and which of them lie in one text."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    total = np.zeros(m, U64)
    for k, c in enumerate(odd_constants(n, seed)):
        total += w.hash[k : k + m] * c
    return mix64(total), w.text[:m] == w.text[n - 1 :]


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total places lie in a run of n that begins at one of starts."""
    change = np.bincount(starts, minlength=total + 1)
    ends = np.minimum(starts + n, total)
    change -= np.bincount(ends, minlength=total + 1)
    return np.cumsum(change[:total]) > 0
