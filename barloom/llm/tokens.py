"""Token ids of whole texts, by the words between single spaces.

A single space that doesn't stand between two white-space characters starts a new match of the byte-level pattern, so a
text's ids are the ids of its chunks, each with the space before it. Chunks repeat, so each worker remembers their ids in
a bounded table that is emptied when full; texts with longer runs of white space are encoded whole. The result is always
the tokenizer's own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

RUN = re.compile(r"\s \s")
STEP = re.compile(r" \s")  # cheaper, and a part of every RUN


class Numbers(dict):
    """Chunk to its number; a new chunk takes the next one and joins the list of those to encode."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class ChunkCache:
    """Ids of texts. encode maps a list of strings to (all ids in one array, ids of each)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_words: Callable | None = None, room: int = 1_200_000):
        self.encode, self.encode_words, self.room = encode, encode_words or encode, room
        self.clear()

    def clear(self) -> None:
        self.numbers, self.used, self.filled = Numbers(), 0, 0
        self.start, self.size, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint16)

    def put(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(len(self.flat), self.flat.dtype)]
        if len(ids) and ids.max() > np.iinfo(self.flat.dtype).max:
            self.flat = self.flat.astype(np.uint32)
        while len(at) and at.max() >= len(self.start):
            self.start, self.size = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.size, np.zeros_like(self.size)]
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.start[at] = self.filled + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.filled += len(ids)

    def learn(self) -> None:
        new, base = self.numbers.new, len(self.numbers) - len(self.numbers.new)
        plain = np.array([c == c.strip() != "" for c in new], bool)
        for group, encode in ((np.flatnonzero(plain), self.encode_words), (np.flatnonzero(~plain), self.encode)):
            if len(group):
                self.put(base + group, *encode([" " + new[i] for i in group.tolist()]))
        self.numbers.new = []

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, in the narrowest type that holds all so far."""
        if len(self.numbers) > self.room:
            self.clear()
        number, places, whole = self.numbers.__getitem__, [], []
        for t in texts:
            if STEP.search(t) and RUN.search(t):
                whole.append(t)
                places.append(None)
            else:
                chunks = t.split(" ")
                whole.append(chunks[0])
                places.append(np.fromiter(map(number, chunks[1:]), np.int64, len(chunks) - 1))
        self.learn()
        flat, sizes = self.encode(whole)
        if len(flat) and flat.max() > np.iinfo(self.flat.dtype).max:
            self.flat = self.flat.astype(np.uint32)
        heads = np.split(flat, np.cumsum(sizes)[:-1]) if len(whole) else []
        out = []
        for head, at in zip(heads, places, strict=True):
            if at is not None and len(at):
                many = self.size[at]
                ends = np.cumsum(many)
                rest = self.flat[np.repeat(self.start[at] - ends + many, many) + np.arange(ends[-1])]
                head = np.concatenate([head.astype(self.flat.dtype), rest])
            out.append(head)
        return out


def tokenizer_cache(path: str, room: int = 1_200_000) -> ChunkCache:
    """ids of a tokenizers file with a byte-level pattern, without special tokens added."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
    tokenizer = Tokenizer.from_file(path)
    bytes_of = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)
    for token, i in tokenizer.get_vocab().items():
        bytes_of[i] = len(token)  # a byte-level token has one character a byte
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        sizes = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum())), sizes

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words are joined, as each begins a match, and the ids are cut where the bytes say."""
        if any(s in "".join(words) for s in special):
            return encode(words)
        joined = ["".join(words[at : at + 200]) for at in range(0, len(words), 200)]
        ids, _ = encode(joined)
        ends = np.searchsorted(np.cumsum(bytes_of[ids]), np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)))) + 1
        return ids, np.diff(ends, prepend=0)

    return ChunkCache(encode, encode_words, room)


_caches: dict[str, ChunkCache] = {}


def cached_tokenizer(path: str, room: int = 1_200_000) -> ChunkCache:
    """The worker's own tokenizer for a path; a cluster has the file at that path on every node. room bounds the words
    that it remembers, at some 200 bytes each."""
    if path not in _caches:
        _caches[path] = tokenizer_cache(path, room)
    _caches[path].room = room
    return _caches[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
