"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is one token that can end its encoding: the longest suffix token t such that the prefix
before t ends in a token that may stand before t. Two tokens may stand together if no merge across their border comes
before the merges that made them. The table of last tokens is the whole state: an append continues it, and an edit redoes
it from the place of the edit, until it agrees with the old table again.

Nulls and empty texts have no ids. Long texts are encoded whole, piece by piece; a piece without a border, however long,
costs time in proportion to its length. Any bytes can be encoded; a text is split by the pattern first. Repeated rows are
encoded each. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices, text_table
from barloom.llm.tokens import ChunkCache


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens of a rank file: base64 and rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for rank, token in enumerate(self.tokens):
            if len(token) > 1 and (pair := self._last_merge(token, rank)):
                self.parts[rank] = pair
                self.merged[pair] = rank

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The pair whose merge gives the token; None if merges don't lead to it."""
        now = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(now) > 2:
            best = min((self.ranks.get(self.tokens[a] + self.tokens[b], rank), i) for i, (a, b) in enumerate(zip(now, now[1:])))
            if best[0] >= rank:
                return None
            now[best[1] : best[1] + 2] = [best[0]]
        return (now[0], now[1])

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives just these two.

        Undo the merges of both sides, the latest first. A pair at the border that would have merged before the merges
        still standing on either side (or, at equal rank, to the left of them) breaks the two tokens."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b = left, right
        # bound: the border pair must not merge at a rank below it.
        bound, answer = len(self.tokens), True
        while True:
            if self.merged.get((a, b), bound) < bound:
                answer = False
                break
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                break
            if pb is None or (pa_ is not None and a > b):
                bound, a = a, pa_[1]  # a's last merge is undone: the border pair comes first if its rank is lower
            else:
                bound, b = b + 1, pb[0]  # at b's rank the border pair stands to the left, so it comes first too
        if len(self.fits) > 2_000_000:
            self.fits = {}
        self.fits[left, right] = answer
        return answer

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Continues the table of last tokens (one a prefix) of data to its end, or to stop."""
        ranks, tokens, longest, may_follow = self.ranks, self.tokens, self.longest, self.may_follow
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            for begin in range(max(0, end - longest), end):
                token = ranks.get(data[begin:end])
                if token is not None and (begin == 0 or may_follow(last[begin - 1], token)):
                    last.append(token)
                    break
        return last

    def walk(self, last: list[int]) -> list[int]:
        """Ids from the table, from the end."""
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern; a match that is a token is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(self.extend(data, []))

    def edit(self, data: bytes, last: list[int], begin: int, end: int, fresh: bytes) -> tuple[bytes, list[int]]:
        """data with data[begin:end] replaced, and its table: prefixes before the edit stay, and once a token's length
        of last tokens in a row agree with the old table after the edit, the rest of that stays too."""
        new = data[:begin] + fresh + data[end:]
        table, shift, agree = last[:begin], len(fresh) - (end - begin), 0
        while len(table) < len(new):
            self.extend(new, table, len(table) + 1)
            old = len(table) - 1 - shift
            # Tokens that end here or later reach back at most a token's length; they must lie after the edit.
            agree = agree + 1 if len(table) > begin + len(fresh) and old >= end and last[old] == table[-1] else 0
            if agree >= self.longest:
                table += last[old + 1 :]
        return new, table

    def pieces(self, text: str) -> list[bytes]:
        return [m.encode() for m in self.pattern.findall(text)]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.piece(p)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_coders: dict[tuple, tuple[PrefixBPE, ChunkCache]] = {}


def coder(path: str, pattern: str) -> tuple[PrefixBPE, ChunkCache]:
    """The worker's own coder, and its memory of words."""
    if (path, pattern) not in _coders:
        bpe = PrefixBPE(read_ranks(path), pattern)

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [bpe.encode(t) for t in texts]
            return np.array([i for x in ids for i in x], "<u4"), np.array([len(x) for x in ids], np.int64)

        _coders[path, pattern] = bpe, ChunkCache(encode)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian 32-bit) and decoded (the bytes that the ids stand for).

    The pattern must start a match at every single space between other characters, as those of byte-level BPE do."""

    def run(stream):
        bpe, cache = coder(path, pattern)
        for batch in (part for whole in stream for part in slices(whole)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [x.astype("<u4") for x in cache.ids(texts)]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return text_table(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op9_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and of what they decode to."""
    import public_tokenizers

    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
