"""Sequences of one length along a space-filling curve.

A document's token ids are hashed into a vector, which a fixed random matrix projects to a few dimensions; the cell of
that point on a Hilbert curve is its key. Whole sequences' worth of ids fill sequences of their own; what is left of each
document, less than one sequence, is laid end to end in the order of the curve and cut at every sequence's end. So
neighbours in a sequence are neighbours on the curve, a document is cut only where a sequence ends, and all but the last
sequence are full.

Documents are encoded once; what is kept is each whole piece's checksum and the ids of the rest (two bytes an id where
the vocabulary allows). The rest is range-shuffled by (key, doc_id, length, checksum), so that copies, which share a key,
spread over tasks. Each task's sums, one row a task, give global positions.

Nulls and empty texts hold the end id alone. Long texts are encoded whole; what fills sequences of its own is kept as
checksums only. Ties on the curve go by doc_id, then length and checksum. Repeated rows are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import U64, durable, mix64, slices, text_table
from barloom.llm.tokens import cached_tokenizer, default_tokenizer

DIMENSIONS, CELL_BITS, HASHED = 4, 15, 256


def projection(dimensions: int = DIMENSIONS, hashed: int = HASHED) -> np.ndarray:
    """A fixed Gaussian matrix from the hashed vector to the plane of the curve."""
    return np.random.default_rng(20).standard_normal((hashed, dimensions))


def hashed_vector(ids: np.ndarray, hashed: int = HASHED) -> np.ndarray:
    """Signed counts of hashed token ids, at unit length; zero for no ids."""
    h = mix64(ids.astype(U64) + U64(1))
    slot, sign = (h >> U64(40)).astype(np.int64) % hashed, np.where(h & U64(1), 1.0, -1.0)
    v = np.bincount(slot, sign, hashed)
    size = np.sqrt((v * v).sum())
    return v / size if size else v


def hilbert(points: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with coordinates below 2**bits.

    Per level, from the coarsest: the orthant's bits, seen in the frame of the cells above, give one digit in Gray code;
    the frame is then reflected and rotated as the curve enters and leaves that orthant."""
    n, d = points.shape
    entry, turn, key = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = (1 << d) - 1

    def right(x, by):
        return ((x >> by) | (x << (d - by))) & full

    def left(x, by):
        return ((x << by) | (x >> (d - by))) & full

    for level in range(bits - 1, -1, -1):
        orthant = sum(((points[:, i] >> level) & 1) << i for i in range(d))
        gray = right(orthant ^ entry, (turn + 1) % d)
        digit = gray.copy()
        for shift in range(1, d):
            digit ^= gray >> shift
        key = (key << d) | digit
        before = np.where(digit == 0, 0, 2 * ((digit - 1) // 2))
        entry = entry ^ left(np.where(digit == 0, 0, before ^ (before >> 1)), (turn + 1) % d)
        flips = np.where(digit % 2 == 1, digit, digit - 1)  # the direction inside is the number of trailing ones
        ones, still = np.zeros(n, np.int64), digit > 0
        for shift in range(d):
            still = still & ((flips >> shift) & 1 == 1)
            ones += still
        turn = (turn + ones % d + 1) % d
    return key


def curve_keys(vectors: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Keys of unit vectors: a projected coordinate is near normal, and its share below gives an even grid."""
    from math import sqrt

    x = vectors @ projection(hashed=vectors.shape[1]) / sqrt(2)
    share = 0.5 * (1 + np.tanh(x * (1.1283791670955126 + 0.1009 * x * x)))  # near the error function
    return hilbert(np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


REST = "doc_id long, doc_tokens long, curve long, whole array<long>, rest binary, rest_ids long, rest_crc long"


def encoded(docs: DataFrame, path: str, length: int, end_id: int | None, room: int) -> DataFrame:
    """Per document: tokens, place on the curve, checksums of whole sequences, and what is left."""
    end = np.array([] if end_id is None else [end_id], "<u4")

    def encode(stream):
        cache = cached_tokenizer(path, room)
        for batch in (part for whole in stream for part in slices(whole)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            all_ids = cache.ids(texts)
            keys = curve_keys(np.stack([hashed_vector(x) for x in all_ids]))
            out: list[list] = [[] for _ in range(6)]
            for x, key in zip(all_ids, keys.tolist(), strict=True):
                x = np.concatenate([x, end]).astype("<u4")
                whole = len(x) // length * length
                rest = x[whole:]
                row = (len(x), key, [zlib.crc32(x[i : i + length]) for i in range(0, whole, length)], (rest.astype("<u2") if not len(rest) or rest.max() < 65536 else rest).tobytes(), len(rest), zlib.crc32(rest))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=[c.split()[0] for c in REST.split(", ")])

    return docs.mapInArrow(encode, REST)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"


def pack_along_curve(docs: DataFrame, length: int = 1024, tokenizer: str | None = None, end_id: int | None = 0, room: int = 1_200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start and length in the document's ids, ids_crc32, doc_tokens, sequence_id, offset, curve.

    Sequences of document rests come first, in the order of the curve, then those that one document fills. room bounds the
    words whose ids a worker remembers."""
    kept = durable(encoded(text_table(docs, id_col, text_col), tokenizer or default_tokenizer(), length, end_id, room))
    spark = docs.sparkSession

    def number(stream):
        task = TaskContext.get().partitionId()
        laid = filled = 0
        for batch in stream:
            size = batch.column("rest_ids").to_numpy()
            many = pa.compute.list_value_length(batch.column("whole")).to_numpy()
            yield pa.record_batch([*batch.columns, pa.array([task] * len(size), pa.int32()), pa.array(laid + np.cumsum(size) - size), pa.array(filled + np.cumsum(many) - many, pa.int64())], names=[*batch.schema.names, "task", "laid", "filled"])
            laid, filled = laid + int(size.sum()), filled + int(many.sum())

    placed = durable(kept.repartitionByRange("curve", "doc_id", "rest_ids", "rest_crc").sortWithinPartitions("curve", "doc_id", "rest_ids", "rest_crc").mapInArrow(number, REST + ", task int, laid long, filled long"))
    totals = sorted(tuple(r) for r in placed.groupBy("task").agg(F.sum("rest_ids"), F.sum(F.size("whole")).cast("long")).collect())
    laid, filled = (np.cumsum([0, *[r[i] for r in totals]]).tolist() for i in (1, 2))
    first_full = -(-laid[-1] // length)
    tasks = spark.createDataFrame([(r[0], a, f) for r, a, f in zip(totals, laid, filled, strict=False)], "task int, laid_before long, filled_before long")

    def cut(stream):
        for batch in stream:
            out: list[list] = [[] for _ in PIECE.split(", ")]
            for d, n, key, whole, rest, size, crc, at, full in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "curve", "whole", "rest", "rest_ids", "rest_crc", "at", "full")], strict=True):
                rows = [(d, i * length, length, c, n, first_full + full + i, 0, key) for i, c in enumerate(whole)]
                begin = len(whole) * length
                inside = min(size, length - at % length)
                if size:
                    if inside == size:
                        rows.append((d, begin, size, crc, n, at // length, at % length, key))
                    else:  # less than a sequence, so it is cut once
                        ids = np.frombuffer(rest, "<u2" if len(rest) == 2 * size else "<u4").astype("<u4")
                        rows.append((d, begin, inside, zlib.crc32(ids[:inside]), n, at // length, at % length, key))
                        rows.append((d, begin + inside, size - inside, zlib.crc32(ids[inside:]), n, at // length + 1, 0, key))
                for row in rows:
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=[c.split()[0] for c in PIECE.split(", ")])

    return placed.join(tasks, "task").withColumn("at", F.col("laid") + F.col("laid_before")).withColumn("full", F.col("filled") + F.col("filled_before")).select("doc_id", "doc_tokens", "curve", "whole", "rest", "rest_ids", "rest_crc", "at", "full").mapInArrow(cut, PIECE)


def op4_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids."""
    return pack_along_curve(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("curve")
