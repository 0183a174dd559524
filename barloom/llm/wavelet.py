"""Token ids in wavelet matrices: one shard, one compressed file.

A shard holds the ids of consecutive documents in ascending doc_id order. Its matrix has a plane of bits for each bit of
an id, most significant first; each plane is in the order left by a stable split of the plane before on its bits. With
counts of ones every 512 bits, rank and select give any token, the number of times an id stands before a place, and the
place of its n-th occurrence, from the planes alone. Each plane is its own zstd frame, so a reader opens what it needs.

Documents are range-shuffled by doc_id; a task writes its shards in order, and a table of each task's number of ids (one
row a task) gives global positions. Rows with one doc_id follow each other by a hash of the text, so that an id that many texts share still spreads over
tasks. A long text is encoded whole and lies in one shard, which grows with it. Nulls and empty texts hold the end id
alone. An empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import durable, slices, text_table
from barloom.llm.tokens import cached_tokenizer, default_tokenizer

MAGIC, SPAN = b"BLWM1\0", 512
SHARD = "task int, number int, n_docs long, n_ids long, file binary"


def packed(frame: bytes) -> bytes:
    data = zstandard.ZstdCompressor(level=1).compress(frame)
    return struct.pack("<QQ", len(data), len(frame)) + data


def write_shard(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of one shard. doc_ids may hold None."""
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = struct.pack("<QQI", len(doc_ids), len(ids), levels)
    parts = [MAGIC, head, packed(names.tobytes() + np.packbits([d is None for d in doc_ids]).tobytes()), packed(np.asarray(sizes, "<u8").tobytes())]
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels - 1, -1, -1):
        bit = (now & (1 << level)).astype(bool)
        plane = np.packbits(bit, bitorder="little")
        whole = np.r_[plane, np.zeros(-len(plane) % (SPAN // 8), np.uint8)].view(np.uint64).reshape(-1, SPAN // 64)
        ones = np.cumsum(np.bitwise_count(whole).sum(axis=1, dtype=np.uint64), dtype=np.uint64)
        parts += [packed(plane.tobytes()), packed(np.r_[np.zeros(1, np.uint64), ones].astype("<u8").tobytes())]
        now = np.concatenate([now.take(np.flatnonzero(~bit)), now.take(np.flatnonzero(bit))])
    return b"".join(parts)


class Shard:
    """Reads a shard's file: tokens, counts and occurrences."""

    def __init__(self, file: bytes):
        if not file.startswith(MAGIC):
            raise ValueError("not a shard file")
        self.n_docs, self.n, self.levels = struct.unpack_from("<QQI", file, len(MAGIC))
        at, self.frames = len(MAGIC) + 20, []
        view = memoryview(file)
        for _ in range(2 + 2 * self.levels):
            size, plain = struct.unpack_from("<QQ", file, at)
            self.frames.append((view[at + 16 : at + 16 + size], plain))
            at += 16 + size
        self.opened: dict[int, np.ndarray] = {}

    def frame(self, i: int, kind) -> np.ndarray:
        if i not in self.opened:
            data, plain = self.frames[i]
            self.opened[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, plain)), kind)
        return self.opened[i]

    def documents(self) -> tuple[list, np.ndarray]:
        raw = self.frame(0, np.uint8)
        names = raw[: 8 * self.n_docs].view("<i8").tolist()
        absent = np.unpackbits(raw[8 * self.n_docs :], count=self.n_docs)
        return [None if a else d for d, a in zip(names, absent, strict=True)], self.frame(1, np.dtype("<u8")).astype(np.int64)

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits, packed, and ones before each span; level 0 is the most significant."""
        return self.frame(2 + 2 * level, np.uint8), self.frame(3 + 2 * level, np.dtype("<u8"))

    def rank(self, level: int, at: int) -> int:
        """Ones before a place."""
        bits, ones = self.plane(level)
        span, rest = divmod(at, SPAN)
        begin = span * SPAN // 8
        held = int(ones[span]) + int(np.bitwise_count(bits[begin : begin + rest // 8]).sum())
        if rest % 8:
            held += (int(bits[begin + rest // 8]) & ((1 << rest % 8) - 1)).bit_count()
        return held

    def select(self, level: int, bit: int, count: int) -> int:
        """The place of the count-th (from 0) such bit, by bisection over ranks."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self.rank(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > count:
                high = middle
            else:
                low = middle + 1
        return low

    def token(self, at: int) -> int:
        value = 0
        for level in range(self.levels):
            bits, _ = self.plane(level)
            bit = int(bits[at // 8]) >> (at % 8) & 1
            ones = self.rank(level, at)
            at = self.n - self.rank(level, self.n) + ones if bit else at - ones
            value = 2 * value + bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self.rank(level, low), self.rank(level, high)
            if token >> (self.levels - 1 - level) & 1:
                zeros = self.n - self.rank(level, self.n)
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        """How often a token stands before a place (all of the shard if none is given)."""
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def occurrence(self, token: int, count: int) -> int:
        """The place of a token's count-th occurrence, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= count < high - low:
            raise IndexError("no such occurrence")
        at = low + count
        for level in range(self.levels - 1, -1, -1):
            zeros = self.n - self.rank(level, self.n)
            at = self.select(level, 1, at - zeros) if token >> (self.levels - 1 - level) & 1 else self.select(level, 0, at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the splits from the last plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, np.uint8)
        for level in range(self.levels - 1, -1, -1):
            if level == self.levels - 9:  # the low eight bits move as bytes
                now = now.astype(kind)
            bit = np.unpackbits(self.plane(level)[0], count=self.n, bitorder="little").view(bool)
            zero, one = np.flatnonzero(~bit), np.flatnonzero(bit)
            above = np.empty(self.n, now.dtype)
            above[zero] = now[: len(zero)]
            above[one] = now[len(zero) :] | now.dtype.type(1 << (self.levels - 1 - level))
            now = above
        return now.astype(kind)


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 2, shard_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written shards, as rows of SHARD: task, number in the task, documents, ids and the file."""
    path = tokenizer or default_tokenizer()
    rows = text_table(docs, id_col, text_col)
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def build(stream):
        cache, task, number = cached_tokenizer(path), TaskContext.get().partitionId(), 0
        names, sizes, held, total = [], [], [], 0

        def shard():
            return pa.record_batch([pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([len(names)]), pa.array([total]), pa.array([write_shard(names, np.array(sizes), np.concatenate(held))], pa.binary())], names=["task", "number", "n_docs", "n_ids", "file"])

        end = np.array([] if end_id is None else [end_id], np.uint16 if end_id is None or end_id < 65536 else np.uint32)
        for batch in (part for whole in stream for part in slices(whole)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for d, x in zip(batch.column(0).to_pylist(), cache.ids(texts), strict=True):
                names.append(d)
                held += [x, end]
                sizes.append(len(x) + len(end))
                total += sizes[-1]
                if total >= shard_ids:
                    yield shard()
                    names, sizes, held, total, number = [], [], [], 0, number + 1
        if names:
            yield shard()

    return durable(ordered.mapInArrow(build, SHARD), compression="none")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(task, number, base): ids of all shards before. Only one sum a task comes to the driver."""
    spark = shards.sparkSession
    totals = sorted((r[0], r[1]) for r in shards.groupBy("task").agg(F.sum("n_ids")).collect())
    before = np.cumsum([0, *[n for _, n in totals]]).tolist()
    tasks = spark.createDataFrame([(t, b) for (t, _), b in zip(totals, before, strict=False)], "task int, before long")
    inside = F.sum("n_ids").over(Window.partitionBy("task").orderBy("number")) - F.col("n_ids")
    return shards.select("task", "number", "n_ids").withColumn("inside", inside).join(tasks, "task").select("task", "number", (F.col("before") + F.col("inside")).alias("base"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the files: task, number, doc_id, inside (ids of the shard before it), n_tokens, ids_crc32."""

    def read(stream):
        for batch in stream:
            for task, number, file in zip(batch.column("task").to_pylist(), batch.column("number").to_pylist(), batch.column("file"), strict=True):
                shard = Shard(file.as_py())
                names, sizes = shard.documents()
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch([pa.array([task] * len(names), pa.int32()), pa.array([number] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["task", "number", "doc_id", "inside", "n_tokens", "ids_crc32"])

    return shards.select("task", "number", "file").mapInArrow(read, "task int, number int, doc_id long, inside long, n_tokens long, ids_crc32 long")


def op5_wavelet_tokens(spark, sf_dir: str) -> DataFrame:
    """Documents read back from the shards' files."""
    shards = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = read_documents(shards).join(shard_starts(shards), ["task", "number"])
    return out.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
