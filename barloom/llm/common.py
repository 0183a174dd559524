"""Helpers that the corpus operators share: input selection, durable tables, and the packed repeat counter."""

from __future__ import annotations

import ctypes
import functools
import inspect
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def text_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, text[, rest]) of docs; the columns in carry travel in one struct, so that no name can clash."""
    cols = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest"))
    return docs.select(*cols)


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """What finds a row again, with or without an id: a 128-bit digest of doc_id and text, as a column."""
    own = F.col(f"`{text}`").cast("string")
    name = F.coalesce(F.col(f"`{doc_id}`").cast("long").cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.when(own.isNull(), "-").otherwise(":"), F.coalesce(own, F.lit(""))).cast("binary")))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which an operator's own grouping follows."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Without one, a temporary folder serves a local session;
    on a cluster it is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="barloom-"))
    return sc.getCheckpointDir()


#: Paths of the tables that durable has written in this process and that nobody has released.
WRITTEN: list[str] = []


def durable(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written once as Parquet to the shared folder and read back: lineage ends there, and no executor's loss undoes it.

    The table stays until release() is called, as a result that is read later may rest on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Removes the tables written after the first `since`, but for the last `keep`. For callers that have written their
    result elsewhere: what was built on a released table can no longer be read."""
    gone = WRITTEN[since : len(WRITTEN) - keep]
    del WRITTEN[since : len(WRITTEN) - keep]
    jvm = spark._jvm
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of text that one chunk is to hold, and hashes that one hash range is to hold.
CHUNK_BYTES, RANGE_HASHES = 1 << 25, 1 << 22


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: what the numbers of chunks and ranges follow."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def chunks(spark: SparkSession, size: int, each: int = CHUNK_BYTES) -> int:
    """Chunks for so many bytes of text, and never fewer than the session's partitions."""
    return max(partitions(spark), -(-size // each))


def with_chunk(docs: DataFrame, n: int) -> DataFrame:
    """Documents dealt evenly into n chunks by a hash of doc_id and text; a chunk is what one task handles at a time."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def give_back() -> None:
    """Returns freed memory to the machine: workers outlive their tasks, and allocators keep what a group needed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(f):
    """A group's function that gives back memory once the group is done."""

    @functools.wraps(f)
    def done(*args):
        try:
            return f(*args)
        finally:
            give_back()

    done.__signature__ = inspect.signature(f)  # Spark counts the arguments
    return done


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def stretches(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and end of every run of equal neighbours (in all keys)."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.r_[first[1:], n]


def batches(texts: list[bytes], limit: int = 1 << 19):
    """(first, last) index ranges of texts whose bytes together stay near limit; a longer text stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if texts:
        yield first, len(texts)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20):
    """A record batch in parts whose texts together stay near limit bytes, so that only a part is held as Python values."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy()
    ends = np.cumsum(sizes.astype(np.int64) + 1)
    first = 0
    while first < batch.num_rows:
        held = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, held + limit, side="right")))
        yield batch.slice(first, end - first)
        first = end
    give_back()


def texts_of(table: pa.Table, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is empty."""
    return [t or b"" for t in table.column(column).cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------------------------------------------------------
# Repeat counter. Each chunk hands in the hashes that it holds, sorted, unique and packed by hash range; one task a
# range tells which hashes stand in two places or more, and hands them back to the chunks that hold them. A hash that
# half of all documents hold counts once a chunk, so no range grows with a frequent hash.

PACKED = "part int, chunk int, keys binary, many binary, marked binary"
FOUND = "chunk int, keys binary"


def range_bits(spark: SparkSession, hashes: int) -> int:
    """Leading bits that tell a hash's range, for so many hashes."""
    return max(1, min(31, math.ceil(math.log2(max(partitions(spark), hashes / RANGE_HASHES)))))


def short(h: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits + 32 bits of hashes: the range and a 32-bit fingerprint in it."""
    return h >> U64(32 - bits)


def pack(chunk: int, h: np.ndarray, marked: np.ndarray | None, bits: int, exact: bool) -> pa.Table:
    """Rows of PACKED for the hashes of one chunk. exact keeps 64 bits; else a fingerprint, which may only add hits."""
    # In place where it can be: a worker holds few arrays as long as h at a time.
    key = h & ~U64(1)
    if marked is not None:
        key |= marked
    if not exact:
        mark = key & U64(1)
        key >>= U64(32 - bits)
        key <<= U64(1)
        key |= mark
        del mark
    key.sort()
    new = np.ones(len(key), bool)
    np.greater(key[1:] >> U64(1), key[:-1] >> U64(1), out=new[1:])
    last = np.r_[new[1:], np.ones(min(1, len(key)), bool)]
    many, mark = ~last[new], (key[last] & U64(1)).astype(bool)
    value = key[new] >> U64(1)
    del key, new, last
    part = (value >> U64(63 - bits) if exact else value >> U64(32)).astype(np.int64)
    cut, ends = stretches(part)
    kind = np.uint64 if exact else np.uint32
    rows = {"part": [], "chunk": [], "keys": [], "many": [], "marked": []}
    for a, b in zip(cut, ends, strict=True):
        rows["part"].append(int(part[a]))
        rows["chunk"].append(chunk)
        rows["keys"].append(value[a:b].astype(kind).tobytes())
        rows["many"].append(np.packbits(many[a:b]).tobytes())
        rows["marked"].append(np.packbits(mark[a:b]).tobytes() if marked is not None else b"")
    return pa.table(rows, pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("many", pa.binary()), ("marked", pa.binary())]))


def repeats(packed: DataFrame, exact: bool, need_mark: bool) -> DataFrame:
    """FOUND rows: for each chunk, which of its hashes stand in two places or more (with need_mark: one of them marked)."""

    @tidy
    def count(table: pa.Table) -> pa.Table:
        kind = np.uint64 if exact else np.uint32
        part = table.column("part")[0].as_py()
        chunks = table.column("chunk").to_numpy()
        keys = [np.frombuffer(x, kind) for x in table.column("keys").to_pylist()]
        sizes = np.array([len(x) for x in keys])
        unpacked = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column(name).to_pylist(), sizes, strict=True)])
        key, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), sizes)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        held = np.diff(np.r_[first, len(key)])
        hit = (held >= 2) | (np.add.reduceat(unpacked("many")[order].astype(np.int64), first) > 0)
        if need_mark:
            hit &= np.maximum.reduceat(unpacked("marked")[order], first) > 0
        hit = np.repeat(hit, held)
        key, owner = key[hit].astype(U64), owner[hit]
        if not exact:
            key |= U64(part << 32)
        order = np.argsort(owner, kind="stable")
        key, owner = key[order], owner[order]
        cut, ends = stretches(owner)
        return pa.table({"chunk": pa.array([int(chunks[owner[a]]) for a in cut], pa.int32()), "keys": pa.array([key[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())})

    return packed.groupBy("part").applyInArrow(count, FOUND)


def found_keys(table: pa.Table) -> np.ndarray:
    """The sorted hashes that a chunk's FOUND rows hold."""
    return np.sort(np.concatenate([np.zeros(0, U64), *[np.frombuffer(x, U64) for x in table.column("keys").to_pylist()]]))


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    return keys[np.minimum(at, len(keys) - 1)] == values
