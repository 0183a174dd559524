"""Repeated byte strings by merged Burrows-Wheeler transforms.

1. Anchors. Every window of `window` bytes has a lightest k-byte gram (by hash). Equal windows have equal lightest grams,
   so windows whose gram stands nowhere else are settled at once. Runs of windows with one gram form a segment.
2. Segments whose gram repeats are dealt by gram: equal windows meet in one bucket. Equal segments (by 128-bit digest) are
   one string with a count, and one that is alone with its gram and stands twice is a repeat as it is.
3. A gram with over `group_limit` different segments (the edge of a very common passage) would outgrow a task. Its windows
   are dealt anew by what all windows at a like distance from the gram share: 64 distances together and, where that is
   still too much, 16, then one by one. Equal windows still meet.
4. In a bucket, every shard of segments gets its transform once, over letters of q bytes: the letter before each suffix, in
   suffix order. The merge reads transforms alone. It keeps the interleave, which tells from which shard each suffix of
   the merged order comes, and refines it: a round reads the shards' letters in the interleave's order and deals them
   out by letter, so that after h rounds it is right for h letters. A split depth is kept for every place of the merged
   order: a place that splits from the one before in round h shares h - 1 letters with it. Unsplit stretches after
   `window` bytes are the repeated intervals; the shards' own orders say where their suffixes stand.

Chunks and buckets are bounded by bytes, ranges by hashes, so tasks keep their size as the corpus grows. A text is never
cut; one of many megabytes is a batch of its own. Nulls and texts below the window come back whole, as empty or unchanged
bytes. Repeated rows count as occurrences of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import PACKED, U64, batches, chunks, durable, found_keys, member, mix64, pack, partitions, range_bits, repeats, short, stretches, text_bytes, text_table, texts_of, with_chunk
from barloom.llm.textnum import odd_constants

GRAM = 32
MULTIPLIERS = odd_constants(16, 77)


def gram_hashes(buffer: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all byte strings of a length, put together from hashes of power-of-two lengths."""
    level, h, at, total = 1, mix64(buffer.astype(U64) + U64(1)), 0, None
    left, step = size, 0
    while left:
        if left & 1:
            part = h[at:]
            total = part.copy() if total is None else total[: len(part)] * MULTIPLIERS[8 + step % 8] + part
            at += level
        left >>= 1
        if left:
            h = h[:-level] * MULTIPLIERS[step % 8] + (h[level:] ^ (h[level:] >> U64(29))) if len(h) > level else h[:0]
            level *= 2
            step += 1
    return mix64(total[: max(0, len(buffer) - size + 1)])


def slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every n neighbours."""
    width = 1
    while width * 2 <= n:
        x = pick(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = n - width
    return (pick(x[:-rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x


def lightest(texts: list[bytes], window: int):
    """Gram hashes of the joined texts, each window's lightest, which windows lie in one text, and the texts' offsets."""
    buffer = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    grams = gram_hashes(buffer, GRAM)
    least = slide(grams, window - GRAM + 1, np.minimum)
    valid = np.zeros(len(buffer) + 1, np.int64)
    long = np.array([len(t) >= window for t in texts], bool)
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - window, -1)
    return grams, least, np.cumsum(valid)[: len(least)] > 0, offsets


def letter_size(depth: int) -> int:
    """The bytes of a letter: the largest divisor of depth of which four or more make up depth."""
    return max(q for q in range(1, max(1, depth // 4) + 1) if depth % q == 0)


def shard_order(rank: np.ndarray, step: int) -> np.ndarray:
    """Positions of one shard in suffix order. rank orders positions by their first letter; end marks are unique in it."""
    size, index = len(rank), np.arange(len(rank))
    _, rank = np.unique(rank, return_inverse=True)
    while True:
        after = np.zeros(size, np.int64)
        after[: max(0, size - step)] = rank[step:]
        bits = int(size).bit_length()
        if 3 * bits <= 63:
            key = np.sort((rank << (2 * bits)) | (after << bits) | index)
            order, key = key & ((1 << bits) - 1), key >> bits
        else:
            order = np.lexsort((after, rank))
            key = rank[order] * (size + 1) + after[order]
        new = np.zeros(size, np.int64)
        new[1:] = np.cumsum(key[1:] != key[:-1])
        rank = np.empty(size, np.int64)
        rank[order] = new
        if new[-1] == size - 1 or step > size:
            return order
        step *= 2


@dataclass
class Transform:
    """A shard's transform. letters: the letter before each suffix, in suffix order, 0 where the suffix begins a string;
    marks: how many suffixes, the first ones, are end marks; places: where each suffix stands in the joined segments."""

    letters: np.ndarray
    marks: int
    places: np.ndarray


def transform(segments: list[bytes], q: int) -> Transform:
    """The transform of one shard.

    A letter is a block of q bytes, by hash; the suffix at an offset reads letters at that offset, q later, and so on, so
    that a segment is q interwoven strings. The last q places of a segment are end marks, each different from all else."""
    raw = np.frombuffer(b"\0".join([*segments, b""]), np.uint8)
    lengths = np.array([len(s) for s in segments])
    size = len(raw)
    hashes = gram_hashes(raw, q) | U64(1 << 63)  # above all marks
    hashes = np.r_[hashes, np.zeros(size - len(hashes), U64)]
    offset = np.arange(size) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    mark = offset > np.repeat(lengths, lengths + 1) - q
    marks = int(mark.sum())
    order = shard_order(np.where(mark, np.cumsum(mark).astype(U64), hashes), q)
    before = np.r_[np.zeros(q, U64), hashes[:-q]][:size]
    return Transform(np.where(offset[order] < q, U64(0), before[order]), marks, order.astype(np.int32))


def merge_transforms(parts: list[Transform], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, split): the shard of each suffix of the merged order, right for `rounds` letters, and the round in
    which each place split from the one before it (0: the two share all letters read). Only letters and marks are read."""
    kind = np.uint16 if len(parts) < 1 << 16 else np.int32
    shard = np.arange(len(parts), dtype=kind)
    marks = np.repeat(shard, [p.marks for p in parts])
    source = np.r_[marks, np.repeat(shard, [len(p.letters) - p.marks for p in parts])]
    names, letter = np.unique(np.concatenate([p.letters for p in parts]), return_inverse=True)
    letter = letter + int(names[0] != 0)  # 0 stays for the beginning of a string
    split = np.zeros(len(source), np.int16)
    block = np.zeros(len(source), np.int64)
    here = np.empty(len(source), np.int64)
    for turn in range(1, rounds + 1):
        here[np.argsort(source, kind="stable")] = letter
        held = np.flatnonzero(here)
        key = np.sort(here[held] << 32 | np.arange(len(held)))
        at, key = held[key & 0xFFFFFFFF], key >> 32
        former = block[at]
        apart = np.ones(len(at), bool)
        apart[1:] = (key[1:] != key[:-1]) | (former[1:] != former[:-1])
        source = np.r_[marks, source[at]]
        apart = np.r_[np.ones(len(marks), bool), apart]
        split[apart & (split == 0)] = turn
        block = np.cumsum(split > 0)
    return source, split


def repeated_starts(segments: list[bytes], counts: np.ndarray, depth: int, shard_bytes: int = 1 << 17, q: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every string of depth bytes that stands twice or more, by count or by place. q, a divisor of
    depth, is the bytes of a letter."""
    q = q or letter_size(depth)
    lengths = np.array([len(s) for s in segments])
    begin = np.cumsum(lengths + 1) - lengths - 1
    parts, base = [], []
    for a, b in batches(segments, shard_bytes):
        parts.append(transform(segments[a:b], q))
        base.append(int(begin[a]))
    source, split = merge_transforms(parts, depth // q)
    place = np.empty(len(source), np.int64)
    place[np.argsort(source, kind="stable")] = np.concatenate([p.places + b for p, b in zip(parts, base, strict=True)])
    block = np.cumsum(split > 0) - 1
    sizes = np.bincount(block)
    text = np.repeat(np.arange(len(segments), dtype=np.int32), lengths + 1)[place]
    offset = place - begin[text]
    again = ((sizes[block] > 1) | (counts[text] > 1)) & (offset + depth <= lengths[text])
    return text[again], offset[again]


def runs(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Covered ranges of sorted window starts."""
    cut = np.flatnonzero(np.r_[True, np.diff(starts) > window])
    last = np.r_[cut[1:], len(starts)] - 1
    return list(zip(starts[cut].tolist(), (starts[last] + window).tolist(), strict=True))


SEGMENTS = "anchor long, segment binary, doc_id long, text_hash long, chunk int, start int, size int, several boolean"
SEGMENT_TYPES = {"anchor": pa.int64(), "segment": pa.binary(), "doc_id": pa.int64(), "text_hash": pa.int64(), "chunk": pa.int32(), "start": pa.int32(), "size": pa.int32(), "several": pa.bool_()}
PIECE_TYPES = SEGMENT_TYPES | {"n": pa.int64(), "gram": pa.int64(), "owner": pa.binary(), "at": pa.int32()}
STRINGS = "anchor long, segment binary, n long, bytes binary"
RUNS = "segment binary, first int, last int"
#: Bytes of strings that one bucket is to hold, and how many distances are dealt together when a gram has too many segments.
BUCKET_BYTES, NEAR = 1 << 21, (64, 16, 1)


def digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def several(grams: np.ndarray, least: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which segments (first and last window start) may hold their lightest gram more than once. Where it stands once, all
    windows lie at different distances from it, so that no two of them are equal."""
    span = len(grams) - len(least)
    most = slide(np.r_[np.zeros(span, U64), least, np.zeros(span, U64)], span + 1, np.maximum)
    places = np.flatnonzero(grams == most[: len(grams)])
    a, b = np.searchsorted(places, start), np.searchsorted(places, end + span, side="right")
    held = np.zeros(len(start), np.int64)
    for k in range(4):
        here = a + k < b
        held[here] += grams[places[(a + k)[here]]] == least[start[here]]
    return (held > 1) | (b - a > 4)


def nearer(piece: bytes, gram: int, window: int, near: int) -> list[tuple[bytes, int, int]]:
    """(key, first, end) of the runs of a segment's windows that lie in like distance from the gram: `near` distances
    together. The key is what all windows at these distances share, so equal windows have equal keys."""
    at = np.flatnonzero(gram_hashes(np.frombuffer(piece, np.uint8), GRAM) == U64(gram & (2**64 - 1)))
    starts = np.arange(len(piece) - window + 1)
    at = at[np.searchsorted(at, starts)]
    band = (at - starts) // near
    out = []
    for x, y in zip(*stretches(at, band), strict=True):
        last = int(at[x] - band[x] * near)
        out.append((b"%d " % band[x] + piece[last : last - near + 1 + window], int(starts[x]), int(starts[y - 1]) + window))
    return out


def remove_repeated_bytes(docs: DataFrame, window: int = 200, group_limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the remaining bytes."""
    if window < GRAM:
        raise ValueError(f"the window must hold a gram of {GRAM} bytes")
    spark = docs.sparkSession
    rows = text_table(docs, id_col, text_col)
    total = text_bytes(rows)
    bits = range_bits(spark, total // 64)  # grams that are lightest somewhere, with room
    rows = with_chunk(rows.withColumn("text_hash", F.xxhash64("text")), chunks(spark, total))

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        texts, found = [t for t in texts_of(table) if len(t) >= window], [np.zeros(0, U64)]
        for a, b in batches(texts, 1 << 19):
            grams, least, valid, _ = lightest(texts[a:b], window)
            span = window - GRAM + 1
            most = slide(np.r_[np.zeros(span - 1, U64), np.where(valid, least, U64(0)), np.zeros(len(grams) - len(least), U64)], span, np.maximum)
            found.append(grams[: len(most)][(grams[: len(most)] == most)])
        return pack(key[0].as_py(), np.concatenate(found), None, bits, exact=False)

    hits = repeats(rows.groupBy("chunk").applyInArrow(anchors, PACKED), exact=False, need_mark=False)

    def segments(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, out = found_keys(right), {k: [] for k in SEGMENT_TYPES}
        ids, hashes = left.column("doc_id").to_pylist(), left.column("text_hash").to_pylist()
        texts = texts_of(left)
        own = [i for i, t in enumerate(texts) if len(t) >= window] if len(keys) else []
        for a, b in batches([texts[i] for i in own], 1 << 19):
            part = [texts[i] for i in own[a:b]]
            grams, least, valid, offsets = lightest(part, window)
            at = np.flatnonzero(valid)
            at = at[member(short(least[at] & ~U64(1), bits), keys)]
            doc = np.searchsorted(offsets, at, side="right") - 1
            first, end = stretches(at - np.arange(len(at)), least[at], doc)
            for x, y, more in zip(first.tolist(), end.tolist(), several(grams, least, at[first], at[end - 1]).tolist(), strict=True):
                d = doc[x]
                begin = int(at[x] - offsets[d])
                piece = part[d][begin : int(at[y - 1] - offsets[d]) + window]
                i = own[a + d]
                for column, value in zip(out.values(), (int(least[at[x]].astype(np.int64)), digest(piece), ids[i], hashes[i], key[0].as_py(), begin, len(piece), more), strict=True):
                    column.append(value)
        return pa.table(out, pa.schema(SEGMENT_TYPES))

    def redeal(crowd: DataFrame, near: int) -> DataFrame:
        """Different segments cut into runs of windows that are dealt by what they share, no longer by gram."""

        def cut_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            need: dict[tuple, list] = {}
            for d, h, *x in zip(*[right.column(c).to_pylist() for c in ("doc_id", "text_hash", "gram", "segment", "n", "start", "size")], strict=True):
                need.setdefault((d, h), []).append(x)
            out: dict[str, list] = {k: [] for k in PIECE_TYPES}
            for d, h, t in zip(left.column("doc_id").to_pylist(), left.column("text_hash").to_pylist(), left.column("text"), strict=True):
                wanted = need.pop((d, h), [])
                t = t.as_py().encode() if wanted else b""
                for gram, owner, n, start, size in wanted:
                    piece = t[start : start + size]
                    for name, first, end in nearer(piece, gram, window, near) if near > 1 else [(piece[i : i + window], i, i + window) for i in range(size - window + 1)]:
                        value = int.from_bytes(digest(name)[:8], "little", signed=True)
                        for column, x in zip(out.values(), (value, digest(piece[first:end]), d, h, key[0].as_py(), start + first, end - first, False, n, gram, owner, first), strict=True):
                            column.append(x)
            return pa.table(out, pa.schema(PIECE_TYPES))

        # Only texts that hold a crowd's segment are dealt again.
        holders = rows.join(crowd.select("chunk", "text_hash").distinct(), ["chunk", "text_hash"], "left_semi")
        return holders.groupBy("chunk").cogroup(crowd.groupBy("chunk")).applyInArrow(cut_up, f"{SEGMENTS}, n long, gram long, owner binary, at int")

    def kinds(rows: DataFrame, places: str) -> DataFrame:
        """Different segments, with their number of places, one of these, and the number of segments that share the key."""
        groups = rows.groupBy("anchor", "segment").agg(F.expr(places).alias("n"), F.min(F.struct("chunk", "doc_id", "text_hash", "start", "size", "several", "gram")).alias("x"))
        return durable(groups.join(groups.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchor").select("anchor", "segment", "n", "kinds", "x.*"))

    found = durable(rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(segments, SEGMENTS))
    latest = kinds(found.withColumn("gram", F.col("anchor")), "count(*)")
    known, cuts = latest, []
    for near in NEAR if window > NEAR[0] else NEAR[-1:]:
        if not latest.where(f"kinds > {group_limit}").take(1):
            break
        crowd = durable(latest.where(f"kinds > {group_limit}"))
        pieces = durable(redeal(crowd, near))
        cuts.append(pieces.select("segment", "owner", "at"))
        latest = kinds(pieces, "sum(n)")
        known = known.where(f"kinds <= {group_limit}").unionByName(latest)
    alone = known.where("kinds = 1 and n > 1").select("segment", F.lit(0).alias("first"), F.col("size").alias("last"))

    def strings(wanted: DataFrame) -> DataFrame:
        """The bytes of segments, each from one document that holds it."""

        def read(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            need: dict[tuple, list] = {}
            for d, h, *x in zip(*[right.column(c).to_pylist() for c in ("doc_id", "text_hash", "start", "size", "anchor", "segment", "n")], strict=True):
                need.setdefault((d, h), []).append(x)
            out = [[], [], [], []]
            for d, h, t in zip(left.column("doc_id").to_pylist(), left.column("text_hash").to_pylist(), left.column("text"), strict=True):
                if (d, h) in need:
                    t = t.as_py().encode()
                    for start, size, *x in need.pop((d, h)):
                        for column, value in zip(out, (*x, t[start : start + size]), strict=True):
                            column.append(value)
            return pa.table(out, pa.schema([("anchor", pa.int64()), ("segment", pa.binary()), ("n", pa.int64()), ("bytes", pa.binary())]))

        return rows.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(read, STRINGS)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        ids, pieces = table.column("segment").to_pylist(), table.column("bytes").to_pylist()
        text, offset = repeated_starts(pieces, table.column("n").to_numpy(), window)
        order = np.lexsort((offset, text))
        text, offset = text[order], offset[order]
        out = [(ids[text[x]], first, last) for x, y in zip(*stretches(text), strict=True) for first, last in runs(offset[x:y], window)]
        return pa.table([list(c) for c in zip(*out, strict=True)] or [[], [], []], pa.schema([("segment", pa.binary()), ("first", pa.int32()), ("last", pa.int32())]))

    # A string that is alone with its gram and stands once can only repeat inside itself.
    mixed = known.where("kinds > 1 or (n = 1 and several)")
    held = mixed.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]
    buckets = max(2 * partitions(spark), -(-held // BUCKET_BYTES))
    ranges = strings(mixed).withColumn("bucket", F.pmod(F.col("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(merge, RUNS).unionByName(alone)
    for cut_rows in reversed(cuts):  # a piece's ranges are its owner's too; the merge itself is read once
        own = F.struct("segment", "first", "last")
        owners = F.when(F.col("owner").isNotNull(), F.struct(F.col("owner").alias("segment"), (F.col("first") + F.col("at")).alias("first"), (F.col("last") + F.col("at")).alias("last")))
        ranges = ranges.join(cut_rows, "segment", "left").select(F.explode(F.array_compact(F.array(own, owners))).alias("x")).select("x.*")
    gone = found.select("segment", "doc_id", "text_hash", "chunk", "start").join(ranges, "segment").select("chunk", "doc_id", "text_hash", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[tuple, list] = {}
        for d, h, a, b in zip(*[right.column(c).to_pylist() for c in ("doc_id", "text_hash", "first", "last")], strict=True):
            spans.setdefault((d, h), []).append((a, b))
        ids, hashes, out = left.column("doc_id").to_pylist(), left.column("text_hash").to_pylist(), [[], [], [], []]
        for d, h, text in zip(ids, hashes, texts_of(left), strict=True):
            kept, at, removed, n_spans = [], 0, 0, 0
            for a, b in sorted(spans.get((d, h), ())):
                if a > at or not n_spans:
                    kept.append(text[at:a])
                    n_spans += 1
                    at = a
                if b > at:
                    removed += b - at
                    at = b
            kept.append(text[at:])
            for column, value in zip(out, (len(text), removed, n_spans, b"".join(kept)), strict=True):
                column.append(value)
        return pa.table([left.column("doc_id"), *out], pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

    return rows.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of the bytes that stay, with strings of 200 bytes."""
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
