"""Repeated passages by fixed-block anchors.

Every text is cut into non-overlapping blocks of `block` words; these form the index. Every run of `block` words at any
place probes the index. Where 2 * block - 1 <= window, two equal windows hold a whole indexed block of either text, so
each has a hit there. Hits are extended: windows around them are compared as a whole over the corpus, and the union of
those found again is the set of maximal exact repeats of `window` words or more.

Hashes travel packed, by hash range, once a chunk (see common.repeats): a passage that a third of all documents hold
adds one entry a chunk, and no pairs are formed.

A chunk is bounded by bytes of text and a range by hashes, each by its own count, so tasks keep their size as the corpus
grows. Texts are handled whole: a chunk's words are taken in batches of some 256 KB, a longer text being a batch alone.

Nulls, empty texts and texts shorter than the window come back whole. Repeated rows count as occurrences of their own.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import PACKED, U64, batches, chunks, found_keys, member, pack, range_bits, repeats, short, text_bytes, text_table, texts_of, tidy, with_chunk
from barloom.llm.textnum import covered, windows, words

#: Bytes of text in a chunk; the fewer they are, the less a worker holds at a time.
CHUNK_BYTES = 1 << 22


def remove_repeated_passages(docs: DataFrame, window: int = 35, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words joined by one space; the text itself if none goes),
    spans (removed word ranges) and the carried columns as `rest`."""
    block = block or (window + 1) // 2
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block at any place: 2 * block - 1 <= window")
    spark = docs.sparkSession
    rows = text_table(docs, id_col, text_col, carry)
    size = text_bytes(rows)
    bits = range_bits(spark, size // 4)  # a hash a word
    rows = with_chunk(rows, chunks(spark, size, CHUNK_BYTES))

    @tidy
    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        texts, hashes, marks = texts_of(table), [np.zeros(0, U64)], [np.zeros(0, bool)]
        for a, b in batches(texts, 1 << 18):
            w = words(texts[a:b])
            h, whole = windows(w, block, 18)
            hashes.append(h[whole])
            marks.append(w.place[: len(h)][whole] % block == 0)
        return pack(key[0].as_py(), np.concatenate(hashes), np.concatenate(marks), bits, exact=False)

    hits = repeats(rows.groupBy("chunk").applyInArrow(anchors, PACKED), exact=False, need_mark=True)

    def candidates(w, keys):
        """Windows that hold a hit at one of the places where an indexed block may lie."""
        h, whole = windows(w, block, 18)
        near = covered(np.maximum(np.flatnonzero(whole & member(short(h, bits), keys)) - (window - block), 0), window - block + 1, len(w.hash)) if len(h) else np.zeros(0, bool)
        long, inside = windows(w, window, 35)
        return np.flatnonzero(near[: len(long)] & inside), long

    @tidy
    def extended(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        texts, keys, hashes = texts_of(left), found_keys(right), [np.zeros(0, U64)]
        for a, b in batches(texts, 1 << 18) if len(keys) else ():
            at, long = candidates(words(texts[a:b]), keys)
            hashes.append(long[at])
        return pack(key[0].as_py(), np.concatenate(hashes), None, bits, exact=True)

    again = repeats(rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extended, PACKED), exact=True, need_mark=False)
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])
    if carry:
        out.add("rest", rows.schema["rest"].dataType)

    @tidy
    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        texts, keys = texts_of(left), found_keys(right)
        n_words, n_removed, kept, spans = [], [], [], []
        for a, b in batches(texts, 1 << 18):
            w = words(texts[a:b])
            long, inside = windows(w, window, 35)
            gone = covered(np.flatnonzero(inside & member(long >> U64(1), keys)), window, len(w.hash)) if len(keys) and len(long) else np.zeros(len(w.hash), bool)
            first = np.cumsum(w.counts) - w.counts
            for i, (at, many) in enumerate(zip(first, w.counts, strict=True)):
                mine = gone[at : at + many]
                n_words.append(int(many))
                n_removed.append(int(mine.sum()))
                if not n_removed[-1]:
                    kept.append(texts[a + i])
                    spans.append([])
                    continue
                edge = np.flatnonzero(np.diff(np.r_[False, mine, False]))
                spans.append(edge.reshape(-1, 2).astype(np.int32).tolist())
                stay = np.flatnonzero(~mine)
                kept.append(b" ".join([texts[a + i][s:e] for s, e in zip((w.start[at + stay] - w.offsets[i]).tolist(), (w.end[at + stay] - w.offsets[i]).tolist(), strict=True)]))
        cols = {"doc_id": left.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32())))}
        if carry:
            cols["rest"] = left.column("rest")
        return pa.table(cols)

    return rows.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(cut, out)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of kept words, joined by one space, with windows of 35 words."""
    out = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    squeezed = F.regexp_replace(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "), r"\A | \z", "")
    kept = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(squeezed)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
