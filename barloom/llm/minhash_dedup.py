"""Near-duplicate classes by MinHash bands and odd sketches.

A document's set is its distinct shingles of `shingle` words (A-Z lower-cased). Documents with one set form a class at
once. Each class has k MinHash samples; bands of `rows` samples give candidate buckets, and the samples folded into a
parity bitmap, the odd sketch, let a XOR and a population count estimate a pair's similarity before its full sets are
compared. The chance that a pair at 0.75 shares none of 32 bands of 4 is below 6e-6.

Round A tests every class against its buckets' smallest class, a number of tests linear in the buckets' sizes, and joins
what is linked. Round B looks at buckets that still hold classes of two components: the classes outside the bucket's
largest component are paired with all others, those inside it never with each other, so that a few strays in a bucket of
a million copies cost a few passes over it. Blocks of sketches are compared first; texts follow only for classes that
have a pair left. A block tests no pair that it has joined already. Every link is confirmed on full sets.

Sketches reject pairs estimated `slack` below the threshold. With 128 samples in 512 bits an estimate at 0.75 has a
standard deviation of some 0.045 and a longer tail below: 0.2 lost 33 of 1.93 million simulated pairs at the threshold, 0.3
lost none.

Rows are the nodes: a shared doc_id alone links nothing, and a null doc_id is no id. Nulls, empty texts and texts without
words have an empty set and stand alone; shorter texts than the shingle are one shingle. Long texts are signed whole, in
batches of their own. Repeated rows are linked unless their sets are empty. A component's id is its smallest doc_id, null
where all its ids are null; such a component keeps the row with the smallest class, then row key. Rows that are equal in
doc_id and text get the same verdict. Sets and rows are told apart by 128-bit digests. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import U64, batches, durable, mix64, row_key, slices, text_table, texts_of, tidy
from barloom.llm.links import components
from barloom.llm.textnum import odd_constants, windows, words

SKETCH_BITS = 512


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in batches(texts):
        w = words(texts[a:b], lower=True)
        h, _ = windows(w, shingle, 5)
        first = np.cumsum(w.counts) - w.counts
        factors = odd_constants(shingle, 6)
        for at, many in zip(first.tolist(), w.counts.tolist(), strict=True):
            if many >= shingle:
                out.append(np.unique(h[at : at + many - shingle + 1]))
            elif many:
                out.append(mix64(np.array([(w.hash[at : at + many] * factors[:many]).sum() + U64(many)], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out


def class_of(hashes: np.ndarray) -> bytes:
    """A set's 128-bit digest."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def samples(sets: list[np.ndarray], k: int) -> np.ndarray:
    """MinHash samples, k rows by one column a set; the sets aren't empty."""
    x = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    c = odd_constants(2 * k, 128).astype(np.uint32) | np.uint32(1)
    return np.stack([np.minimum.reduceat((x ^ c[k + i]) * c[i], starts) for i in range(k)])


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """One key a set and band."""
    k, n = least.shape
    factors = odd_constants(rows, 4)
    keys = [mix64((least[b : b + rows].astype(U64) * factors[:, None]).sum(axis=0, dtype=U64) + U64(b)) for b in range(0, k, rows)]
    return np.stack(keys, axis=1).view(np.int64)


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words: each sample toggles one bit."""
    k, n = least.shape
    bit = (mix64(least.astype(U64) + (np.arange(k, dtype=U64) << U64(32))[:, None]) >> U64(55)).astype(np.int64)
    odd = np.bincount((np.arange(n) * SKETCH_BITS + bit).ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def most_flips(k: int, similarity: float) -> int:
    """The XOR count above which a sketch pair is estimated to lie under a similarity."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-4 * k * (1 - similarity) / SKETCH_BITS)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


SIGNED = "doc_id long, n_shingles long, class binary, bands array<long>, sketch array<long>, row_key binary"


def signatures(docs: DataFrame, shingle: int = 5, k: int = 128, rows: int = 4) -> DataFrame:
    """Rows of SIGNED for (doc_id, text, row_key); class, bands and sketch are null for an empty set."""

    def sign(stream):
        for batch in (part for whole in stream for part in slices(whole)):
            ids, keys, texts = batch.column(0), batch.column("row_key"), texts_of(pa.Table.from_batches([batch]))
            for a, b in batches(texts):
                sets = shingle_sets(texts[a:b], shingle)
                full = [s for s in sets if len(s)]
                if full:
                    least = samples(full, k)
                    bands, sketch = iter(band_keys(least, rows).tolist()), iter(odd_sketches(least).tolist())
                own = [bool(len(s)) for s in sets]
                yield pa.record_batch(
                    [ids[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()), pa.array([next(bands) if x else None for x in own], pa.list_(pa.int64())), pa.array([next(sketch) if x else None for x in own], pa.list_(pa.int64())), keys[a:b]],
                    names=["doc_id", "n_shingles", "class", "bands", "sketch", "row_key"],
                )

    return docs.mapInArrow(sign, SIGNED)


def flips_of(words: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Bits in which rows of sketches differ from one. bitwise_count takes a signed number's magnitude, so they go unsigned."""
    return np.bitwise_count((words ^ word).view(U64)).sum(axis=1)


def flips(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


OPEN = "band long, i int, j int, class binary, root binary, leader binary, mine int, bands array<long>, sketch array<long>"


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = 5, k: int = 128, rows: int = 4, slack: float = 0.3, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, class (set digest), group (its component's digest; null without words), component_id,
    kept, row_key."""
    texts = text_table(docs, id_col, text_col).withColumn("row_key", row_key())
    limit = most_flips(k, percent / 100 - slack)
    signed = durable(signatures(texts, shingle, k, rows))
    classes = durable(signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("row_key", "bands", "sketch")).alias("x")).select("class", "doc_id", "x.row_key", "x.bands", "x.sketch"))
    entries = classes.select(F.explode("bands").alias("band"), "class")
    shared = entries.groupBy("band").agg(F.min("class").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "leader")
    members = durable(entries.join(shared, "band"))
    sketches = classes.join(members.select("class").distinct(), "class", "left_semi").select("class", "sketch")
    involved = classes.join(members.select("class").distinct(), "class", "left_semi").select("class", "row_key")
    own_text = durable(texts.where("text is not null").join(involved, "row_key").select("class", "text"))
    if own_text.groupBy("class").count().where("count > 1").take(1):  # rows equal in doc_id and text
        own_text = durable(own_text.dropDuplicates(["class"]))

    def tested(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that full sets confirm. Text b goes to a's group; large groups of a are split."""
        groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).cast("int").alias("parts"))
        right = pairs.join(groups, "a").join(own_text.withColumnRenamed("class", "b"), "b").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "text")
        left = groups.join(own_text.withColumnRenamed("class", "a"), "a").select("a", F.lit(None).cast("binary").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")

        @tidy
        def confirm(table: pa.Table) -> pa.Table:
            a, b, held = table.column("a")[0].as_py(), table.column("b").to_pylist(), texts_of(table)
            base = next((s for i in range(len(b)) if b[i] is None for s in shingle_sets([held[i]], shingle)), None)
            found = set()
            for i, j in batches(held) if base is not None else ():
                for name, s in zip(b[i:j], shingle_sets(held[i:j], shingle), strict=True):
                    if name is not None and similar(base, s, percent):
                        found.add(name)
            return pa.table({"a": pa.array([a] * len(found), pa.binary()), "b": pa.array(sorted(found), pa.binary())})

        return right.unionByName(left).groupBy("a", "part").applyInArrow(confirm, "a binary, b binary")

    def close(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketches.select(F.col("class").alias("b"), F.col("sketch").alias("right")), "b").join(sketches.select(F.col("class").alias("a"), F.col("sketch").alias("left")), "a")
        return both.where(flips("left", "right") <= limit).select("a", "b")

    first = durable(tested(durable(close(members.where("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct()))))
    roots = components(first)
    placed = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    held = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    crowd = F.max(F.struct("n", "root"))
    mixed = held.groupBy("band").agg(crowd.alias("most"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = mixed.select("band", F.col("most.root").alias("main"), F.ceil(F.col("most.n") / block).cast("int").alias("main_blocks"), F.ceil((F.col("n") - F.col("most.n")) / block).cast("int").alias("blocks"))
    in_main = F.col("root") == F.col("main")
    mine = F.when(in_main, F.col("blocks") + F.pmod(F.xxhash64("class"), F.col("main_blocks"))).otherwise(F.pmod(F.xxhash64("class"), F.col("blocks"))).cast("int")
    others = F.sequence(F.lit(0), F.when(in_main, F.col("blocks")).otherwise(F.col("blocks") + F.col("main_blocks")) - 1)
    open_rows = placed.join(mixed, "band").select("band", "class", "root", "leader", mine.alias("mine"), F.explode(others).alias("other"))
    dealt = open_rows.join(classes.select("class", "bands", "sketch"), "class").select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "class", "root", "leader", "mine", "bands", "sketch")

    def left_over(key: tuple, table: pa.Table):
        """The block's rows but the leader, which round A has tested, and for each the later rows that its sketch leaves."""
        plain = np.array([a != b for a, b in zip(table.column("class").to_pylist(), table.column("leader").to_pylist(), strict=True)], bool)
        table = table.filter(pa.array(plain))
        _, root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)
        mine = table.column("mine").to_numpy()
        bits, bands = (table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, n) for c, n in (("sketch", SKETCH_BITS // 64), ("bands", k // rows)))
        here, two = key[0].as_py(), key[1].as_py() != key[2].as_py()

        def later(i: int) -> np.ndarray:
            rest = np.arange(i + 1, len(root))
            rest = rest[(root[rest] != root[i]) & ((mine[rest] != mine[i]) if two else True)]
            rest = rest[flips_of(bits[rest], bits[i]) <= limit]
            if len(rest):  # a pair is tested in the first band that it shares
                rest = rest[bands[i][(bands[rest] == bands[i]).argmax(axis=1)] == here]
            return rest

        return table, root, later

    @tidy
    def sift(key: tuple, table: pa.Table) -> pa.Table:
        table, root, later = left_over(key, table)
        wanted = np.zeros(len(root), bool)
        for i in range(len(root)):
            rest = later(i)
            wanted[rest] = True
            wanted[i] |= len(rest) > 0
        return table.filter(pa.array(wanted))

    @tidy
    def across(key: tuple, table: pa.Table) -> pa.Table:
        table, root, later = left_over(key, table)
        name, out = table.column("class").to_pylist(), [[], []]
        sets = shingle_sets(texts_of(table), shingle)
        for i in range(len(name)):
            for j in later(i).tolist():
                if root[i] != root[j] and similar(sets[i], sets[j], percent):
                    out[0].append(name[i])
                    out[1].append(name[j])
                    root[root == root[j]] = root[i]
        return pa.table(out, pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    sifted = dealt.select(*[x.split()[0] for x in OPEN.split(", ")]).groupBy("band", "i", "j").applyInArrow(sift, OPEN)
    second = durable(sifted.join(own_text, "class").groupBy("band", "i", "j").applyInArrow(across, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if second.take(1):
        roots = components(first.unionByName(second))
    placed = classes.select("class", "doc_id", "row_key").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("group", F.coalesce("root", "class"))
    label = placed.groupBy("group").agg(F.min("doc_id").alias("label"))
    # lone: the row that a component without any id keeps.
    lone = F.when(F.col("label").isNull() & (F.col("group") == F.col("class")), F.col("row_key"))
    final = placed.join(label, "group").select("class", "group", "label", lone.alias("lone"))
    out = signed.select("doc_id", "n_shingles", "class", "row_key").join(final, "class", "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("label")))
    kept = F.when(F.col("component_id").isNotNull(), F.col("doc_id") == F.col("component_id")).otherwise(F.col("class").isNull() | (F.col("row_key") == F.col("lone")))
    return out.select("doc_id", "n_shingles", "class", "group", "component_id", F.coalesce(kept, F.lit(False)).alias("kept"), "row_key")


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of documents at a similarity of 0.75 or more on five-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")
