"""The trie of conversation prefixes, and totals over its subtrees by peeling leaves.

A node is a distinct sequence of first turns; it is named by a 128-bit digest of sums of turn hashes, each of which holds
its own depth, so that a long conversation's prefixes can be summed in parts. The nodes whose smallest member is c are the
end of c's own path: a run. Runs are peeled, not single nodes, so that a conversation of many turns takes one round: each
run holds a counter of child runs that have not reported; a run without open children is complete and sends its totals to
the node above it; completed runs leave the table, until only the root's run finishes. For ids that say nothing about
content, rounds grow with the logarithm of the conversations; they never exceed the depth. Totals of the nodes inside a
run are then sums from its end.

Ids of the conversations that end at a node are joined in blocks of ids before one task hashes a node's blocks in order,
holding one block at a time.

Turns are ordered by turn (null first), then by role and text; repeated rows are turns of their own. A null role or text
is empty. Rows without a conv_id belong to no conversation. c % 100 has the sign of c, as in SQL. An empty table, or one
without conv_ids, gives an empty result: there is no conversation for the root to hold.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import durable, partitions

#: Halves of the two 64-bit hashes of a turn: sums of 32-bit numbers stay longs for 2^31 turns.
SUMS = ["s0", "s1", "s2", "s3"]
#: A block of a node's ends holds the ids that agree but for so many low bits: 4,096 ids at most.
BLOCK_BITS = 12


def halves(name: str, seed: int, *cols: str) -> list[Column]:
    h = F.xxhash64(F.lit(seed), *cols)
    return [F.shiftright(h, 32).alias(name + "0"), h.bitwiseAND(F.lit(0xFFFFFFFF)).alias(name + "1")]


def node_key(sums: list[Column], depth: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def summed(rows: DataFrame, by: str, order: Column | str, values: dict[str, Column], descending: bool = False) -> DataFrame:
    """rows with running sums of values along each key's rows. Rows are dealt by key and part, so that a key of many rows
    is summed by many tasks; a key in several parts adds the sums of the parts before. As parts come from a range
    partitioning, at most two keys a part are in several, which bounds what is broadcast."""
    turned = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    w = Window.partitionBy(by, "part").orderBy(turned(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(v).over(w).alias(f"__{k}") for k, v in values.items()])
    many = rows.groupBy(by).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select(by)
    totals = rows.join(F.broadcast(many), by, "left_semi").groupBy(by, "part").agg(*[F.sum(v).alias(f"+{k}") for k, v in values.items()])
    before = Window.partitionBy(by).orderBy(turned("part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(by, "part", *[F.coalesce(F.sum(f"`+{k}`").over(before), F.lit(0)).alias(f"-{k}") for k in values])
    both = local.join(F.broadcast(offsets), [by, "part"], "left")
    return both.select(*rows.columns, *[(F.col(f"__{k}") + F.coalesce(F.col(f"-{k}"), F.lit(0))).alias(k) for k in values])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, chars, a0, a1, b0, b1, part, place): every turn by its number in its conversation; two hashes in halves."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text")).where("conv is not null")
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "conv", F.col("turn").asc_nulls_first()).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    hashed = dealt.select("conv", F.length("text").cast("long").alias("chars"), *halves("a", 11, "role", "text"), *halves("b", 29, "role", "text"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    return summed(durable(hashed), "conv", "place", {"n": F.lit(1)}).withColumn("pos", F.col("n") - 1).drop("n")


def rebuilt(conversations: DataFrame, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv, part) of all conversations, and the turns (conv, depth, chars, a0.., part) of the rebuilt ones: the first h
    turns of conversation conv - conv % every, then conv's own from its turn h on; h = crc32(conv) % heads."""
    own = durable(turns(conversations))
    convs = own.groupBy("conv").agg(F.min("part").alias("part")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv") - F.col("conv") % every)
    first = own.where((F.col("conv") % every == 0) & (F.col("pos") < heads - 1))
    # A conversation lends at most heads - 1 turns, to fewer than 2 * every others.
    lent = convs.join(first.select(F.col("conv").alias("base"), "pos", "chars", "a0", "a1", "b0", "b1"), "base").where("pos < h")
    held = first.groupBy(F.col("conv").alias("base")).agg(F.count("*").alias("there"))
    after = own.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % heads).where("pos >= h").withColumn("base", F.col("conv") - F.col("conv") % every)
    kept = after.join(held, "base", "left").withColumn("depth", F.least("h", F.coalesce("there", F.lit(0))) + F.col("pos") - F.col("h") + 1)
    cols = ["conv", "depth", "chars", "a0", "a1", "b0", "b1", "part"]
    return convs.select("conv", "part"), lent.withColumn("depth", F.col("pos") + 1).select(*cols).unionByName(kept.select(*cols))


def nodes_of(path: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, parent, conv, part, depth, n_convs, chars) below the root, and (conv, node) where a path ends. Each
    turn's hash holds its depth, so that sums tell sequences, not sets."""
    terms = path.select("conv", "part", "depth", "chars", *halves("t", 3, "depth", "a0", "a1"), *halves("u", 5, "depth", "b0", "b1")).toDF("conv", "part", "depth", "chars", *[f"v{i}" for i in range(4)])
    sums = summed(durable(terms), "conv", "depth", {s: F.col(f"v{i}") for i, s in enumerate(SUMS)})
    above = node_key([F.col(s) - F.col(f"v{i}") for i, s in enumerate(SUMS)], F.col("depth") - 1)
    named = durable(sums.select("conv", "part", "depth", "chars", node_key([F.col(s) for s in SUMS], F.col("depth")).alias("node"), above.alias("parent")))
    # A node has one parent: as a key it costs nothing, and the sums stay in a hash table.
    nodes = named.groupBy("node", "parent").agg(F.min_by("part", "conv").alias("part"), F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    return nodes.select("node", "parent", "conv", "part", "depth", "n_convs", "chars"), named.groupBy("conv").agg(F.max_by("node", "depth").alias("node"))


def ends_hash(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ids in ascending order, joined by commas. ends: (conv, node), ids distinct."""
    spot = ends.withColumn("block", F.shiftright("conv", BLOCK_BITS))
    blocks = spot.groupBy("node", "block").agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    sorted_blocks = blocks.repartition(partitions(ends.sparkSession), "node").sortWithinPartitions("node", "block")

    def digest(stream):
        node, state = None, None
        for batch in stream:
            out: list[list] = [[], []]
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name != node:
                    if state is not None:
                        out[0].append(node)
                        out[1].append(state.hexdigest())
                    node, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return sorted_blocks.select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def peel(nodes: DataFrame) -> DataFrame:
    """(conv, top_parent, leaves, saved) of every run: its subtree's totals once all runs below it have reported.

    nodes: (conv, parent_conv, depth, own_leaves, own_saved); parent_conv is the run of the node above."""
    below = nodes.where("parent_conv is null or parent_conv <> conv").select("conv", "parent_conv", F.col("depth").alias("top"))
    own = nodes.groupBy("conv").agg(F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    waiting = below.groupBy(F.col("parent_conv").alias("conv")).agg(F.count("*").alias("open"))
    runs = durable(own.join(below, "conv").join(waiting, "conv", "left").withColumn("open", F.coalesce("open", F.lit(0).cast("long"))))
    cols = ["conv", "parent_conv", "top", "leaves", "saved"]
    done = runs.where("open = 0").select(*cols)
    finished, still = [done], runs.where("open > 0")
    while still.take(1):
        sent = done.groupBy(F.col("parent_conv").alias("conv")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        told = still.join(sent, "conv", "left").select("conv", "parent_conv", "top", *[(F.col(a) + F.coalesce(b, F.lit(0).cast("long"))).alias(a) for a, b in (("leaves", "more_leaves"), ("saved", "more_saved"))], (F.col("open") - F.coalesce("n", F.lit(0).cast("long"))).alias("open"))
        told = durable(told)
        done, still = told.where("open = 0").select(*cols), told.where("open > 0")
        finished.append(done)
    out = finished[0]
    for x in finished[1:]:
        out = out.unionByName(x)
    return out


def prefix_trie(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, path = rebuilt(conversations, every, heads)
    convs = durable(convs)
    below, ends = nodes_of(path)
    zero = F.lit(0).cast("long")
    root_key = node_key([zero] * 4, zero)
    root = convs.agg(F.min(F.struct("conv", "part")).alias("x"), F.count("*").alias("n_convs")).where("n_convs > 0").select(root_key.alias("node"), F.lit(None).cast("binary").alias("parent"), "x.conv", "x.part", zero.alias("depth"), "n_convs", zero.alias("chars"))
    nodes = durable(below.withColumn("depth", F.col("depth").cast("long")).unionByName(root))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    hashes = ends_hash(convs.select("conv").join(ends, "conv", "left").select("conv", F.coalesce("node", root_key).alias("node")))
    upper = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    full = nodes.join(children, "node", "left").join(hashes, "node", "left").join(upper, "parent", "left")
    full = durable(full.select("node", "conv", "part", "depth", "parent_conv", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("own_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
    runs = durable(peel(full.select("conv", "parent_conv", "depth", "own_leaves", "own_saved")))
    sent = runs.where("parent_conv is not null").groupBy(F.col("parent_conv").alias("conv"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    told = full.join(sent, ["conv", "depth"], "left").withColumn("l", F.col("own_leaves") + F.coalesce("more_leaves", zero)).withColumn("s", F.col("own_saved") + F.coalesce("more_saved", zero)).drop("more_leaves", "more_saved")
    totals = summed(durable(told), "conv", "depth", {"n_leaves": F.col("l"), "saved_tokens": F.col("s")}, descending=True)
    return totals.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
