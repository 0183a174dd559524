"""What each of five filters removes under every order of applying them.

A document fails a set of filters, one of 32. Under an order, what a step does depends only on which filters came before
and which one is next: an edge of the subset lattice, of which there are 80. Documents are counted by part and set of
failed filters, these counts are added to the edges, and the 600 steps of the 120 orders are looked up among the edges.

A null text is empty, a null source is the part ''. A null doc_id is larger than none: its row never repeats a smaller
one and has no labels. Rows that share a doc_id are documents of their own, and neither repeats the other by its id
alone; labels of one doc_id are taken together. An empty table gives an empty result. Texts are read whole, however
long. Texts are told apart by a 128-bit digest.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import durable

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\t \\n \\v \\f \\r."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda x: x != "")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): the filters A to D that a document fails, as bits 0 to 3."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    held = rows.withColumn("w", words(F.col("text"))).select("doc_id", "part", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("kinds"))
    tests = [F.col("n") < 50, 100 * F.col("kinds") < 65 * F.col("n"), 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.length("text").cast("long"), F.col("text").rlike(r"[#$%&*|]")]
    return held.select("doc_id", "part", "digest", sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).alias("mask"))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents of a part by the set of filters that they fail, E being bit 4."""
    rows = durable(failures(docs))  # texts are read once
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    whole = rows.join(first, "digest").withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).join(known, "doc_id", "left")
    none = F.lit(0).cast("long")
    return whole.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), none).alias("good"), F.coalesce(F.sum("toxic"), none).alias("toxic"))


def lattice() -> list[tuple[int, int, int]]:
    """The 80 edges: filters already applied (bits), the next one (its bit), and how many of the 120 orders pass the edge."""
    n = len(LETTERS)
    return [(s, 1 << f, math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def paths(spark) -> DataFrame:
    """The 600 steps: an order's letters, the step, and the edge that it takes."""
    bit = lambda letters: sum(1 << LETTERS.index(x) for x in letters)
    return spark.createDataFrame([(o, i + 1, bit(o[:i]), bit(o[i])) for o in ORDERS for i in range(len(o))], "filter_order string, step int, before int, next int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step) with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    spark = docs.sparkSession
    masks = counted(docs, labels)
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("next"), F.lit(k).cast("long").alias("orders")) for s, f, k in lattice()]))
    spread = masks.select("*", edge.alias("edge")).select("part", "mask", "docs", "good", "toxic", "edge.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("next")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    sum_if = lambda test, column: F.sum(F.when(test, F.col(column)).otherwise(F.lit(0).cast("long")))
    edges = spread.groupBy("part", "before", "next").agg(
        F.max("orders").alias("orders"), sum_if(~gone & ~fails, "docs").alias("kept"), sum_if(~gone & fails, "docs").alias("removed"), sum_if(gone & fails, "docs").alias("redundant"),
        sum_if(F.col("mask") == F.col("next"), "docs").alias("unique_fails"), sum_if(~gone & fails, "good").alias("good_lost"), sum_if(~gone & fails, "toxic").alias("toxic_lost"),
    )
    shares = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return edges.join(shares, ["part", "next"]).join(F.broadcast(paths(spark)), ["before", "next"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Every order of the five filters over all documents, by source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
