"""Stores of partitioned Parquet: typed writes, merges that keep the newest row of a key, deletes and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_last(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Old and new rows, one a key: the new one, and of several new ones the first by order. Without an order it is the
    one that comes last in the table's own columns, so that a rerun keeps the same row."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    plain = [F.desc_nulls_last(c) for c, kind in both.dtypes if c not in (*keys, "__src") and not kind.startswith(("map", "variant"))]
    w = Window.partitionBy(*keys).orderBy(F.desc("__src"), *(order or plain))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__src")


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces just the partitions that df holds."""
    df.repartition(*[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], by: list[str]) -> None:
    """Merges new rows into the store: only touched partitions are read and rewritten, through a staged copy."""
    if not exists(spark, path):
        return write_partitions(keep_last(new.limit(0), new, keys), path, by)
    old = spark.read.parquet(path)
    merged = keep_last(old.join(new.select(*by).distinct(), by, "left_semi"), new, keys)
    staged = f"{path}.staged-{uuid.uuid4().hex}"  # its own name, so that two writers do not meet in one
    try:
        merged.write.parquet(staged)
        write_partitions(spark.read.parquet(staged), path, by)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(staged)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete_rows(df: DataFrame, gone: DataFrame, keys: list[str], before: str | None = None, day: str = "session") -> DataFrame:
    """Rows whose key is in gone, all of them or those before the day it names, are left out."""
    if before is None:
        return df.join(gone, keys, "left_anti")
    g = gone.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(before).alias("__before"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    test = F.col(day) < F.col("__before")
    for o in on:
        test = o & test
    return df.join(g, test, "left_anti")


def retain(df: DataFrame, day: str, asof: str, days: int) -> DataFrame:
    return df.where(F.col(day) >= F.date_sub(F.lit(asof).cast("date"), days))


def missing_sessions(calendar: DataFrame, stored: DataFrame) -> DataFrame:
    return calendar.join(stored.select("session").distinct(), "session", "left_anti")


def missing_sessions_by(calendar: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """(by, session) for the sessions between the first and the last stored one of each `by` that it lacks."""
    spans = stored.groupBy(by).agg(F.min("session").alias("__from"), F.max("session").alias("__to"))
    wanted = spans.join(F.broadcast(calendar.select("session")), F.col("session").between(F.col("__from"), F.col("__to"))).select(by, "session")
    return wanted.join(stored.select(by, "session").distinct(), [by, "session"], "left_anti")


def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that new holds come from new alone, as a score module's session does."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_only(ledger: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """A ledger whose rows stay as first written; only unseen keys are added, each once: of several found rows the one that
    comes first in the table's own columns."""
    plain = [F.asc_nulls_last(c) for c, kind in found.dtypes if c not in keys and not kind.startswith(("map", "variant"))]
    found = found.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(plain or [F.lit(0)])))).where("__n = 1").drop("__n")
    return ledger.unionByName(found.join(ledger.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def reconcile(registry: DataFrame, today: DataFrame, key: str, asof: str) -> DataFrame:
    """Registry against today's list: added, active or removed, with the day last seen."""
    r = registry.select(F.col(key).alias("__r"), F.col("last_seen").alias("__seen"))
    t = today.select(F.col(key).alias("__t")).distinct()
    both = r.join(t, F.col("__r") == F.col("__t"), "full_outer")
    status = F.when(F.col("__r").isNull(), "added").when(F.col("__t").isNull(), "removed").otherwise("active")
    return both.select(F.coalesce("__r", "__t").alias(key), status.alias("status"), F.when(F.col("__t").isNotNull(), F.lit(asof).cast("date")).otherwise(F.col("__seen")).alias("last_seen"))
