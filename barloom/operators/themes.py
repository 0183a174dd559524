"""Combining and judging metrics: row means with coverage, correlated doubles, rule subsets, walk-forward choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import correlation, rank_avg, t_stat
from barloom.operators.crosssection import spearman_by


def row_mean(df: DataFrame, parts: dict[str, Column], least_share: float, name: str) -> DataFrame:
    """Mean of the parts that are there; null where fewer than a share of them are."""
    out = df.withColumns({f"__{k}": v for k, v in parts.items()})
    held = sum((F.col(f"__{k}").isNotNull().cast("int") for k in parts), F.lit(0))
    total = sum((F.coalesce(f"__{k}", F.lit(0.0)) for k in parts), F.lit(0.0))
    return out.withColumn(name, F.when(held >= least_share * len(parts), total / held)).drop(*[f"__{k}" for k in parts])


def drop_correlated(df: DataFrame, metrics: list[str], by: str, limit: float) -> DataFrame:
    """Metrics in order of preference: one goes if its rank correlation with a kept one reaches limit. Correlations are
    one aggregate; the choice among some tens of names is the driver's."""
    ranked = df.select(by, *[rank_avg(m, by).alias(m) for m in metrics])
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[:i]]
    row = ranked.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    kept: list[str] = []
    out = []
    for m in metrics:
        near = max(((abs(row[f"{m}|{k}"] or 0.0), k) for k in kept), default=(0.0, None))
        keep = near[0] < limit
        if keep:
            kept.append(m)
        out.append((m, keep, None if keep else near[1]))
    return df.sparkSession.createDataFrame(out, "metric string, kept boolean, like string")


def subsets(df: DataFrame, flags: list[str], outcome: str) -> DataFrame:
    """Every non-empty subset of flags: rows where all of it hold, their mean outcome less that of all rows."""
    masks = range(1, 1 << len(flags))
    test = lambda m: F.expr(" and ".join(f for i, f in enumerate(flags) if m >> i & 1))
    row = df.agg(F.avg(outcome).alias("base"), *[F.struct(F.lit(m).alias("mask"), F.count_if(test(m)).alias("n"), F.avg(F.when(test(m), F.col(outcome))).alias("mean")).alias(f"m{m}") for m in masks])
    each = row.select("base", F.explode(F.array(*[F.col(f"m{m}") for m in masks])).alias("x")).select("x.mask", "x.n", (F.col("x.mean") - F.col("base")).alias("edge"))
    return each.where("n > 0")


def walk_forward(df: DataFrame, metrics: list[str], by: str, outcome: str, folds: int, start: float = 0.4) -> DataFrame:
    """Expanding folds over dates: on each, the metric with the largest t before it is judged on what follows. One plan:
    the IC series is some rows a year, and each fold's rows are found by their dates' numbers."""
    tidy = df.where(F.col(outcome).isNotNull()).unpivot([by, outcome], metrics, "metric", "value").where("value is not null")
    series = spearman_by(tidy, ["metric", by], "value", outcome).where("ic is not null").select("metric", by, "ic")
    every = Window.partitionBy(F.lit(1))
    numbered = series.withColumn("__i", F.dense_rank().over(every.orderBy(by)) - 1).withColumn("__n", F.max("__i").over(every) + 1)
    first = F.floor(F.col("__n") * start)
    edge = lambda k: first + F.floor((F.col("__n") - first) * k / folds)
    spans = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), edge(k).alias("a"), edge(k + 1).alias("b")) for k in range(folds)]))
    each = numbered.withColumn("__f", spans).select("metric", "ic", "__i", "__f.*")
    before = each.where("__i < a and a < b").groupBy("fold", "metric").agg(t_stat("ic").alias("t")).where("t is not null")
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(F.abs("t")), "metric"))
    best = before.withColumn("__k", place).where("__k = 1").select("fold", "metric", "t")
    after = each.where("__i >= a and __i < b").join(F.broadcast(best), ["fold", "metric"])  # a row a fold
    return after.groupBy("fold", F.col("metric").alias("chosen")).agg(F.count("*").alias("n"), F.avg(F.col("ic") * F.signum("t")).alias("ic"))
