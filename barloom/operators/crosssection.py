"""Cross-sections: ranks, thirds, pools and information coefficients by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import correlation, quantile, rank_avg, rank_pct, t_stat


def spearman_by(df: DataFrame, by: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Rank correlation of each group on rows that have both values; null below `least` pairs."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumn("__x", rank_avg(x, *by)).withColumn("__y", rank_avg(y, *by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, correlation("__x", "__y")).alias("ic"))


def ic_summary(series: DataFrame, horizon: int | Column, spacing: int, by: list[str] | None = None) -> DataFrame:
    """Mean, t with as many independent dates as the horizon leaves, hit rate and ratio of an IC series. A correlation within rounding of zero is no hit."""
    n, mean, sd = F.count("ic"), F.avg("ic"), F.stddev_samp("ic")
    ahead = F.max(horizon) if isinstance(horizon, Column) else F.lit(horizon)  # a column that is one value a group
    n_eff = F.greatest(F.lit(2.0), n / F.greatest(F.lit(1.0), ahead / spacing))
    return series.groupBy(*(by or [])).agg(n.alias("n_dates"), mean.alias("ic"), F.when(sd > 0, mean / (sd / F.sqrt(n_eff))).alias("t"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("hit"), F.when(sd > 0, mean / sd).alias("ir"))


def quantile_spread(df: DataFrame, by: list[str], metric: str, outcome: str, q: int = 5) -> DataFrame:
    """Mean outcome of the top bin less that of the bottom, by group; bins of equal count, ties by ticker; groups of
    3 q rows or more."""
    both = df.where(F.col(metric).isNotNull() & F.col(outcome).isNotNull())
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(metric, "ticker"))
    n = F.count("*").over(w)
    binned = both.withColumn("__n", n).withColumn("__bin", F.floor((place - 1) * q / n)).where(F.col("__n") >= 3 * q)
    top, low = F.avg(F.when(F.col("__bin") == q - 1, F.col(outcome))), F.avg(F.when(F.col("__bin") == 0, F.col(outcome)))
    return binned.groupBy(*by).agg((top - low).alias("spread"), F.count("*").alias("n"))


def with_thirds(df: DataFrame, value: str, by: list[str], name: str = "third") -> DataFrame:
    """3 above the upper tercile, 1 at or below the lower, else 2."""
    low, high = quantile(value, 1 / 3, *by), quantile(value, 2 / 3, *by)
    v = F.col(value)
    out = df.withColumn("__low", low).withColumn("__high", high)
    return out.withColumn(name, F.when(v > F.col("__high"), 3).when(v <= F.col("__low"), 1).when(v.isNotNull(), 2)).drop("__low", "__high")


def neutral_spread(df: DataFrame, by: str, score: str, control: str, outcome: str, least_sides: int = 2) -> DataFrame:
    """Top less bottom third of the score inside thirds of the control, averaged where two of them can tell."""
    inner = with_thirds(with_thirds(df, control, [by], "__c").where("__c is not null"), score, [by, "__c"], "__s")
    each = inner.groupBy(by, "__c").agg((F.avg(F.when(F.col("__s") == 3, F.col(outcome))) - F.avg(F.when(F.col("__s") == 1, F.col(outcome)))).alias("d"))
    return each.groupBy(by).agg(F.when(F.count("d") >= least_sides, F.avg("d")).alias("spread"))


def leave_one_out(df: DataFrame, value: str, by: list[str], least: int = 3, name: str = "peers") -> DataFrame:
    """Mean of the group's other rows, if at least so many."""
    w = Window.partitionBy(*by)
    own, n, total = F.col(value), F.count(value).over(w), F.sum(value).over(w)
    others = n - F.when(own.isNotNull(), 1).otherwise(0)
    return df.withColumn(name, F.when(others >= least, (total - F.coalesce(own, F.lit(0.0))) / others))


def group_returns(df: DataFrame, by: list[str], value: str, least: int) -> DataFrame:
    """Equal-weighted mean by group; null below `least` members."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("members"), F.when(F.count("*") >= least, F.avg(value)).alias("ret"))


def composite(df: DataFrame, parts: list[tuple[str, int, float]], by: str, name: str = "score") -> DataFrame:
    """Weighted mean of rank shares, times 100; parts are (column, direction, weight). One null makes the score null."""
    total = sum(w for _, _, w in parts)
    made = None
    for i, (column, direction, weight) in enumerate(parts):
        df = df.withColumn(f"__r{i}", rank_pct(F.col(column) * direction, by))
        part = F.col(f"__r{i}") * (weight / total)
        made = part if made is None else made + part
    return df.withColumn(name, made * 100).drop(*[f"__r{i}" for i in range(len(parts))])


def winsor_rank(df: DataFrame, value: str, sector: str, by: str, least: int = 5, name: str = "rank") -> DataFrame:
    """Rank share within the sector after holding values inside its 1st and 99th percentiles; within the market where the
    sector has too few."""
    n = F.count(value).over(Window.partitionBy(by, sector))
    held = lambda *g: F.greatest(quantile(value, 0.01, *g), F.least(quantile(value, 0.99, *g), F.col(value)))
    df = df.withColumn("__s", F.when(F.col(value).isNotNull(), held(by, sector))).withColumn("__m", F.when(F.col(value).isNotNull(), held(by))).withColumn("__n", n)
    df = df.withColumn("__rs", rank_pct("__s", by, sector)).withColumn("__rm", rank_pct("__m", by))
    return df.withColumn(name, F.when(F.col("__n") >= least, F.col("__rs")).otherwise(F.col("__rm"))).drop("__s", "__m", "__n", "__rs", "__rm")


def turnover(df: DataFrame, by: str, metric: str, top: int, spacing_order: str) -> DataFrame:
    """One less the share of the last date's top names that stay, by date."""
    w = Window.partitionBy(by).orderBy(F.desc(metric), "ticker")
    names = df.where(F.col(metric).isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top)
    dates = names.select(by, spacing_order).distinct().withColumnRenamed(spacing_order, "__i")
    kept = names.join(dates, by)
    before = kept.select("ticker", (F.col("__i") + 1).alias("__i"), F.lit(1).alias("__was"))
    return kept.join(before, ["ticker", "__i"], "left").groupBy(by, "__i").agg((1 - F.sum(F.coalesce("__was", F.lit(0))) / F.count("*")).alias("turnover")).where("__i > 1").drop("__i")


def session_t(df: DataFrame, by: str, value: str) -> DataFrame:
    """t over the means of calendar quarters: rows of one quarter share their market."""
    quarters = df.groupBy(F.date_trunc("quarter", by).alias("q")).agg(F.avg(value).alias("m"), F.count(value).alias("k"))
    return quarters.agg(F.sum("k").alias("n"), F.count("m").alias("quarters"), F.avg("m").alias("mean"), t_stat("m").alias("t"))
