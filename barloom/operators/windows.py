"""Time-series operators: windows partitioned by ticker, in session order, counted in stored rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.functions.ranks import clip, ratio


def rows(n_back: int, n_ahead: int = 0, by: str = "ticker", order: str = "session"):
    return Window.partitionBy(by).orderBy(order).rowsBetween(n_back, n_ahead)


def order(by: str = "ticker", by_time: str = "session"):
    return Window.partitionBy(by).orderBy(by_time)


def full(value: Column, made: Column, n: int, frame) -> Column:
    """made, where the frame holds n non-null values."""
    return F.when(F.count(value).over(frame) == n, made)


def sma(value: str, n: int) -> Column:
    v, frame = F.col(value), rows(-(n - 1))
    return full(v, F.avg(v).over(frame), n, frame)


def wma(value: str | Column, n: int) -> Column:
    """Linear weights, the newest heaviest."""
    v = F.col(value) if isinstance(value, str) else value
    parts = [F.lag(v, n - 1 - i).over(order()) * (i + 1) for i in range(n)] if n > 1 else [v]
    return sum(parts[1:], parts[0]) / (n * (n + 1) / 2)


def with_hma(df: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """Hull average: wma(2 wma(n/2) - wma(n), sqrt n)."""
    step = df.withColumn("__hull", 2 * wma(value, n // 2) - wma(value, n))
    return step.withColumn(name, wma("__hull", int(np.sqrt(n)))).drop("__hull")


def vwma(value: str, volume: str, n: int) -> Column:
    frame = rows(-(n - 1))
    return full(F.col(value), ratio(F.sum(F.col(value) * F.col(volume)).over(frame), F.sum(volume).over(frame)), n, frame)


def linreg_end(value: str, n: int) -> Column:
    """The fitted value at the last bar of a least-squares line over n bars, in closed form."""
    frame, v = rows(-(n - 1)), F.col(value)
    x_mean, x_var = (n - 1) / 2, (n * n - 1) / 12
    total, weighted = F.sum(v).over(frame), F.sum(F.col("__k") * v).over(frame)
    place = weighted - (F.col("__k") - (n - 1)) * total  # sum of place in the frame times value
    slope = (place / n - x_mean * total / n) / x_var
    return full(v, total / n + slope * ((n - 1) - x_mean), n, frame)


def with_linreg(df: DataFrame, value: str, n: int, name: str) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(order())).withColumn(name, linreg_end(value, n)).drop("__k")


def true_range() -> Column:
    """High less low, widened by the last close; the first bar has no last close."""
    before = F.lag("close").over(order())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(df: DataFrame, n: int = 14, least: int = 7, lag: int = 0, name: str = "atr") -> DataFrame:
    """Mean true range of n bars, at least `least` of them, lagged."""
    frame = rows(-(n - 1) - lag, -lag)
    out = df.withColumn("__tr", true_range())
    return out.withColumn(name, F.when(F.count("__tr").over(frame) >= least, F.avg("__tr").over(frame))).drop("__tr")


def with_recursive(df: DataFrame, spans: dict[str, tuple[str, float]]) -> DataFrame:
    """Exponential averages y = y + alpha (x - y), started at the first value; spans names each one's column and alpha.
    Recursive, so one grouped map a ticker for all of them. A ticker's history is bounded by its sessions."""
    schema = StructType([*df.schema.fields, *[StructField(k, DoubleType()) for k in spans]])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("session")
        for name, (value, alpha) in spans.items():
            g[name] = g[value].ewm(alpha=alpha, adjust=False).mean()
        return g

    return df.groupBy("ticker").applyInPandas(run, schema)


def ema_alpha(n: int) -> float:
    return 2 / (n + 1)


def with_rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's index of gains against losses."""
    change = F.col("close") - F.lag("close").over(order())
    moved = df.withColumn("__c", change).where("__c is not null").withColumn("__up", F.greatest("__c", F.lit(0.0))).withColumn("__down", F.greatest(-F.col("__c"), F.lit(0.0))).drop("__c")
    moved = with_recursive(moved, {"__gain": ("__up", 1 / n), "__loss": ("__down", 1 / n)})
    return moved.withColumn("rsi", F.when(F.col("__gain") + F.col("__loss") > 0, 100 * F.col("__gain") / (F.col("__gain") + F.col("__loss")))).drop("__up", "__down", "__gain", "__loss")


def with_squeeze(df: DataFrame, n: int = 20, band: float = 2.0, channel: float = 1.5) -> DataFrame:
    """Bollinger bands (population spread) inside a channel of mean true ranges; released when that ends."""
    frame = rows(-(n - 1))
    out = df.withColumn("__tr", true_range())
    mean, spread, reach = F.avg("close").over(frame), F.stddev_pop("close").over(frame), F.avg("__tr").over(frame)
    inside = (mean - band * spread > mean - channel * reach) & (mean + band * spread < mean + channel * reach)
    out = out.withColumn("squeeze_on", F.when(F.count("close").over(frame) == n, inside)).drop("__tr")
    return out.withColumn("released", F.lag("squeeze_on").over(order()) & ~F.col("squeeze_on"))


def forward_return(h: int) -> Column:
    """Close h sessions ahead over the next open: what a decision at the close can earn."""
    return ratio(F.lead("close", h).over(order()), F.lead("open", 1).over(order())) - 1


def excursions(n: int) -> tuple[Column, Column]:
    """Best high and worst low of the next n bars over the next open."""
    entry, frame = F.lead("open", 1).over(order()), rows(1, n)
    return ratio(F.max("high").over(frame), entry) - 1, ratio(F.min("low").over(frame), entry) - 1


def drawdown(n: int) -> Column:
    """Percent below the highest close of n bars."""
    top = F.max("close").over(rows(-(n - 1)))
    return ratio(top - F.col("close"), top) * 100


def with_step_z(df: DataFrame, n: int = 60, least: int = 20) -> DataFrame:
    """Log return over the spread of the n before it."""
    frame = rows(-n, -1)
    out = df.withColumn("log_ret", F.ln(ratio(F.col("close"), F.lag("close").over(order()))))
    sd = F.stddev_samp("log_ret").over(frame)
    return out.withColumn("step_z", F.when((F.count("log_ret").over(frame) >= least) & (sd > 0), F.col("log_ret") / sd))


def with_swing_low(df: DataFrame, wing: int = 5) -> DataFrame:
    """A low that no bar within `wing` undercuts; known `wing` bars later."""
    frame = rows(-wing, wing)
    return df.withColumn("swing_low", (F.count("low").over(frame) == 2 * wing + 1) & (F.col("low") == F.min("low").over(frame)))


def islands(df: DataFrame, flag: str, gap: int, name: str = "visit", by: str = "ticker", place: str = "bar") -> DataFrame:
    """Rows where flag holds, numbered by visit: a new one begins where more than gap places lie between."""
    hit = df.where(F.col(flag))
    w = Window.partitionBy(by).orderBy(place)
    fresh = (F.col(place) - F.lag(place).over(w) > gap) | F.lag(place).over(w).isNull()
    return hit.withColumn("__new", fresh.cast("int")).withColumn(name, F.sum("__new").over(w)).drop("__new")


def resample(df: DataFrame, unit: str) -> DataFrame:
    """Bars of weeks or months: first open, extremes, last close, sums."""
    return df.groupBy("ticker", F.to_date(F.date_trunc(unit, "session")).alias("period")).agg(F.min_by("open", "session").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "session").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars"))


def with_self_percentile(df: DataFrame, value: str, n: int = 252, least: int = 60, name: str = "self_pct") -> DataFrame:
    """Share of the n values before that lie below this one, in percent."""
    frame = rows(-n, -1)
    earlier = F.collect_list(value).over(frame)
    held = F.size(F.col("__earlier"))
    out = df.withColumn("__earlier", earlier)
    return out.withColumn(name, F.when(held >= least, F.size(F.filter("__earlier", lambda x: x < F.col(value))) / held * 100)).drop("__earlier")


def with_rolling_quantile(df: DataFrame, value: str, n: int, q: float, name: str) -> DataFrame:
    """Linear-interpolated quantile of the n values up to each row, nulls passed over. A window would count all n values
    anew for each row; one grouped map a ticker keeps them ordered and puts one in and takes one out."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("session")
        found = g[value].astype(float).rolling(n, min_periods=1).quantile(q)
        return g.assign(**{name: found.astype("Float64")})

    return df.groupBy("ticker").applyInPandas(run, schema)


def with_market_beta(df: DataFrame, n: int = 120, least: int = 40, cap: float = 5.0) -> DataFrame:
    """Slope of a ticker's returns on the mean return of all, over n bars."""
    out = df.withColumn("__r", ratio(F.col("close"), F.lag("close").over(order())) - 1)
    market = out.groupBy("session").agg(F.avg("__r").alias("__m"))  # a calendar: it grows with time alone
    out = out.join(F.broadcast(market), "session", "left")
    m, a, b = F.col("__m"), F.when(F.col("__m").isNotNull(), F.col("__r")), F.when(F.col("__r").isNotNull(), F.col("__m"))
    sums = {"r": F.count("__r"), "n": F.count(a), "a": F.sum(a), "b": F.sum(b), "ab": F.sum(a * b), "k": F.count(m), "m": F.sum(m), "mm": F.sum(m * m)}
    ends = {"low": (F.min(m), F.least), "high": (F.max(m), F.greatest)}
    step = next(k for k in range(int(n**0.5), 0, -1) if n % k == 0)  # a frame of n rows takes n steps a row, one of blocks their number
    frame = rows(-(step - 1))
    out = out.withColumn("__s", F.struct(*[v.over(frame).alias(k) for k, v in sums.items()], *[v.over(frame).alias(k) for k, (v, _) in ends.items()]))
    out = out.withColumn("__s", F.array("__s", *[F.lag("__s", k).over(order()) for k in range(step, n, step)]))
    part = lambda k: [F.get("__s", F.lit(i))[k] for i in range(n // step)]
    total = lambda k: sum((F.coalesce(x, F.lit(0)) for x in part(k)[1:]), F.coalesce(part(k)[0], F.lit(0)))
    out = out.withColumn("__s", F.struct(*[total(k).alias(k) for k in sums], *[(v(*part(k)) if n > step else part(k)[0]).alias(k) for k, (_, v) in ends.items()]))
    s = {k: F.col(f"__s.{k}") for k in [*sums, *ends]}
    var = ratio(s["mm"] - ratio(s["m"] * s["m"], s["k"]), s["k"] - 1)
    beta = ratio(ratio(s["ab"] - ratio(s["a"] * s["b"], s["n"]), s["n"] - 1), var)
    moves = (s["low"] < s["high"]) & (var > 0)  # sums of equal values leave rounding where there is no spread
    return out.withColumn("beta", F.when((s["r"] >= least) & moves, clip(beta, -3.0, cap))).drop("__r", "__m", "__s")
