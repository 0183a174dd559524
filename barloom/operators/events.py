"""Events and their outcomes: episodes, filings by owner, 30-day windows, studies against pools and controls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import t_stat


def thin_episodes(df: DataFrame, gap: int, by: str = "ticker", place: str = "bar") -> DataFrame:
    """The first event of each key, then the next that lies at least `gap` places after the last one taken.

    What is taken depends on what was, so no session window gives it; one grouped map over the key's places does."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(place, kind="stable")
        taken, last = [], None
        for p in g[place].tolist():
            take = last is None or p - last >= gap
            taken.append(take)
            last = p if take else last
        return g[taken]

    return df.groupBy(by).applyInPandas(run, df.schema)


def owner_filings(trades: DataFrame) -> DataFrame:
    """Per owner, issuer and day: value, shares, days since the owner's last filing there, rare after two years."""
    day = trades.groupBy("owner", "issuer", "filed").agg(F.sum("value").alias("value"), F.count("*").alias("lines"))
    w = Window.partitionBy("owner", "issuer").orderBy("filed")
    gap = F.datediff("filed", F.lag("filed").over(w))
    return day.withColumn("since", gap).withColumn("rare", gap.isNull() | (gap >= 730))


def routine(trades: DataFrame) -> DataFrame:
    """A filing is routine if its owner filed in the same month of each of the three years before."""
    months = trades.select(F.col("owner").alias("__o"), F.year("filed").alias("__y"), F.month("filed").alias("__m")).distinct()
    w = Window.partitionBy("__o", "__m").orderBy("__y").rangeBetween(-3, -1)
    marked = months.withColumn("routine", F.count("*").over(w) == 3)
    dated = trades.withColumn("__y", F.year("filed")).withColumn("__m", F.month("filed")).withColumn("__o", F.col("owner"))
    return dated.join(marked, ["__o", "__y", "__m"]).drop("__o", "__y", "__m")


def trailing_window(df: DataFrame, by: str, day: str, days: int, who: str, value: str) -> DataFrame:
    """Per key and day: distinct names and value in the `days` days up to it. Days are summed first, so a frame holds one
    row a day."""
    daily = df.groupBy(by, F.col(day).alias("day")).agg(F.collect_set(who).alias("names"), F.sum(value).alias("v"))
    w = Window.partitionBy(by).orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-(days - 1), 0)
    return daily.select(by, "day", F.size(F.array_distinct(F.flatten(F.collect_list("names").over(w)))).cast("long").alias("names"), F.sum("v").over(w).alias("value"))


def track_record(df: DataFrame, owner: str, start: str, end: str, value: str, least: int = 2) -> DataFrame:
    """Mean value of the owner's earlier events that had ended before this one starts, if there are `least`."""
    key = F.col(owner)
    opened = df.select(key.alias("__o"), F.col(start).alias("__t"), F.lit(0).alias("__side"), F.struct(*df.columns).alias("__row"), F.lit(None).cast("double").alias("__v"))
    closed = df.where(F.col(value).isNotNull()).select(key.alias("__o"), F.col(end).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(opened.schema["__row"].dataType).alias("__row"), F.col(value).cast("double").alias("__v"))
    # An end on the day of a start sorts after it: only what ended strictly before counts.
    w = Window.partitionBy("__o").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, -1)
    both = opened.unionByName(closed).withColumn("past_n", F.count("__v").over(w)).withColumn("__mean", F.avg("__v").over(w))
    return both.where("__row is not null").select("__row.*", "past_n", F.when(F.col("past_n") >= least, F.col("__mean")).alias("past_mean"))


def study(df: DataFrame, value: str, pool: str, day: str, by: list[str] | None = None, least: int = 10) -> DataFrame:
    """Excess over the pool in percentage points: mean, median, shares up and above the pool, t over quarter means."""
    by = by or []
    x = df.where(F.col(value).isNotNull() & F.col(pool).isNotNull()).withColumn("__x", (F.col(value) - F.col(pool)) * 100)
    quarters = x.groupBy(*by, F.date_trunc("quarter", day).alias("__q")).agg(F.avg("__x").alias("__m")).groupBy(*by).agg(t_stat("__m").alias("t"), F.count("*").alias("quarters"))
    all_rows = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__x").alias("mean"), F.percentile("__x", F.lit(0.5)).alias("median"), F.avg((F.col(value) > 0).cast("double")).alias("up"), F.avg((F.col("__x") > 0).cast("double")).alias("beat"))
    out = all_rows.join(quarters, by) if by else all_rows.crossJoin(quarters)  # one row each
    return out.where(F.col("n") >= least)


def halves_verdict(df: DataFrame, value: str, day: str, split: str, by: list[str]) -> DataFrame:
    """Train, its two halves, and test: kept if all have one sign and the test's t is 2 or more."""
    x = df.where(F.col(value).isNotNull())
    train = x.where(F.col(day) < F.lit(split))
    middle = train.groupBy(*by).agg(F.percentile(F.datediff(day, F.lit("1970-01-01")), F.lit(0.5)).alias("__mid"))
    t = train.join(middle, by).withColumn("__first", F.datediff(day, F.lit("1970-01-01")) <= F.col("__mid"))
    a = t.groupBy(*by).agg(F.avg(F.when(F.col("__first"), F.col(value))).alias("h1"), F.avg(F.when(~F.col("__first"), F.col(value))).alias("h2"), F.avg(value).alias("train"))
    b = x.where(F.col(day) >= F.lit(split)).groupBy(*by).agg(F.avg(value).alias("test"), t_stat(value).alias("t_test"))
    same = (F.sign("h1") == F.sign("h2")) & (F.sign("h1") == F.sign("test"))
    return a.join(b, by).withColumn("kept", F.coalesce(same & (F.abs("t_test") >= 2), F.lit(False)))


def random_controls(pool: DataFrame, wanted: DataFrame, by: str, seed: int, who: str = "ticker") -> DataFrame:
    """As many rows of the pool as wanted asks for in each group (columns: by, k), by a seeded hash, without replacement. The
    hash is one that every engine has, so that a draw can be repeated elsewhere."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(by).cast("string"), F.col(who).cast("string")).cast("binary"))
    w = Window.partitionBy(by).orderBy(order, who)
    return pool.withColumn("__n", F.row_number().over(w)).join(wanted, by).where("__n <= k").drop("__n", "k")


def upcoming(snapshots: DataFrame, calendar: DataFrame, asof: str, within: int = 10, oldest: int = 7) -> DataFrame:
    """(ticker, day, moment, session, ahead): what the newest snapshot up to asof, if it is no older than `oldest` days,
    expects within so many sessions; ahead counts sessions, 0 being the next one from asof on.

    snapshots: (taken, ticker, day, moment); news after the close (moment amc) moves the session after its day. calendar:
    (session, session_idx)."""
    at = F.lit(asof).cast("date")
    last = snapshots.where((F.col("taken") <= at) & (F.col("taken") >= F.date_sub(at, oldest))).agg(F.max("taken").alias("__last"))
    rows = snapshots.join(F.broadcast(last), F.col("taken") == F.col("__last"), "left_semi").select("ticker", "day", "moment").distinct()
    # Some days ahead, looked up among some sessions: the calendar is bounded by time.
    base = calendar.where(F.col("session") >= at).agg(F.min("session_idx").alias("__base"))
    ahead = calendar.where(F.col("session") >= at).join(F.broadcast(base), how="cross").select("session", (F.col("session_idx") - F.col("__base")).alias("ahead")).where(F.col("ahead") <= within + 1)
    days = rows.select("day", "moment").distinct().where(F.col("day") >= at)
    met = days.join(F.broadcast(ahead), F.when(F.col("moment") == "amc", F.col("session") > F.col("day")).otherwise(F.col("session") >= F.col("day")))
    first = met.groupBy("day", "moment").agg(F.min("session").alias("session"), F.min("ahead").alias("ahead"))
    return rows.join(F.broadcast(first), ["day", "moment"]).where(F.col("ahead") <= within).select("ticker", "day", "moment", "session", "ahead")
