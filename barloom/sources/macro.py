"""Macro series as they were published: observations with vintages, release calendars, index files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The feed's end of a vintage that is still valid.
OPEN_END = "9999-12-31"


def number(c: str) -> Column:
    """A number, or null for what is none (the feed writes a dot)."""
    return F.expr(f"try_cast(trim({c}) as double)")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """(series, obs_date, value, realtime_start, realtime_end) of JSON pages; a page's file name, up to its first dot or
    dash, names its series. Values that are no numbers go; a page without vintages is valid from its own date on."""
    item = "struct<realtime_start: string, realtime_end: string, date: string, value: string>"
    pages = spark.read.schema(f"observations array<{item}>").option("multiLine", True).json(path)
    each = pages.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)[.-][^/]*$", 1).alias("series"), F.explode("observations").alias("o"))
    day = lambda c: F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    out = each.select("series", day("o.date").alias("obs_date"), number("o.value").alias("value"), F.coalesce(day("o.realtime_start"), day("o.date")).alias("realtime_start"), F.coalesce(day("o.realtime_end"), F.lit(OPEN_END).cast("date")).alias("realtime_end"))
    return out.where("obs_date is not null and value is not null")


def release_dates(spark: SparkSession, path: str, names: dict[int, str]) -> DataFrame:
    """(date, release) of the named releases, past and to come, from JSON pages; each date once."""
    pages = spark.read.schema("release_dates array<struct<release_id: int, date: string>>").option("multiLine", True).json(path)
    known = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    each = pages.select(F.explode("release_dates").alias("r")).select(F.to_date("r.date").alias("date"), F.try_element_at(known, F.col("r.release_id")).alias("release"))
    return each.where("release is not null and date is not null").distinct()


def policy_index(spark: SparkSession, path: str) -> DataFrame:
    """(session, value) of a CSV with year, month and day columns; its closing notes, which hold no date, go."""
    raw = spark.read.option("header", True).csv(path)
    part = lambda c: F.expr(f"try_cast({c} as int)")
    day = F.try_make_date(part("year"), part("month"), part("day")) if hasattr(F, "try_make_date") else F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", part("year"), part("month"), part("day")), F.lit("yyyy-MM-dd")))
    return raw.select(day.alias("session"), number("daily_policy_index").alias("value")).where("session is not null and value is not null")


def risk_index(spark: SparkSession, path: str) -> DataFrame:
    """(session, value) of a CSV export whose date column begins with `date` and whose value is GPRD, or else GPR. The
    source's own workbook must be saved as CSV first."""
    raw = spark.read.option("header", True).csv(path)
    day = next((c for c in raw.columns if c.lower().startswith("date")), raw.columns[0])
    value = next((c for name in ("GPRD", "GPR") for c in raw.columns if c.upper() == name), None)
    if value is None:
        raise ValueError(f"no GPRD or GPR column among {raw.columns}")
    parsed = F.coalesce(*[F.to_date(F.try_to_timestamp(F.col(f"`{day}`"), F.lit(p))) for p in ("yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd")])
    return raw.select(parsed.alias("session"), number(f"`{value}`").alias("value")).where("session is not null and value is not null")


def known_on(vintages: DataFrame, days: DataFrame, day: str = "session") -> DataFrame:
    """(series, day, obs_date, value): on each day the newest observation published by then, in the vintage of that day.

    A bitemporal as-of: obs_date is the value's own time, realtime_start to realtime_end when the number stood. Both sides
    are united by series and the largest (obs_date, realtime_start) so far is carried forward, so that work is linear in
    vintages and days. A number that was withdrawn before the day, with none in its place, is null."""
    each = days.select(F.col(day).alias("__day")).distinct()
    # Series are some tens; each gets a row a day, which is the result's own size.
    wanted = vintages.select("series").distinct().join(F.broadcast(each), how="cross").select("series", F.col("__day").alias("__time"), F.lit(1).alias("__side"))
    told = vintages.select("series", F.col("realtime_start").alias("__time"), F.lit(0).alias("__side"), F.struct("obs_date", "realtime_start", "realtime_end", "value").alias("__v"))
    seen = Window.partitionBy("series").orderBy("__time", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = told.unionByName(wanted, allowMissingColumns=True).withColumn("__best", F.max("__v").over(seen)).where("__side = 1 and __best is not null")
    stood = F.col("__best.realtime_end") >= F.col("__time")
    return both.select("series", F.col("__time").alias(day), "__best.obs_date", F.when(stood, F.col("__best.value")).alias("value"))


def sessions_to_release(calendar: DataFrame, releases: DataFrame) -> DataFrame:
    """(session, release, ahead): sessions until each release's next date, 0 on its day. calendar: (session, session_idx)."""
    names = releases.select("release").distinct()
    grid = calendar.join(F.broadcast(names), how="cross")  # some sessions a year for some releases
    days = releases.select("release", F.col("date").alias("session"), F.lit(1).alias("__side"))
    both = grid.withColumn("__side", F.lit(0)).unionByName(days, allowMissingColumns=True)
    later = Window.partitionBy("release").orderBy(F.desc("session"), F.desc("__side"))
    # Counted from the far end: a release's rows reset the count of sessions after it.
    last = F.last(F.when(F.col("__side") == 1, F.col("session")), ignorenulls=True).over(later)
    found = both.withColumn("__next", last).where("__side = 0 and __next is not null")
    span = Window.partitionBy("release", "__next").orderBy(F.desc("session"))
    on_day = F.max((F.col("session") == F.col("__next")).cast("int")).over(Window.partitionBy("release", "__next"))
    return found.select("session", "release", (F.row_number().over(span) - on_day).cast("long").alias("ahead"))
