"""Point-in-time joins. Every one is an equi join on a key, then a window or an aggregate: no theta join over all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StructField, StructType


def backward(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], tolerance_days: int | None = None, strict: bool = False) -> DataFrame:
    """Each left row with the values of the newest right row at or before it (before it, if strict) with the same key.

    Both sides are united and sorted once a key, and the last right row is carried forward; the work is linear in the rows
    of a key, where an equi join would make a row for each pair."""
    carried = F.struct(F.col(right_time).alias("__at"), *[F.col(v) for v in values])
    a = left.select(F.col(by).alias("__by"), F.col(left_time).alias("__time"), F.lit(0 if strict else 1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"))
    b = right.where(F.col(right_time).isNotNull()).select(F.col(by).alias("__by"), F.col(right_time).alias("__time"), F.lit(1 if strict else 0).alias("__side"), carried.alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = Window.partitionBy("__by").orderBy("__time", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("__last", F.last("__right", ignorenulls=True).over(seen)).where("__left is not null")
    keep = F.lit(True) if tolerance_days is None else F.col("__last.__at") >= F.date_sub(F.col("__time").cast("date"), tolerance_days)
    return last.select("__left.*", *[F.when(keep, F.col(f"__last.{v}")).alias(v if v not in left.columns else f"{v}_right") for v in values])


def next_session(df: DataFrame, calendar: DataFrame, day: str, name: str, at_or_after: bool = False) -> DataFrame:
    """The first session after a day (or at it). The calendar is a small dimension; days are looked up by one window."""
    days = df.select(F.col(day).alias("__day")).distinct()
    marks = days.select("__day", F.lit(None).cast("date").alias("__s")).unionByName(calendar.select(F.col("session").alias("__day"), F.col("session").alias("__s")))
    side = F.when(F.col("__s").isNull(), 0 if at_or_after else 1).otherwise(1 if at_or_after else 0)
    # The calendar and the distinct days are bounded by time, not by rows; by month the window is split, and months
    # without a later session take the next month's first.
    ahead = Window.partitionBy("__month").orderBy("__day", "__side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = marks.withColumn("__side", side).withColumn("__month", F.trunc("__day", "month")).withColumn("__next", F.min("__s").over(ahead))
    firsts = calendar.groupBy(F.trunc("session", "month").alias("__m")).agg(F.min("session").alias("__first"))
    later = firsts.withColumn("__first", F.lead("__first").over(Window.orderBy("__m")))
    months = found.where("__s is null").join(later, F.col("__month") == F.col("__m"), "left")
    table = months.select("__day", F.coalesce("__next", "__first").alias(name))
    return df.join(table, F.col(day) == F.col("__day"), "left").drop("__day")


def neighbours_within(df: DataFrame, by: str, time: str, days: int, value: str, own: str) -> DataFrame:
    """Median value of rows of other owners within +-days of each row, with the same key, and how many there are.

    Rows are dealt by key and block of days, with the days on both sides of it, so that none goes to more than two blocks.
    A block orders the values around a day once, and each owner of that day passes over its own: the work of a day grows
    with the rows around it, not with that number times the day's own rows. Rows without key, day or owner have no peers."""
    block = 2 * days + 1
    dated = isinstance(df.schema[time].dataType, DateType)  # days go to Python as numbers alone
    schema = StructType([*[x for x in df.schema.fields if not (dated and x.name == time)], StructField("__day", IntegerType()), StructField("n_peers", LongType()), StructField("peer_median", DoubleType())])
    known = F.col(by).isNotNull() & F.col(time).isNotNull() & F.col(own).isNotNull()
    day = F.datediff(F.col(time), F.lit("1970-01-01"))
    dealt = df.where(known).withColumn("__day", day).withColumn("__home", F.floor(F.col("__day") / block))
    dealt = dealt.withColumn("__block", F.explode(F.array_distinct(F.array(F.floor((F.col("__day") - days) / block), F.floor((F.col("__day") + days) / block)))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("__day", kind="stable").reset_index(drop=True)
        at, v = g["__day"].to_numpy(), g[value].to_numpy(float)
        who = pd.factorize(g[own])[0]
        home = (g["__home"] == g["__block"]).to_numpy()
        n, middle = np.zeros(len(g), np.int64), np.full(len(g), np.nan)
        for d in np.unique(at[home]):
            lo, first, past, hi = np.searchsorted(at, [d - days, d, d + 1, d + days + 1])
            owners, mine = np.unique(who[first:past], return_inverse=True)
            n[first:past], middle[first:past] = (x[mine] for x in others_median(v[lo:hi], who[lo:hi], owners))
        out = g[home].drop(columns=["__home", "__block"])
        return out.assign(n_peers=n[home], peer_median=pd.Series(middle[home], out.index, "Float64").where(~np.isnan(middle[home])))

    alone = df.where(~known).withColumn("n_peers", F.lit(0).cast("long")).withColumn("peer_median", F.lit(None).cast("double"))
    out = (dealt.drop(time) if dated else dealt).groupBy(by, "__block").applyInPandas(run, schema)
    if dated:
        out = out.withColumn(time, F.date_add(F.lit("1970-01-01").cast("date"), F.col("__day")))
    return out.drop("__day").unionByName(alone).select(*df.columns, "n_peers", "peer_median")


def others_median(v: np.ndarray, who: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `owners` (ascending) how many rows others have, and the median of those with a value; NaN below two rows."""
    rows = len(who) - np.bincount(who, minlength=owners[-1] + 1)[owners]
    held = ~np.isnan(v)
    v, who = v[held], who[held]
    order = np.argsort(v, kind="stable")
    v, who = v[order], who[order]
    spot = np.minimum(np.searchsorted(owners, who), len(owners) - 1)
    place = np.flatnonzero(owners[spot] == who)  # ordered places of the rows that some owner passes over
    spot = spot[place]
    taken = np.bincount(spot, minlength=len(owners))
    turn = np.argsort(spot, kind="stable")
    before = np.empty(len(place), np.int64)  # how many of its own an owner passes over before each
    before[turn] = np.arange(len(place)) - np.repeat(np.cumsum(taken) - taken, taken)
    left = len(v) - taken
    told = (rows >= 2) & (left > 0)

    def nth(k: np.ndarray) -> np.ndarray:
        k = k + np.bincount(spot[place - before <= k[spot]], minlength=len(owners))
        return v[np.where(told, k, 0)] if len(v) else np.full(len(owners), np.nan)

    return rows, np.where(told, (nth((left - 1) // 2) + nth(left // 2)) / 2, np.nan)


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order, which should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
