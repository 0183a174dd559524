"""Trades on two levels of bars: half-hour slots of the entry day first, whole days after it, one first hit across both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import ratio

BAR = ["open", "high", "low", "close"]


def slots(trades: DataFrame, name: str, time: str, price: str, minutes: int = 30) -> DataFrame:
    """(ticker, day, slot, open, high, low, close) of priced trades; a slot without one has no row."""
    at = F.struct(F.col(time), F.col(price))
    slot = F.floor((F.hour(time) * 60 + F.minute(time)) / minutes).cast("int")
    rows = trades.where(F.col(price) > 0).groupBy(F.col(name).alias("ticker"), F.to_date(time).alias("day"), slot.alias("slot"))
    return rows.agg(F.min(at)[price].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(at)[price].alias("close"))


def days(slot_bars: DataFrame) -> DataFrame:
    """(ticker, day, n, open, high, low, close, slots): each name's days in order, with the day's slots as an array."""
    inner = F.sort_array(F.collect_list(F.struct("slot", *BAR)))  # a day has some slots
    d = slot_bars.groupBy("ticker", "day").agg(F.min_by("open", "slot").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "slot").alias("close"), inner.alias("slots"))
    return d.withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy("day")))


def with_days_after(frame: DataFrame, n: int) -> DataFrame:
    """days with the next n days' bars as an array `after`."""
    ahead = Window.partitionBy("ticker").orderBy("day").rowsBetween(1, n)
    return frame.withColumn("after", F.collect_list(F.struct(*BAR)).over(ahead))


def first_exit(path: Column, stop: Column, target: Column, inside: Column) -> Column:
    """(price, bars, kind) of the first bar of path that ends the trade, null if none does; path begins with the entry bar.

    A later bar that opens beyond the stop or the target ends it at its open; else the stop counts before the target. On
    the entry bar there is no gap, and if the entry was filled inside the bar its high may have come before the fill, so
    that only the stop counts."""
    shape = lambda price, kind: F.struct(price.cast("double").alias("price"), F.lit(kind).alias("kind"))

    def look(b: Column, i: Column) -> Column:
        later = i > 0
        end = F.when(later & (b["open"] <= stop), shape(b["open"], "stop")).when(later & (b["open"] >= target), shape(b["open"], "target"))
        end = end.when(b["low"] <= stop, shape(stop, "stop")).when((b["high"] >= target) & (later | ~inside), shape(target, "target"))
        return F.struct((i + 1).alias("bars"), end.alias("end"))

    hits = F.filter(F.transform(path, look), lambda x: x["end"].isNotNull())
    first = F.get(hits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["end"]["price"].alias("price"), first["bars"].alias("bars"), first["end"]["kind"].alias("kind")))


def plain(bars: Column) -> Column:
    """Slots or days as bars of one shape, so that they can follow each other in one path."""
    return F.transform(bars, lambda b: F.struct(*[b[c].alias(c) for c in BAR]))


def settled(entries: DataFrame, gain: float, loss: float, hold: int) -> DataFrame:
    """(ticker, day, price, ret, bars, kind) of entries: (ticker, day, slot, price, inside, slots, after) with the entry day's
    slots and the days after it. Without a hit the trade ends at the close of the hold-th day, the entry's being the first,
    or at the last close there is."""
    same_day = plain(F.filter("slots", lambda b: b["slot"] >= F.col("slot")))
    path = F.concat(same_day, plain(F.slice("after", 1, hold - 1)))
    out = entries.withColumn("__path", path).withColumn("__end", first_exit(F.col("__path"), F.col("price") * (1 - loss), F.col("price") * (1 + gain), F.col("inside")))
    last = F.element_at("__path", -1)["close"]
    return out.select("ticker", "day", "price", (ratio(F.coalesce("__end.price", last), F.col("price")) - 1).alias("ret"), F.coalesce("__end.bars", F.size("__path")).alias("bars"), F.coalesce("__end.kind", F.lit("time")).alias("kind"))


def after_open(day_bars: DataFrame, from_slot: int, gain: float, loss: float, hold: int) -> DataFrame:
    """A trade a day, entered at the open of its first slot from from_slot on; a day without such a slot has none."""
    first = F.get(F.filter("slots", lambda b: b["slot"] >= from_slot), F.lit(0))
    entries = with_days_after(day_bars, max(1, hold - 1)).withColumn("__first", first).where("__first is not null")
    return settled(entries.select("ticker", "day", F.col("__first.slot").alias("slot"), F.col("__first.open").alias("price"), F.lit(False).alias("inside"), "slots", "after"), gain, loss, hold)


def limit_orders(day_bars: DataFrame, discount: float, through: float, wait: int, gain: float, loss: float, hold: int) -> DataFrame:
    """A buy order each day at a discount to its close, good for the next `wait` days, followed slot by slot: it fills at a
    slot's open at or below the limit, or at the limit where the low goes through it by `through`. (signal, and settled's
    columns); an order that never fills has no row."""
    orders = day_bars.select("ticker", F.col("day").alias("signal"), F.col("n").alias("__n"), (F.col("close") * (1 - discount)).alias("limit"))
    ahead = with_days_after(day_bars, max(1, hold - 1)).select("ticker", "day", "n", "slots", "after")
    # An order meets at most `wait` days: each is asked for by its number.
    asked = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(wait))).alias("__k")).withColumn("n", F.col("__n") + F.col("__k"))
    met = asked.join(ahead, ["ticker", "n"])
    fills = F.filter(F.transform("slots", lambda b: F.struct(b["slot"].alias("slot"), F.when(b["open"] <= F.col("limit"), b["open"]).when(b["low"] <= F.col("limit") * (1 - through), F.col("limit")).alias("price"), (b["open"] > F.col("limit")).alias("inside"))), lambda x: x["price"].isNotNull())
    filled = met.withColumn("__fill", F.get(fills, F.lit(0))).where("__fill is not null")
    first = filled.withColumn("__r", F.row_number().over(Window.partitionBy("ticker", "signal").orderBy("__k"))).where("__r = 1")
    entries = first.select("ticker", "signal", "day", F.col("__fill.slot").alias("slot"), F.col("__fill.price").alias("price"), F.col("__fill.inside").alias("inside"), "slots", "after")
    done = settled(entries.withColumn("ticker", F.struct("ticker", "signal")), gain, loss, hold)
    return done.select(F.col("ticker.ticker").alias("ticker"), F.col("ticker.signal").alias("signal"), "day", "price", "ret", "bars", "kind")
