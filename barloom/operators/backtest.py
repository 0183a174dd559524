"""Exits along price paths: arrays in rows, folded by higher-order functions, or read as matrices, a batch of rows each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from barloom.operators.staged import stored
from barloom.operators.windows import order, with_atr


def with_paths(bars: DataFrame, n: int = 20) -> DataFrame:
    """Per bar: the next open as entry, the day's mean true range, and the next n highs, lows and closes as one array."""
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(1, n)
    out = with_atr(bars, 14, 7)
    path = F.collect_list(F.struct(F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))).over(w)
    return out.withColumn("entry", F.lead("open").over(order())).withColumn("path", path).where(F.col("entry").isNotNull() & F.col("atr").isNotNull())


def fold(path: Column, start: Column, watch, n: int) -> Column:
    """(exit price, bars held): the first price that `watch` gives (null: go on), else the close of bar n or the last.

    watch(state, bar) gives (exit, next state); state starts at `start`."""
    empty = F.struct(F.lit(None).cast("double").alias("out"), F.lit(0).alias("held"), start.alias("state"), F.lit(None).cast("double").alias("last"))

    def step(s: Column, bar: Column) -> Column:
        out, state = watch(s["state"], bar)
        on = F.struct(out.cast("double").alias("out"), (s["held"] + 1).alias("held"), state.cast("double").alias("state"), bar["c"].cast("double").alias("last"))
        return F.when(s["out"].isNotNull(), s).otherwise(on)

    return F.aggregate(F.slice(path, 1, n), empty, step, lambda s: F.struct(F.coalesce(s["out"], s["last"]).alias("price"), s["held"].alias("held")))


def hold(n: int) -> Column:
    p = F.slice("path", 1, n)
    return F.struct(F.get(p, F.size(p) - 1)["c"].alias("price"), F.size(p).alias("held"))


def stop(k: float, n: int = 20) -> Column:
    level = F.col("entry") - k * F.col("atr")
    return fold(F.col("path"), F.lit(0.0), lambda s, b: (F.when(b["l"] <= level, level), s), n)


def bracket(k_stop: float, k_target: float, n: int = 20) -> Column:
    """The stop comes before the target on a bar that touches both."""
    low, high = F.col("entry") - k_stop * F.col("atr"), F.col("entry") + k_target * F.col("atr")
    return fold(F.col("path"), F.lit(0.0), lambda s, b: (F.when(b["l"] <= low, low).when(b["h"] >= high, high), s), n)


def trail(k: float, n: int = 20) -> Column:
    """A stop below the highest close so far."""
    reach = k * F.col("atr")
    return fold(F.col("path"), F.col("entry"), lambda s, b: (F.when(b["l"] <= s - reach, s - reach), F.greatest(s, b["c"])), n)


def below_level(level: Column, slack: float = 0.02, n: int = 20) -> Column:
    return fold(F.col("path"), F.lit(0.0), lambda s, b: (F.when(b["c"] < level * (1 - slack), b["c"]), s), n)


#: The exit rules by name: what ends a trade (nothing, a stop, a bracket, a trail), its multiples of the range, and bars.
RULES = {
    **{f"hold_{n}": ("hold", (), n) for n in (3, 5, 10, 20)},
    **{f"stop{k}_hold20": ("stop", (float(k),), 20) for k in (1, 2)},
    **{f"bracket_{a:g}x{b:g}": ("bracket", (float(a), float(b)), 20) for a, b in ((1, 2), (1, 1.5), (2, 3))},
    **{f"trail_{k:g}": ("trail", (float(k),), 20) for k in (1, 1.5, 2)},
}


def first(hit: np.ndarray) -> np.ndarray:
    """The first bar of each row that hits, from 1; 0 where none does."""
    return np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, 0)


def exits(paths: DataFrame, names: list[str] | None = None, keep: tuple[str, ...] = ("ticker", "session")) -> DataFrame:
    """One row a path and rule: the kept columns, return on the entry and bars held.

    A batch of paths is one matrix of bars, on which every rule is a first hit by row: paths do not become rows, nothing is
    grouped, and a task holds one batch, however many paths there are."""
    rules = {k: RULES[k] for k in names or RULES}
    found = paths.where(F.size("path") > 0).select(*keep, F.col("entry").cast("double"), F.col("atr").cast("double"), "path")
    schema = StructType([*[found.schema[k] for k in keep], StructField("code", IntegerType()), StructField("ret", DoubleType()), StructField("held", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda x: np.asarray(x.to_numpy(zero_copy_only=False), float)
        for batch in (b for b in batches if b.num_rows):
            entry, atr, bars = numbers(batch["entry"]), numbers(batch["atr"]), batch["path"].flatten()
            size = batch["path"].value_lengths().to_numpy()
            there = np.arange(size.max()) < size[:, None]
            high, low, close = (np.full(there.shape, np.nan) for _ in range(3))
            for x, k in ((high, "h"), (low, "l"), (close, "c")):
                x[there] = numbers(bars.field(k))  # a missing price passes no test
            rows, last = np.arange(len(size)), close[np.arange(len(size)), size - 1]
            peak = np.fmax.accumulate(np.c_[entry, close[:, :-1]], axis=1) if any(kind == "trail" for kind, _, _ in rules.values()) else None
            rets, helds = [], []
            for kind, k, n in rules.values():
                at_end = close[:, n - 1] if close.shape[1] >= n else np.nan
                price, held = np.where(np.isnan(at_end), last, at_end), np.minimum(n, size)
                if kind != "hold":
                    base = peak[:, :n] if kind == "trail" else entry[:, None]
                    s = first(low[:, :n] <= base - (k[0] * atr)[:, None])
                    t = first(high[:, :n] >= (entry + k[1] * atr)[:, None]) if kind == "bracket" else np.zeros_like(s)
                    stopped = (s > 0) & ((t == 0) | (s <= t))  # the stop comes first on a bar that touches both
                    level = (peak[rows, np.maximum(s, 1) - 1] if kind == "trail" else entry) - k[0] * atr
                    price = np.where(stopped, level, np.where(t > 0, entry + k[1] * atr, price) if kind == "bracket" else price)
                    held = np.where(stopped, s, np.where(t > 0, t, held))
                with np.errstate(divide="ignore", invalid="ignore"):
                    rets.append(np.where(entry != 0, price / entry - 1, np.nan))
                helds.append(held)
            ret, code = np.concatenate(rets), np.repeat(np.arange(len(rules)), len(size))
            good = np.flatnonzero(~np.isnan(ret))
            of = pa.array(np.tile(rows, len(rules))[good])
            columns = [*[batch[c].take(of) for c in keep], pa.array(code[good], pa.int32()), pa.array(ret[good]), pa.array(np.concatenate(helds)[good], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rule = F.get(F.array(*[F.lit(k) for k in rules]), F.col("code"))
    return found.mapInArrow(run, schema).select(*keep, rule.alias("rule"), "ret", "held")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], step: float = 1e-3, times: Column | None = None) -> DataFrame:
    """Exact quantiles, linear between neighbours, a row a group, in tables that split: rows are counted by ranges of step,
    which tasks sum before they send, and only the values of ranges that hold a wanted rank are dealt and ordered. No task
    holds a group's values. df is read twice. times: how often a row counts (once)."""
    count = F.sum(times if times is not None else F.lit(1)).alias("__n")
    rows = df.where(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double")).withColumn("__range", F.floor(F.col("__v") / step))
    ranges = rows.groupBy(*by, "__range").agg(count)
    up_to = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.withColumn("__to", up_to).withColumn("__from", F.col("__to") - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), ((F.col("__all") - 1) * q).alias("at")) for k, q in shares.items()]))
    asked = ranges.select(*by, "__range", "__from", "__to", places.alias("__q")).where((F.ceil("__q.at") >= F.col("__from")) & (F.floor("__q.at") < F.col("__to")))
    asked = stored(asked)  # two ranges a group and share at most
    inside = Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.join(F.broadcast(asked.select(*by, "__range").distinct()), [*by, "__range"], "left_semi").groupBy(*by, "__range", "__v").agg(count).withColumn("__sum", F.sum("__n").over(inside))
    near = held.join(F.broadcast(asked), [*by, "__range"]).withColumn("__end", F.col("__from") + F.col("__sum")).withColumn("__begin", F.col("__end") - F.col("__n"))
    low, high = F.floor("__q.at"), F.ceil("__q.at")
    value_at = lambda place: F.max(F.when((place >= F.col("__begin")) & (place < F.col("__end")), F.col("__v")))
    each = near.groupBy(*by, F.col("__q.name").alias("__name"), F.col("__q.at").alias("__at")).agg(value_at(low).alias("__low"), value_at(high).alias("__high"))
    each = each.withColumn("__x", F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__at") - F.floor("__at")))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == k, F.col("__x"))).alias(k) for k in shares])


def summary(done: DataFrame) -> DataFrame:
    """Counts, mean, share of gains and quantiles of each rule's trades. Trades are written once; what is dealt is counts by
    rule and bars held, and the values near a quantile."""
    each = stored(done.select("rule", "ret", "held"))
    held = stored(each.groupBy("rule", "held").agg(F.count("*").alias("k"), F.sum("ret").alias("total"), F.count_if(F.col("ret") > 0).alias("gains")))  # some bars a rule
    n = F.sum("k")
    plain = held.groupBy("rule").agg(n.alias("n"), F.try_divide(F.sum("total"), n).alias("mean"), F.try_divide(F.sum("gains"), n).alias("win"))
    returns = quantiles(each, ["rule"], "ret", {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return plain.join(quantiles(held, ["rule"], "held", {"med_held": 0.5}, 1.0, F.col("k")), "rule").join(returns, "rule")


def limit_fill(discount: float, days: int = 3) -> Column:
    """(price, bar) of a limit order under the close: a lower open fills at the open."""
    level = F.col("close") * (1 - discount)
    found = F.filter(F.transform(F.slice("path", 1, days), lambda b, i: F.struct(b["l"].alias("l"), (i + 1).alias("bar"))), lambda b: b["l"] <= level)
    return F.when(F.size(found) > 0, F.struct(level.alias("price"), F.get(found, F.lit(0))["bar"].alias("bar")))


def base_rates(done: DataFrame, keys: list[list[str]], least: int = 8) -> DataFrame:
    """Counts, means and win rates for several lists of keys at once, by grouping sets."""
    every = list(dict.fromkeys(k for ks in keys for k in ks))
    out = done.groupingSets([[F.col(k) for k in ks] for ks in keys], *[F.col(k) for k in every]).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg((F.col("ret") > 0).cast("double")).alias("win"))
    return out.where(F.col("n") >= least)


def liquidity_fifths(bars: DataFrame) -> DataFrame:
    """Fifth of each name's 20-bar median traded value on each session."""
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(-19, 0)
    value = F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).over(w)
    day = Window.partitionBy("session").orderBy("traded", "ticker")
    out = bars.withColumn("traded", value)
    return out.withColumn("fifth", (F.floor((F.row_number().over(day) - 1) * 5 / F.count("*").over(Window.partitionBy("session"))) + 1).cast("long"))


