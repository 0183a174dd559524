"""Luck measured: same-size random draws by a seeded arithmetic hash, placebo dates, and rules chosen on one period alone.

Draws follow integers that any engine computes alike, so that they can be checked and repeated."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import ratio, t_stat

#: A prime below 2^31: products of two residues stay within 64 bits.
PRIME = 2147483647
WHO, WHEN, TURN, MORE = 7919, 104729, 1299709, 12345


def mixed(who, when, turn):
    """The draw's order for name numbers, date numbers and replicates, as columns, integers or arrays."""
    x = (who % PRIME * WHO + when % PRIME * WHEN) % PRIME
    x = (x + turn * TURN) % PRIME
    x = x * x % PRIME
    return (x + turn) * (x + MORE) % PRIME


def against_draws(pool: DataFrame, rules: list[str], day: str, number: str, outcome: str, draws: int = 1000, least: int = 3, who: str = "ticker") -> DataFrame:
    """How the picks of each rule (a boolean column of pool) did against their dates' pool: dates, picks, hit rates, share
    above the pool's median, mean excess with its t over dates, excess of the first and second half of the dates, and the
    share of `draws` same-size draws without replacement that did as well or better.

    A date counts for a rule with `least` picks or more. One group is one date's names; all rules share a replicate's
    order, of which a rule takes its first k. Nothing is multiplied by the number of draws but (date, rule) sums."""
    rows = pool.where(F.col(outcome).isNotNull()).select(F.col(day).alias("day"), F.col(number).cast("long").alias("number"), F.col(who).cast("long").alias("who"), F.col(outcome).cast("double").alias("out"), *[F.coalesce(F.col(x), F.lit(False)).alias(x) for x in rules])
    date = Window.partitionBy("day")
    rows = rows.withColumn("middle", F.percentile("out", F.lit(0.5)).over(date)).withColumn("mean", F.avg("out").over(date)).withColumn("up", F.avg((F.col("out") > 0).cast("double")).over(date))
    picks = rows.select("day", "out", "middle", "mean", "up", F.explode(F.filter(F.array(*[F.when(F.col(x), F.lit(x)) for x in rules]), lambda x: x.isNotNull())).alias("rule"))
    share = lambda test: F.avg(test.cast("double"))
    dates = picks.groupBy("rule", "day").agg(F.count("*").alias("k"), (F.avg("out") - F.max("mean")).alias("excess"), share(F.col("out") > 0).alias("hit"), F.max("up").alias("pool_hit"), share(F.col("out") > F.col("middle")).alias("beat")).where(F.col("k") >= least)
    place = F.row_number().over(Window.partitionBy("rule").orderBy("day"))  # dates of a rule: some a year
    early = place <= F.floor(F.count("*").over(Window.partitionBy("rule")) / 2)
    found = dates.withColumn("early", early).groupBy("rule").agg(
        F.count("*").alias("dates"), F.sum("k").alias("picks"), F.avg("hit").alias("hit"), F.avg("pool_hit").alias("pool_hit"), F.avg("beat").alias("beat"), F.avg("excess").alias("excess"), t_stat("excess").alias("t"),
        F.avg(F.when(F.col("early"), F.col("excess"))).alias("first_half"), F.avg(F.when(~F.col("early"), F.col("excess"))).alias("second_half"),
    )

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("who")
        out, names = g["out"].to_numpy(), g["who"].to_numpy()
        sizes = {i: k for i, x in enumerate(rules) if (k := int(g[x].sum())) >= least}
        turn, rule, excess = [], [], []
        for at in range(0, draws if sizes else 0, 100):
            r = np.arange(at, min(at + 100, draws))
            order = mixed(names[None, :], int(g["number"].iloc[0]), r[:, None]).argsort(axis=1, kind="stable")
            total = np.cumsum(out[order], axis=1)
            for x, k in sizes.items():
                turn += r.tolist()
                rule += [x] * len(r)
                excess += (total[:, k - 1] / k - out.mean()).tolist()
        return pd.DataFrame({"rule": np.array(rule, np.int32), "turn": np.array(turn, np.int64), "excess": np.array(excess, float)})

    drawn = rows.select("day", "number", "who", "out", *rules).groupBy("day").applyInPandas(draw, "rule int, turn long, excess double").withColumn("rule", F.get(F.array(*map(F.lit, rules)), F.col("rule")))
    luck = drawn.groupBy("rule", "turn").agg(F.avg("excess").alias("drawn")).join(found.select("rule", "excess"), "rule").groupBy("rule").agg(share(F.col("drawn") >= F.col("excess") - 1e-9).alias("p"))
    return found.join(luck, "rule")


def clear_dates(events: DataFrame, key: list[str], span: DataFrame, within: int = 250, clear: int = 10, wanted: int = 5, tries: int = 20, ahead: int = 20) -> DataFrame:
    """(event, key columns, place): up to `wanted` placebo places of the same name, at most `within` bars away and more
    than `clear` from any event of the key, in the order of seeded tries.

    events: (event long, key columns, place long); span: (first key column, bars) of each name. Events are dealt to
    buckets one clearance wide and their neighbours, so that the interval test is a join on equal keys; a name of many
    events is many buckets."""
    width = 2 * clear + 1
    turn = F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("turn")
    tried = events.select("event", *key, "place", turn).withColumn("turn", F.col("turn").cast("long"))
    tried = tried.withColumn("at", F.col("place") - within + mixed(F.col("event"), F.col("place"), F.col("turn")) % (2 * within + 1))
    inside = tried.join(span, key[0]).where((F.col("at") >= 1) & (F.col("at") <= F.col("bars") - ahead)).withColumn("bucket", F.floor(F.col("at") / width))
    busy = events.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("place").alias("__place"), F.explode(F.array(*[F.floor(F.col("place") / width) + i for i in (-1, 0, 1)])).alias("__bucket")).distinct()
    same = F.col("bucket") == F.col("__bucket")
    for k in key:
        same = same & (F.col(k) == F.col(f"__{k}"))
    free = inside.join(busy, same & (F.abs(F.col("at") - F.col("__place")) <= clear), "left_anti")
    order = Window.partitionBy("event").orderBy("turn")
    once = free.groupBy("event", *key, "at").agg(F.min("turn").alias("turn")).withColumn("n", F.row_number().over(order))
    return once.where(F.col("n") <= wanted).select("event", *key, F.col("at").alias("place"))


def k_of_n(flags: list[str]) -> list[tuple[str, int, int, int]]:
    """(name, bits of the flags, how many there are, how many must hold): every subset with every count."""
    out = []
    for n in range(1, len(flags) + 1):
        for sub in itertools.combinations(range(len(flags)), n):
            names = [flags[i] for i in sub]
            out += [(" & ".join(names) if k == n else f"{k}+ of {', '.join(names)}", sum(1 << i for i in sub), n, k) for k in range(1, n + 1)]
    return out


def chosen_rule(df: DataFrame, flags: list[str], outcome: str, day: str, split: str, least: int = 30) -> DataFrame:
    """Every k-of-n rule over the flags on the period before split, the best of them by t, and that one alone after it.

    One pass counts and sums rows by period, quarter and the set of flags that hold (at most 2^n sets); a rule's figures
    are sums over the sets that meet it. t is over quarter means. Ties (to six digits) go to fewer flags, then a lower count, then name."""
    rules = k_of_n(flags)
    mask = sum((F.when(F.coalesce(F.col(x), F.lit(False)), 1 << i).otherwise(0) for i, x in enumerate(flags)), F.lit(0))
    base = df.where(F.col(outcome).isNotNull()).groupBy((F.col(day) >= F.lit(split)).alias("test"), F.date_trunc("quarter", day).alias("q"), mask.alias("mask")).agg(F.count("*").alias("n"), F.sum(outcome).alias("total"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bits).alias("bits"), F.lit(n).alias("size"), F.lit(k).alias("k")) for name, bits, n, k in rules])).alias("r")
    met = base.select("*", each).where(F.bit_count(F.col("mask").bitwiseAND(F.col("r.bits"))) >= F.col("r.k"))
    quarters = met.groupBy("r.rule", "r.size", "r.k", "test", "q").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("mean", ratio(F.col("total"), F.col("n")))
    halves = quarters.groupBy("rule", "size", "k", "test").agg(F.sum("n").alias("n"), ratio(F.sum("total"), F.sum("n")).alias("mean"), t_stat("mean").alias("t"))
    train = halves.where("not test").select("rule", "size", "k", F.col("n").alias("train_n"), F.col("mean").alias("train_mean"), F.col("t").alias("train_t"))
    fit = (F.col("train_n") >= least) & F.col("train_t").isNotNull()
    place = F.row_number().over(Window.orderBy(fit.desc(), F.floor(F.col("train_t") * 1e6 + 0.5).desc_nulls_last(), "size", "k", "rule"))  # some tens of rules
    ranked = train.withColumn("place", place.cast("long")).withColumn("chosen", (F.col("place") == 1) & fit)
    after = halves.where("test").select("rule", F.col("n").alias("test_n"), F.col("mean").alias("test_mean"), F.col("t").alias("test_t"))
    judged = ranked.join(after, "rule", "left")
    return judged.select("rule", "size", "k", "train_n", "train_mean", "train_t", "place", "chosen", *[F.when(F.col("chosen"), F.col(c)).alias(c) for c in ("test_n", "test_mean", "test_t")])
