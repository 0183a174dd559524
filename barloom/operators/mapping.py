"""Labels and comparisons: ranges, funnels, bounds, two sources side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_ranges(value: Column, ranges: list[tuple[float, float, str]], other: str) -> Column:
    """The name of the first range that holds the value."""
    out = None
    for low, high, name in ranges:
        test = value.between(low, high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)


def funnel(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """One row: how many rows pass each test and all before it."""
    held, counts = F.lit(True), []
    for name, test in steps:
        held = held & F.coalesce(F.expr(test), F.lit(False))
        counts.append(F.count_if(held).alias(name))
    return df.agg(*counts)


def bounded(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their field's bounds become null."""
    return df.withColumns({c: F.when(F.col(c).between(low, high), F.col(c)) for c, (low, high) in bounds.items()})


def compare(a: Column, b: Column, tolerance: float) -> Column:
    """ok, differs or missing for one field of two sources. Against a 0 only a 0 is ok."""
    return F.when(a.isNull() | b.isNull(), "missing").when(F.abs(a - b) <= tolerance * F.abs(b), "ok").otherwise("differs")


def overlay(mine: DataFrame, provider: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The provider's value where it has one."""
    p = provider.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return mine.join(p, key, "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])


def cik_aliases(map_: DataFrame, succession: DataFrame) -> DataFrame:
    """Tickers with their companies, share classes under both spellings, and companies that came before."""
    dotted = map_.where(F.col("ticker").contains("-")).withColumn("ticker", F.translate("ticker", "-", "."))
    both = map_.unionByName(dotted.join(map_.select("ticker"), "ticker", "left_anti"))
    older = both.join(succession.select(F.col("cik"), F.col("old_cik")), "cik").select("ticker", F.col("old_cik").alias("cik"))
    return both.unionByName(older).distinct()
