"""Gates and checks: the first or all failures of ordered tests, declared corrections, seams of histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.ranks import ratio


def failures(gates: list[tuple[str, str]]) -> Column:
    """Names of all failed gates, in order; a test that is null has failed."""
    tests = F.array(*[F.struct(F.lit(code).alias("code"), F.coalesce(F.expr(test), F.lit(False)).alias("ok")) for code, test in gates])
    return F.transform(F.filter(tests, lambda x: ~x["ok"]), lambda x: x["code"])


def first_failure(gates: list[tuple[str, str]]) -> Column:
    """The name of the first failed gate; null if all hold."""
    out = None
    for code, test in gates:
        failed = ~F.coalesce(F.expr(test), F.lit(False))
        out = F.when(failed, code) if out is None else out.when(failed, code)
    return out


def corrected(bars: DataFrame, declared: DataFrame) -> DataFrame:
    """Prices times, and volumes over, the factors whose day lies after the bar. declared: (ticker, ex, factor)."""
    steps = declared.groupBy(F.col("ticker").alias("__t")).agg(F.collect_list(F.struct("ex", "factor")).alias("__f"))  # a name's few splits
    out = bars.join(steps, F.col("ticker") == F.col("__t"), "left")
    factor = F.aggregate(F.filter(F.coalesce("__f", F.array()), lambda x: F.col("session") < x["ex"]), F.lit(1.0), lambda s, x: s * x["factor"])
    out = out.withColumn("__k", factor)
    return out.withColumns({c: F.col(c) * F.col("__k") for c in ("open", "high", "low", "close")} | {"volume": ratio(F.col("volume"), F.col("__k"))}).drop("__t", "__f", "__k")


def join_check(old: DataFrame, new: DataFrame, within: float = 1e-4) -> DataFrame:
    """Whether two histories of a name agree where they overlap."""
    both = old.select("ticker", "session", F.col("close").alias("__o")).join(new.select("ticker", "session", F.col("close").alias("__n")), ["ticker", "session"])
    gap = F.max(F.abs(ratio(F.col("__n"), F.col("__o")) - 1))
    return both.groupBy("ticker").agg(F.count("*").alias("overlap"), F.when(gap <= within, "ok").otherwise("disagrees").alias("verdict"))
