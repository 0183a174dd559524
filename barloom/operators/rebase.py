"""Stored series brought in line with declared spin-offs and cuts: measured before and after, and safe to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.ranks import ratio
from barloom.operators import upsert as up
from barloom.operators.screening import corrected
from barloom.operators.windows import order, rows

#: A move of more standard deviations is a step; without enough bars for one, a move of more than this share.
STEP_Z, SHORT_STEP = 5.0, 0.15


def measured(bars: DataFrame, declared: DataFrame, step_z: float = STEP_Z, short_step: float = SHORT_STEP) -> DataFrame:
    """(ticker, ex, factor, ret_before, z_before, ret_after, z_after, action) of each declared factor.

    skip: the day is not stored, or is the first bar. held: there is no step, so the series is adjusted already. refuse:
    the factor would leave a step, so it is wrong. adjust: the factor removes it. A factor scales all bars before its day,
    so it moves the one return across it: the move after it is the move before it less its logarithm, and all declared
    days of all names are judged in one pass."""
    marks = declared.select(F.col("ticker").alias("__t"), F.col("ex").alias("__s"), F.lit(True).alias("__declared")).distinct()
    on = (F.col("ticker") == F.col("__t")) & (F.col("session") == F.col("__s"))
    days = bars.select("ticker", "session", "close").join(F.broadcast(marks), on, "left")  # declared by hand
    days = days.withColumn("log_ret", F.ln(ratio(F.col("close"), F.lag("close").over(order()))))
    # Moves across declared days are left out of the spread: one that is not adjusted yet would hide the next.
    usual, frame = F.when(F.col("__declared").isNull(), F.col("log_ret")), rows(-60, -1)
    sd = F.when((F.count(usual).over(frame) >= 20) & (F.stddev_samp(usual).over(frame) > 0), F.stddev_samp(usual).over(frame))
    days = days.withColumn("sd", sd).where("__declared").select("__t", "__s", "log_ret", "sd").withColumn("step_z", ratio(F.col("log_ret"), F.col("sd")))
    f = declared.join(F.broadcast(days), (F.col("ticker") == F.col("__t")) & (F.col("ex") == F.col("__s")), "left")
    spread = F.col("sd")
    after = F.col("log_ret") - F.ln("factor")
    z_after = ratio(after, spread)
    is_step = lambda r, z: F.when(z.isNotNull(), F.abs(z) > step_z).otherwise(F.abs(F.expm1(r)) > short_step)
    action = F.when(F.col("log_ret").isNull(), "skip").when(~is_step(F.col("log_ret"), F.col("step_z")), "held").when(is_step(after, z_after), "refuse").otherwise("adjust")
    moved = F.col("log_ret").isNotNull()
    return f.select("ticker", "ex", "factor", F.expm1("log_ret").alias("ret_before"), F.col("step_z").alias("z_before"), F.when(moved, F.expm1(after)).alias("ret_after"), F.when(moved, z_after).alias("z_after"), action.alias("action"))


def rebased(bars: DataFrame, declared: DataFrame, **limits) -> DataFrame:
    """All bars, those before an accepted day times the product of the accepted factors after them."""
    taken = measured(bars, declared, **limits).where("action = 'adjust'").select("ticker", "ex", "factor")
    return corrected(bars, taken)


def rebase_store(spark: SparkSession, path: str, declared: DataFrame, by: list[str] | None = None, **limits) -> DataFrame:
    """Rewrites the partitions of a bar store that hold bars before an accepted day, and no others; returns what was
    decided. A second run finds no step where the first removed one, so that it changes nothing."""
    bars = spark.read.parquet(path)
    found = measured(bars, declared, **limits)
    decided = found.collect()  # one row a declared correction
    taken = [(r["ticker"], r["ex"], r["factor"]) for r in decided if r["action"] == "adjust"]
    if taken:
        accepted = spark.createDataFrame(taken, "ticker long, ex date, factor double")
        last = accepted.groupBy("ticker").agg(F.max("ex").alias("__last"))
        touched = bars.join(F.broadcast(last), "ticker").where("session < __last").drop("__last")
        up.upsert(spark, path, corrected(touched, accepted).select(bars.columns), ["ticker", "session"], by or ["month"])
    return spark.createDataFrame(decided, found.schema)


def cut(bars: DataFrame, cuts: DataFrame) -> DataFrame:
    """Bars with those before a cut's day moved to its archive name. cuts: (ticker, keep_from, archive). What an earlier run
    has moved stays moved: nothing is left before the day."""
    c = cuts.select(F.col("ticker").alias("__t"), "keep_from", "archive")
    both = bars.join(F.broadcast(c), F.col("ticker") == F.col("__t"), "left")  # declared by hand
    old = F.coalesce(F.col("session") < F.col("keep_from"), F.lit(False))
    return both.withColumn("ticker", F.when(old, F.col("archive")).otherwise(F.col("ticker"))).drop("__t", "keep_from", "archive")
