"""How much history a support zone needs: the same name and day read with shortened histories, against the full one and
against placebo levels kept off every real one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ranks import t_stat
from barloom.operators.draws import PRIME, mixed
from barloom.operators.levels import Readings, _history, level_rows, visit_spans

SCORED = "session date, arm string, ticker long, level double, reached boolean, failed boolean, hit boolean"
#: A touch is a low up to this share over the level; a level fails a tenth below it and holds by 15 % above.
TOUCH, FAIL, HIT = 1.025, 0.90, 1.15
#: How far below the price a zone may lie, and how near to a real level (in logs) no placebo may.
NEAREST, FARTHEST, APART = 0.005, 0.16, 0.02


def zone_levels(g: pd.DataFrame, least: int = 2) -> np.ndarray:
    """Levels below the last price, not farther than FARTHEST, that were visited `least` times or more."""
    low, close = g["low"].to_numpy(float), g["close"].to_numpy(float)
    found = [x for x, _ in level_rows(g) if 0 <= close[-1] / x - 1 <= FARTHEST and len(visit_spans(low, close, x)) >= least]
    return np.array(found, float)


def outcome(low: np.ndarray, close: np.ndarray, at: int, level: float, reach: int, hold: int) -> tuple[bool, bool | None, bool | None]:
    """(reached, failed, hit) of a level after bar `at`: the first touch within reach bars, then hold bars from it; both
    unknown where it is not touched or the hold is not over."""
    touched = np.flatnonzero(low[at + 1 : at + 1 + reach] <= level * TOUCH)
    if not len(touched):
        return False, None, None
    after = close[at + 1 + touched[0] :][:hold]
    if len(after) < hold:
        return True, None, None
    return True, bool(after.min() <= level * FAIL), bool(after.max() >= level * HIT)


def placebos(ticker: int, bar: int, price: float, real: np.ndarray, tries: int = 4) -> list[float]:
    """Levels at seeded distances below the price, those within APART of a real level left out."""
    share = [mixed(ticker, bar, k) / PRIME for k in range(1, tries + 1)]
    made = [price * (1 - NEAREST - x * (FARTHEST - NEAREST)) for x in share]
    return [x for x in made if not len(real) or np.abs(np.log(real / x)).min() >= APART]


def scored(bars: DataFrame, lengths: tuple[int, ...] = (60, 120, 250), step: int = 20, mature: int = 300, reach: int = 40, hold: int = 20) -> DataFrame:
    """SCORED rows of every step-th bar of each name with `mature` bars before it: the levels of its full history (arm
    full), of its last n bars (arm n), and placebo levels. One grouped map a name reads its history once, and what readings
    have in common is worked out once (levels.Readings); each sees bars up to its own date alone, and only the outcome
    looks ahead."""
    kinds = {"session": "object", "arm": "object", "ticker": "int64", "level": "float64", "reached": "object", "failed": "object", "hit": "object"}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("session").reset_index(drop=True)
        high, low, close, ticker = g["high"].to_numpy(float), g["low"].to_numpy(float), g["close"].to_numpy(float), int(g["ticker"].iloc[0])
        ends = [at + 1 for at in range(mature - 1, len(g) - 1, step)]
        readings, session, rows = Readings(high, low, close), g["session"].to_numpy(), []
        for n in lengths if ends else ():
            readings.prepare(n, ends)

        def visited(begin: int, end: int, least: int = 2) -> np.ndarray:
            return np.array([x for x in readings.under(begin, end, FARTHEST) if len(visit_spans(low[begin:end], close[begin:end], x)) >= least], float)

        for end in ends:
            full, at = visited(0, end), end - 1
            arms = {"full": full} | {str(n): visited(max(0, end - n), end) for n in lengths} | {"placebo": placebos(ticker, at, close[at], full)}
            rows += [(session[at], arm, ticker, float(x), *outcome(low, close, at, x, reach, hold)) for arm, levels in arms.items() for x in levels]
        return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)

    return _history(bars).groupBy("ticker").applyInPandas(run, SCORED)


def by_arm(rows: DataFrame, base: str = "full") -> DataFrame:
    """(arm, levels, reached, failed, hit, dates, diff, t): shares over all levels, and the mean over dates of the arm's hit
    share less that of the base on the same date, with its t."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    whole = rows.groupBy("arm").agg(F.count("*").alias("levels"), share("reached").alias("reached"), share("failed").alias("failed"), share("hit").alias("hit"))
    dates = rows.where("hit is not null").groupBy("arm", "session").agg(share("hit").alias("rate"))
    both = dates.join(dates.where(F.col("arm") == base).select("session", F.col("rate").alias("base")), "session").withColumn("gap", F.col("rate") - F.col("base"))
    gaps = both.groupBy("arm").agg(F.count("*").alias("dates"), F.avg("gap").alias("diff"), t_stat("gap").alias("t"))
    return whole.join(gaps, "arm", "left")
