"""Score modules: named sets of metrics over bars that compile into one plan, strategies over them, and their evidence.

A metric is a column builder over a name's own past (windows by ticker). All metrics of all modules are columns of one
select: one scan of the bars and one exchange by ticker serve them, and the leaderboard groups by metric where a loop
would read the store once for each."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from barloom.functions.ranks import rank_pct, ratio, tier
from barloom.operators import crosssection as cs
from barloom.operators.staged import stored
from barloom.sources.roles import ROWS_A_PART, dealt


@dataclass(frozen=True)
class Metric:
    """A score by name: its column, whether larger is better (1) or smaller (-1), whether it is a signal or provenance."""

    name: str
    column: Callable[[], Column]
    direction: int = 1
    signal: bool = True


@dataclass(frozen=True)
class Module:
    """What a score module declares: its name and its metrics. prepare adds columns that several metrics share."""

    name: str
    metrics: tuple[Metric, ...]
    prepare: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)

    def __post_init__(self):
        names = [m.name for m in self.metrics]
        if not self.name or not names or len(set(names)) < len(names):
            raise ValueError(f"module {self.name!r} needs a name and metrics of different names")


@dataclass(frozen=True)
class Strategy:
    """A ranking model: (metric, direction, weight) inputs; weights are relative. evidence says what was measured of it."""

    key: str
    inputs: tuple[tuple[str, int, float], ...]
    evidence: str = ""

    def __post_init__(self):
        if not self.inputs or any(d not in (1, -1) or w <= 0 for _, d, w in self.inputs):
            raise ValueError(f"strategy {self.key!r}: directions are 1 or -1, weights above 0")


_MODULES: dict[str, Module] = {}


def register(module: Module) -> Module:
    """Adds a module; the same one again is harmless, another one under its name or with a known metric is an error."""
    held = _MODULES.get(module.name)
    if held is not None and held != module:
        raise ValueError(f"module {module.name!r} is registered already")
    taken = {m.name for x in _MODULES.values() if x.name != module.name for m in x.metrics}
    if clash := taken & {m.name for m in module.metrics}:
        raise ValueError(f"metrics of other modules: {sorted(clash)}")
    _MODULES[module.name] = module
    return module


def get(name: str) -> Module:
    if name not in _MODULES:
        raise KeyError(f"no module {name!r}; there are {registered()}")
    return _MODULES[name]


def registered() -> list[str]:
    return sorted(_MODULES)


def wide(bars: DataFrame, modules: list[Module], keep: list[str] | None = None) -> DataFrame:
    """(ticker, session, kept columns, one column a metric) of every bar."""
    for m in modules:
        bars = m.prepare(bars) if m.prepare else bars
    return bars.select("ticker", "session", *(keep or []), *[x.column().alias(x.name) for m in modules for x in m.metrics])


def tidy(scores: DataFrame, modules: list[Module], keep: list[str] | None = None) -> DataFrame:
    """Rows (ticker, session, kept, module, metric, value) of the scores there are; a column that no module declares is an
    error, as a misnamed score would look like one that is missing."""
    declared = {x.name: m.name for m in modules for x in m.metrics}
    found = [c for c in scores.columns if c not in ("ticker", "session", *(keep or []))]
    if unknown := [c for c in found if c not in declared]:
        raise ValueError(f"not declared by any module: {unknown}")
    of = F.create_map(*[F.lit(x) for c in found for x in (c, declared[c])])
    long = scores.select("ticker", "session", *(keep or []), *[F.col(c).cast("double").alias(c) for c in found]).unpivot(["ticker", "session", *(keep or [])], found, "metric", "value")
    return long.where("value is not null").withColumn("module", F.element_at(of, F.col("metric")))


def compute(bars: DataFrame, module: Module, asof, tickers: DataFrame | None = None) -> DataFrame:
    """(ticker, metric, value) on the last bar of each name up to asof: later bars are not read."""
    past = bars.where(F.col("session") <= F.lit(asof))
    past = past.join(tickers.select("ticker"), "ticker", "left_semi") if tickers is not None else past
    last = wide(past, [module]).withColumn("__n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session")))).where("__n = 1").drop("__n")
    return tidy(last, [module]).select("ticker", "metric", "value")


def drawn(seed: int, *keys: str) -> Column:
    """A seeded random order as text, the same in every engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def evidence(long: DataFrame, outcomes: dict[str, int], spacing: int, least_dates: int = 10) -> DataFrame:
    """Every metric at every horizon: IC, t, hit rate, IC of a random order, spread of the outer fifths, dates, names a date.

    long: (ticker, session, metric, value, one column an outcome), a table that is cheap to read again; outcomes: column to
    its horizon in sessions. Dates are spacing sessions apart. A metric's names on one date are a group, which is ranked once
    for all horizons: rows are dealt once, and nothing is read or grouped once a metric."""
    keys = ["metric", "session"]
    rows = long.where("value is not null").select("ticker", *keys, F.col("value").cast("double"), *[F.col(c).cast("double") for c in outcomes])
    rows = rows.withColumn("random", F.conv(F.substring(drawn(1, "ticker", "session", "metric"), 1, 8), 16, 10).cast("double"))
    schema = StructType([*[rows.schema[k] for k in keys], StructField("horizon", IntegerType()), StructField("n", LongType()), *[StructField(k, DoubleType()) for k in ("ic", "noise", "spread")]])

    def agreement(a: pd.Series, b: pd.Series) -> float | None:
        x, y = (v.to_numpy() - v.mean() for v in (a.rank(), b.rank()))
        spread = np.sqrt((x @ x) * (y @ y))
        return x @ y / spread if len(x) >= 5 and spread > 0 else None

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g, out = g.sort_values(["value", "ticker"]), []
        for c, h in outcomes.items():
            both = g[g[c].notna()]
            if n := len(both):
                fwd, bins = both[c].to_numpy(), np.arange(n) * 5 // n
                out.append((*key, h, n, agreement(both["value"], both[c]), agreement(both["random"], both[c]), fwd[bins == 4].mean() - fwd[bins == 0].mean() if n >= 15 else None))
        found = pd.DataFrame(out, columns=schema.names)
        return found.astype({k: "Float64" for k in ("ic", "noise", "spread")})

    dates = stored(dealt(rows, -(-long.count() // ROWS_A_PART), *keys).groupBy(*keys).applyInPandas(run, schema))
    found = cs.ic_summary(dates, F.col("horizon"), spacing, ["metric", "horizon"])
    means = dates.where("ic is not null").groupBy("metric", "horizon").agg(F.avg("noise").alias("ic_random"), F.avg("spread").alias("spread"), F.avg("n").alias("names"))
    return found.join(means, ["metric", "horizon"]).where(F.col("n_dates") >= least_dates)


def top_turnover(long: DataFrame, top: int = 10) -> DataFrame:
    """(metric, turnover): mean share of a date's top names that were not among the last date's."""
    dates = long.select("session").distinct().withColumn("__i", F.row_number().over(Window.orderBy("session")))  # dates grow with time alone
    w = Window.partitionBy("metric", "session").orderBy(F.desc("value"), "ticker")
    best = long.select("ticker", "session", "metric", "value").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).join(F.broadcast(dates), "session").select("ticker", "metric", "__i")
    best = stored(best)  # some names a metric and date
    before = best.select("ticker", "metric", (F.col("__i") + 1).alias("__i"), F.lit(1).alias("__was"))
    share = best.join(before, ["ticker", "metric", "__i"], "left").groupBy("metric", "__i").agg(F.avg(F.coalesce("__was", F.lit(0))).alias("__kept"))
    return share.where("__i > 1").groupBy("metric").agg((1 - F.avg("__kept")).alias("turnover"))


def leaderboard(long: DataFrame, outcomes: dict[str, int], spacing: int, least_dates: int = 10) -> DataFrame:
    """evidence and turnover, with each metric's place by the size of its IC at its horizon."""
    long = stored(long)
    board = evidence(long, outcomes, spacing, least_dates).join(top_turnover(long), "metric", "left")
    # Metrics and horizons are some tens of rows.
    return board.withColumn("place", F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc(F.abs("ic")), "metric")).cast("long"))


def strategy_scores(scores: DataFrame, strategies: list[Strategy], by: str = "session") -> DataFrame:
    """(ticker, by, strategy, score): weighted mean of rank shares of the inputs that a name has, times 100; half of the
    weight at least must be there."""
    names = sorted({m for s in strategies for m, _, _ in s.inputs})
    if unknown := [m for m in names if m not in scores.columns]:
        raise ValueError(f"strategies ask for metrics that are not there: {unknown}")
    ranked = scores.select("ticker", by, *[rank_pct(m, by).alias(m) for m in names])
    out = []
    for s in strategies:
        share = {m: F.when(F.lit(d > 0), F.col(m)).otherwise(1 - F.col(m)) for m, d, _ in s.inputs}
        num = sum((F.coalesce(share[m] * w, F.lit(0.0)) for m, _, w in s.inputs), F.lit(0.0))
        den = sum((F.when(F.col(m).isNotNull(), F.lit(w)).otherwise(0.0) for m, _, w in s.inputs), F.lit(0.0))
        out.append(F.struct(F.lit(s.key).alias("strategy"), F.when(den >= sum(w for _, _, w in s.inputs) / 2, 100 * ratio(num, den)).alias("score")))
    return ranked.select("ticker", by, F.explode(F.array(*out)).alias("x")).select("ticker", by, "x.*").where("score is not null")


BANDS = [(20.0, "WEAK"), (40.0, "SOFT"), (60.0, "MIXED"), (80.0, "GOOD")]


def combo(long: DataFrame, proof: DataFrame, by: str = "session", least_coverage: float = 0.5) -> DataFrame:
    """(ticker, by, metric, value, label): the combined score, its coverage, and one `_ALL` row a date with the number of
    metrics used and their names.

    proof: (metric, theme, t) of the admitted metrics, some tens of rows. Ranks are turned by the sign of t and averaged by
    theme; themes count by the mean size of their t, and a theme that a name lacks does not vote."""
    used = stored(proof.select("metric", "theme", F.signum("t").alias("sign"), F.abs("t").alias("size")))
    weights = used.groupBy("theme").agg(F.avg("size").alias("weight"))
    total = used.agg(F.count("*").alias("used"), F.array_join(F.sort_array(F.collect_list("metric")), ",").alias("names"))
    ranked = long.select("ticker", by, "metric", "value").join(F.broadcast(used), "metric").withColumn("rank", 100 * rank_pct("value", by, "metric"))
    ranked = ranked.withColumn("rank", F.when(F.col("sign") >= 0, F.col("rank")).otherwise(100 - F.col("rank")))
    themes = ranked.groupBy("ticker", by, "theme").agg(F.avg("rank").alias("mean"), F.count("*").alias("k")).join(F.broadcast(weights), "theme")
    names = themes.groupBy("ticker", by).agg(ratio(F.sum(F.col("mean") * F.col("weight")), F.sum("weight")).alias("score"), F.sum("k").alias("k")).join(F.broadcast(total), how="cross")  # one row
    names = stored(names.withColumn("coverage", F.col("k") / F.col("used")))
    label = tier(F.col("score"), BANDS, "STRONG")
    key = F.col("ticker").cast("string").alias("ticker")
    score = names.where(F.col("coverage") >= least_coverage).select(key, by, F.lit("combo").alias("metric"), F.col("score").alias("value"), label.alias("label"))
    cover = names.select(key, by, F.lit("combo_cov").alias("metric"), F.col("coverage").alias("value"), F.lit(None).cast("string").alias("label"))
    whole = names.groupBy(by).agg(F.max("used").cast("double").alias("value"), F.max("names").alias("label")).select(F.lit("_ALL").alias("ticker"), by, F.lit("combo_n").alias("metric"), "value", "label")
    return score.unionByName(cover).unionByName(whole)


@dataclass(frozen=True)
class Recipe:
    """A ranking that a user declares: a condition, sort keys (column, asc or desc), and how many names a date."""

    name: str
    sort: tuple[tuple[str, str], ...]
    top: int
    where: str = "true"

    def __post_init__(self):
        if not self.sort or self.top < 1 or any(way not in ("asc", "desc") for _, way in self.sort):
            raise ValueError(f"recipe {self.name!r} needs sort keys that are asc or desc, and a top of 1 or more")


def recipes(text: str) -> list[Recipe]:
    """Recipes of a JSON list; unknown fields and repeated names are errors."""
    out = [Recipe(**(x | {"sort": tuple(map(tuple, x.get("sort", ())))})) for x in json.loads(text)]
    if len({x.name for x in out}) < len(out):
        raise ValueError("two recipes of one name")
    return out


def by_recipes(scores: DataFrame, wanted: list[Recipe], by: str = "session") -> DataFrame:
    """(recipe, by, ticker, place): the first names of each recipe on each date; ties go to the smaller ticker."""
    out = None
    for x in wanted:
        keys = [(F.col(c).asc_nulls_last() if way == "asc" else F.col(c).desc_nulls_last()) for c, way in x.sort]
        place = F.row_number().over(Window.partitionBy(by).orderBy(*keys, "ticker"))
        rows = scores.where(F.expr(x.where)).select(by, "ticker", *dict.fromkeys(c for c, _ in x.sort)).withColumn("place", place).where(F.col("place") <= x.top).select(F.lit(x.name).alias("recipe"), by, "ticker", "place")
        out = rows if out is None else out.unionByName(rows)
    return out
