"""All registered queries of the research operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "E7_ic_by_horizon"


def query(name: str, sql: str | None = None):
    """Registers a query; sql is what DuckDB runs on the same tables."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = nudged(sql)
        return f

    return add


#: Added before rounding on both sides, so that halves and negative zeros come out alike in either engine.
NUDGE = 1e-9


def r(value: str | Column, name: str, digits: int = 6) -> Column:
    """A double rounded for comparison, under a name."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(NUDGE), digits).alias(name)


def nudged(sql: str) -> str:
    """The same in SQL: round(x, n) becomes round((x) + NUDGE, n)."""
    out, at = "", 0
    while (begin := sql.find("round(", at)) >= 0:
        depth, comma, i = 1, 0, begin + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        out += sql[at:begin] + f"(round(({nudged(sql[begin + 6 : comma])}) + {NUDGE}, {sql[comma + 1 : i]} + 0.0)"
        at = i
    return out + sql[at:]


def load() -> None:
    """Imports every module that registers queries."""
    from barloom.plans import bar_plans, company_plans, cross_plans, desk_plans, event_plans, ledger_plans, module_plans, more_plans, screen_plans, store_plans, study_plans, text_plans  # noqa: F401


load()
