"""Ranks and statistics as column expressions. Missing is not zero: nulls take no rank and add to no count."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def rank_avg(value: str | Column, *by: str) -> Column:
    """Rank from 1 with ties averaged, over non-null values; null for null.

    All its windows are partitioned by the group alone, so that one exchange serves them: with a ranks from below, d from
    above and n values, the mean rank of ties is (a - d + n + 1) / 2."""
    v = F.col(value) if isinstance(value, str) else value
    group = Window.partitionBy(*by)
    below, above = F.rank().over(group.orderBy(v.asc_nulls_last())), F.rank().over(group.orderBy(v.desc_nulls_last()))
    return F.when(v.isNotNull(), (below - above + F.count(v).over(group) + 1) / 2)


def rank_pct(value: str | Column, *by: str) -> Column:
    """rank_avg as a share of the non-null values."""
    v = F.col(value) if isinstance(value, str) else value
    return rank_avg(v, *by) / F.count(v).over(Window.partitionBy(*by))


def quantile(value: str | Column, q: float, *by: str) -> Column:
    """Linear-interpolated quantile in each group, on every row of it."""
    return F.percentile(F.col(value) if isinstance(value, str) else value, F.lit(q)).over(Window.partitionBy(*by))


def t_stat(value: str | Column) -> Column:
    """Mean over its standard error; null below three values or without spread."""
    v = F.col(value) if isinstance(value, str) else value
    n, sd = F.count(v), F.stddev_samp(v)
    return F.when((n >= 3) & (sd > 0), F.avg(v) / (sd / F.sqrt(n)))


def welch_t(value: Column, side: Column) -> Column:
    """Welch's t of value where side is true against where it is false."""
    a, b = F.when(side, value), F.when(~side, value)
    error = F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))
    return F.when((F.count(a) >= 2) & (F.count(b) >= 2) & (error > 0), (F.avg(a) - F.avg(b)) / error)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0, which under ANSI rules would end the job."""
    return F.try_divide(a, b)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows that have both; null where a side has no spread, which ends F.corr under ANSI rules."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def safe_divide(a: Column, b: Column, cap: float = 1e6) -> Column:
    """a / b; null where b is 0 or the ratio is not finite, held within +-cap."""
    x = F.try_divide(a, b)
    return F.when(~F.isnan(x), clip(x, -cap, cap))


def clip(x: Column, low: float, high: float) -> Column:
    """x held between two bounds; null stays null, which greatest and least alone would turn into a bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sum_reported(*cols: Column) -> Column:
    """Sum of what is there; null only if nothing is."""
    return F.when(F.coalesce(*cols).isNotNull(), sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0))))


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(F.try_divide(a, b)))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def tier(value: Column, cuts: list[tuple[float, str]], last: str, inclusive: bool = False) -> Column:
    """The first name whose bound lies above the value (or at it, if inclusive)."""
    out = None
    for bound, name in cuts:
        test = value <= bound if inclusive else value < bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(value.isNotNull(), out.otherwise(last))
