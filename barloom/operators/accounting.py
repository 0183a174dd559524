"""Bitemporal company facts: what was known at a date, trailing twelve months, repaired quarters, derived scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import clip, ratio, safe_divide, sum_reported
from barloom.operators.asof import latest_by


def facts_asof(facts: DataFrame, asof: str, keys: tuple[str, ...] = ("cik", "concept")) -> DataFrame:
    """Facts filed by a date for periods that had ended: the newest period of each key, its latest filing."""
    known = facts.where((F.col("filed") <= F.lit(asof).cast("date")) & (F.col("ddate") <= F.lit(asof).cast("date")))
    return latest_by(known, list(keys), [F.desc("ddate"), F.desc("filed"), F.desc("adsh")])


def wide(facts: DataFrame, concepts: list[str], key: str = "cik") -> DataFrame:
    """One row a company, a column a concept; the list is given, so no job looks for it."""
    return facts.groupBy(key).pivot("concept", concepts).agg(F.max("value"))


def quarters_of(days: Column) -> Column:
    """Whole quarters in a span of days, for years of 52 and 53 weeks too."""
    return F.floor(days / 91.3125 + 0.5)


def near_periods(facts: DataFrame, gap: int = 16) -> DataFrame:
    """Periods that end within `gap` days of the one before are one: a chain takes its first date."""
    w = Window.partitionBy("cik", "concept").orderBy("ddate")
    fresh = F.coalesce(F.datediff("ddate", F.lag("ddate").over(w)) > gap, F.lit(True))
    chained = facts.withColumn("__new", fresh.cast("int")).withColumn("__chain", F.sum("__new").over(w))
    return chained.withColumn("period", F.min("ddate").over(Window.partitionBy("cik", "concept", "__chain"))).drop("__new", "__chain")


#: Which way a trailing year was found, in order of trust where two end on one day.
ANNUAL, ROLLED, SUMMED = 0, 1, 2


def trailing_year(facts: DataFrame) -> DataFrame:
    """Trailing twelve months of flow facts (cik, concept, ddate, qtrs, value, filed), one row a company and concept.

    Three candidates: an annual fact; the last annual plus the year to date less the same stub a year before; and four
    quarters end to end. The newest end wins, then annual, rolled, summed."""
    f = latest_by(facts.where("value is not null"), ["cik", "concept", "ddate", "qtrs"], [F.desc("filed"), F.desc("value")]).select("cik", "concept", "ddate", "qtrs", "value")
    annual = f.where("qtrs = 4").select("cik", "concept", F.col("ddate").alias("end"), "value", F.lit(ANNUAL).alias("how"))
    now, prior = f.where("qtrs between 1 and 3").alias("n"), f.alias("p")
    # Both joins are on company and concept, where a company has some tens of periods.
    stubs = now.join(prior, (F.col("n.cik") == F.col("p.cik")) & (F.col("n.concept") == F.col("p.concept")) & (F.col("n.qtrs") == F.col("p.qtrs")) & (quarters_of(F.datediff("n.ddate", "p.ddate")) == 4))
    stubs = stubs.select("n.cik", "n.concept", F.col("n.ddate").alias("end"), "n.qtrs", F.col("n.value").alias("now"), F.col("p.value").alias("before"))
    year = annual.select("cik", "concept", F.col("end").alias("fy"), F.col("value").alias("whole"))
    rolled = stubs.join(year, ["cik", "concept"]).where((F.col("fy") < F.col("end")) & (quarters_of(F.datediff("end", "fy")) == F.col("qtrs")))
    rolled = rolled.select("cik", "concept", "end", (F.col("whole") + F.col("now") - F.col("before")).alias("value"), F.lit(ROLLED).alias("how"))
    w = Window.partitionBy("cik", "concept").orderBy("ddate")
    last4 = w.rowsBetween(-3, 0)
    quarter = f.where("qtrs = 1").withColumn("__n", F.count("*").over(last4)).withColumn("__sum", F.sum("value").over(last4)).withColumn("__span", F.datediff("ddate", F.lag("ddate", 3).over(w)))
    summed = quarter.where((F.col("__n") == 4) & (quarters_of(F.col("__span")) == 3)).select("cik", "concept", F.col("ddate").alias("end"), F.col("__sum").alias("value"), F.lit(SUMMED).alias("how"))
    every = annual.unionByName(rolled).unionByName(summed)
    return latest_by(every, ["cik", "concept"], [F.desc("end"), F.asc("how"), F.desc("value")])


def fill_fourth_quarter(facts: DataFrame) -> DataFrame:
    """The quarter that a company reports only as a year: the annual fact less exactly three quarters inside it, where no
    quarter ends on the year's day."""
    one = lambda q: latest_by(facts.where(F.col("qtrs") == q), ["cik", "concept", "ddate"], [F.desc("filed"), F.desc("value")])
    year = one(4).select("cik", "concept", F.col("ddate").alias("fy"), F.col("value").alias("whole"))
    quarter = one(1).select("cik", "concept", "ddate", "value")
    inside = year.join(quarter, ["cik", "concept"]).where((F.col("ddate") <= F.col("fy")) & (F.col("ddate") > F.add_months("fy", -12)))
    three = inside.groupBy("cik", "concept", "fy", "whole").agg(F.count("*").alias("n"), F.sum("value").alias("held"), F.max("ddate").alias("last"))
    return three.where((F.col("n") == 3) & (F.col("last") < F.col("fy"))).select("cik", "concept", F.col("fy").alias("ddate"), (F.col("whole") - F.col("held")).alias("value"))


def piotroski(now: str = "", before: str = "p_") -> Column:
    """Nine points of strength; a comparison with a null gives none, and without assets there is no score."""
    c, p = (lambda k: F.col(now + k)), (lambda k: F.col(before + k))
    roa, roa_p = safe_divide(c("net_income"), c("assets")), safe_divide(p("net_income"), p("assets"))
    tests = [
        c("net_income") > 0,
        c("cfo") > 0,
        roa > roa_p,
        c("cfo") > c("net_income"),
        safe_divide(c("debt"), c("assets")) < safe_divide(p("debt"), p("assets")),
        safe_divide(c("assets_current"), c("liabilities_current")) > safe_divide(p("assets_current"), p("liabilities_current")),
        c("shares") <= p("shares") * 1.01,
        safe_divide(c("gross_profit"), c("revenue")) > safe_divide(p("gross_profit"), p("revenue")),
        safe_divide(c("revenue"), c("assets")) > safe_divide(p("revenue"), p("assets")),
    ]
    points = sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests[1:]), F.coalesce(tests[0].cast("int"), F.lit(0)))
    return F.when(c("assets").isNotNull() & p("assets").isNotNull(), points)


def altman_z(prefix: str = "") -> Column:
    c = lambda k: F.col(prefix + k)
    z = 1.2 * safe_divide(c("assets_current") - c("liabilities_current"), c("assets")) + 1.4 * safe_divide(c("retained"), c("assets")) + 3.3 * safe_divide(c("ebit"), c("assets")) + 0.6 * safe_divide(c("market_cap"), c("liabilities")) + 1.0 * safe_divide(c("revenue"), c("assets"))
    return clip(z, -20.0, 40.0)


def surprise(df: DataFrame, value: str = "value", least: int = 4, n: int = 8, cap: float = 10.0) -> DataFrame:
    """Change on the same quarter a year before, over the spread of the changes before it."""
    w = Window.partitionBy("cik", "concept").orderBy("ddate")
    out = df.withColumn("change", F.col(value) - F.lag(value, 4).over(w))
    frame = w.rowsBetween(-n, -1)
    sd = F.stddev_samp("change").over(frame)
    return out.withColumn("sue", F.when((F.count("change").over(frame) >= least) & (sd > 0), clip(F.col("change") / sd, -cap, cap)))


def main_currency(facts: DataFrame, key: str = "cik", unit: str = "uom") -> DataFrame:
    """Each company's most frequent currency; at a tie, the first by name. Units are XXX or XXX/shares."""
    coded = facts.withColumn("currency", F.regexp_extract(unit, "^([A-Z]{3})(/shares)?$", 1)).where("currency <> ''")
    counted = coded.groupBy(key, "currency").agg(F.count("*").alias("n"))
    return latest_by(counted, [key], [F.desc("n"), F.asc("currency")]).select(key, "currency")


def prefer_stores(bulk: DataFrame, company: DataFrame, filings: DataFrame) -> DataFrame:
    """One fact table of three stores: a company's own feed replaces the bulk store in a quarter where it is newer; single
    filings add only what neither holds."""
    quarter = F.date_trunc("quarter", "ddate")
    newest = lambda df, name: df.groupBy("cik", quarter.alias("q")).agg(F.max("filed").alias(name))
    better = newest(company, "f").join(newest(bulk, "b"), ["cik", "q"], "left").where("b is null or f > b").select("cik", "q")
    own = company.withColumn("q", quarter).join(better, ["cik", "q"], "left_semi")
    rest = bulk.withColumn("q", quarter).join(better, ["cik", "q"], "left_anti")
    held = own.unionByName(rest).drop("q")
    return held.unionByName(filings.join(held.select("adsh").distinct(), "adsh", "left_anti"))


def beneish_m(now: dict[str, Column], before: dict[str, Column]) -> Column:
    """Beneish's eight ratios of two years' lines, held within 15; selling expenses count as unchanged. Above -1.78 earnings
    are likely to be managed."""
    share = lambda y, a, b: ratio(y[a], y[b])
    change = lambda a, b, first=now, second=before: ratio(share(first, a, b), share(second, a, b))
    soft = lambda y: 1 - ratio(F.coalesce(y["assets_current"], F.lit(0.0)) + F.coalesce(y["ppe"], F.lit(0.0)), y["assets"])
    worn = lambda y: ratio(y["dna"], y["dna"] + y["ppe"])
    m = -4.84 + 0.920 * change("receivables", "revenue") + 0.528 * change("gross_profit", "revenue", before, now) + 0.404 * ratio(soft(now), soft(before)) + 0.892 * ratio(now["revenue"], before["revenue"])
    m = m + 0.115 * ratio(worn(before), worn(now)) - 0.172 + 4.679 * ratio(now["net_income"] - now["cfo"], now["assets"]) - 0.327 * change("liabilities", "assets")
    return clip(m, -15.0, 15.0)


def derive(lines: dict[str, Column]) -> dict[str, Column]:
    """Concepts made of reported lines: a missing part counts as none where the whole is a sum, and a stand-in is named."""
    none = F.lit(0.0)
    return {
        "free_cash": F.coalesce(lines["net_income"], none) - lines["debt"],
        "total_debt": lines["debt"] + F.coalesce(lines["receivables"], none),
        "working": F.coalesce(lines["receivables"], 0.5 * lines["revenue"]),
        "reported": sum_reported(lines["net_income"], lines["receivables"]),
    }


#: Lines read as the trailing year's sum, else as reported; of these the outflows, which filers sign either way.
YEARLY = ("cogs", "opinc", "net_income", "cfo", "capex", "pretax", "tax", "interest_exp", "sbc", "dividends", "buybacks")
OUTFLOWS = ("capex", "interest_exp", "dividends", "buybacks")
BALANCES = ("assets", "assets_current", "liabilities", "liabilities_current", "equity", "inventory", "receivables", "payables", "retained", "ppe")
#: The share of a bank's two incomes below which its revenue is a part only; bounds and stand-in of the tax rate.
BANK_SHARE, TAX_RATE = 0.90, (0.0, 0.50, 0.21)


def derived(lines: list[str]) -> dict[str, Column]:
    """Every concept that metrics need, from the raw columns that a frame has; one that is not among lines counts as null.

    Revenue: the trailing sum, else the reported one; a bank's interest and other income where that is missing or much
    less; null where it lies below a positive net income that neither operating nor pre-tax income bounds. Depreciation
    and amortisation: their reported total, else the sum of what is there of the two."""
    have = set(lines)
    raw = lambda name: F.col(name).cast("double") if name in have else F.lit(None).cast("double")
    yearly = lambda name: F.coalesce(raw(f"{name}_ttm"), raw(name))
    out = {name: F.abs(yearly(name)) if name in OUTFLOWS else yearly(name) for name in YEARLY} | {name: raw(name) for name in BALANCES}
    sales, bank = yearly("revenue"), raw("nii_ttm") + raw("nonint_income_ttm")
    part = sales.isNull() | (sales < BANK_SHARE * bank)
    sales = F.when(F.coalesce((bank > 0) & part, F.lit(False)), bank).otherwise(sales)
    bounded = F.coalesce(sales >= F.coalesce(out["opinc"], out["pretax"]), F.lit(False))
    odd = F.coalesce((out["net_income"] > 0) & (sales < out["net_income"]), F.lit(False)) & ~bounded
    out["revenue"] = F.when(~odd, sales)
    out["gross_profit"] = F.coalesce(raw("gross_profit_ttm"), out["revenue"] - out["cogs"])
    out["dna"] = F.coalesce(yearly("dna"), sum_reported(yearly("deprec"), yearly("amort")))
    out["cash"], out["debt"] = sum_reported(raw("cash"), raw("sti")), sum_reported(raw("debt_lt"), raw("debt_st"))
    out["shares"] = F.coalesce(raw("shares_diluted"), raw("shares_out"), raw("shares_basic"))
    out["ebit"], out["ebitda"] = out["opinc"], out["opinc"] + out["dna"]
    out["fcf"], out["net_debt"] = out["cfo"] - out["capex"], out["debt"] - out["cash"]
    out["invested_capital"] = out["debt"] + out["equity"] - out["cash"]
    low, high, usual = TAX_RATE
    out["tax_rate"] = F.coalesce(clip(ratio(out["tax"], out["pretax"]), low, high), F.lit(usual))
    out["nopat"] = out["ebit"] * (1 - out["tax_rate"])
    return out


def anchored(df: DataFrame, by: str, day: str, reach: int) -> DataFrame:
    """(by, day, anchor): the first day of a group takes all within reach of it, then the next one begins. Sequential, so one
    pass over rows in order; companies are many and have few periods, so that a call for each would take longer than the rows."""
    import pyarrow as pa

    def run(batches):
        key, at = None, None
        for batch in batches:
            anchors = []
            for k, x in zip(batch[0].to_pylist(), batch[1].cast(pa.int32()).to_pylist(), strict=True):
                if k != key:
                    key, at = k, None
                if x is not None and (at is None or x - at > reach):
                    at = x
                anchors.append(at)
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(anchors, pa.int32()).cast(pa.date32())], names=[by, day, "anchor"])

    rows = df.select(F.col(by).cast("long"), day).repartition(by).sortWithinPartitions(by, day)
    return rows.mapInArrow(run, f"{by} long, {day} date, anchor date")
