"""Readers of single filings."""

import datetime as dt

from barloom.sources import filings

def instance(facts: str) -> str:
    """An instance of our own: a half year, its end, the same end for one plant, and a scenario."""
    span = lambda a, b: f"<startDate>{a}</startDate><endDate>{b}</endDate>"
    context = lambda name, inside, more="": f'<context id="{name}"><entity/><period>{inside}</period>{more}</context>'
    plan = "<scenario><explicitMember dimension='v'>plan</explicitMember></scenario>"
    contexts = context("half", span("2031-01-01", "2031-06-30")) + context("late", span("2031-01-02", "2031-06-28")) + context("end", "<instant>2031-06-30</instant>") + context("bare", "<instant>2031-06-30</instant>", "<scenario/>") + context("plan", "<instant>2031-06-30</instant>", plan)
    rate = "<divide><unitNumerator><measure>iso4217:CHF</measure></unitNumerator><unitDenominator><measure>x:kilogram</measure></unitDenominator></divide>"
    return f'<xbrl xmlns:t="urn:t">{contexts}<unit id="money"><measure>iso4217:CHF</measure></unit><unit id="rate">{rate}</unit><unit id="area"><measure>x:m</measure><measure>x:m</measure></unit>{facts}</xbrl>'


def test_instances(spark):
    fact = lambda tag, context, unit, decimals, value: f'<t:{tag} contextRef="{context}" unitRef="{unit}" decimals="{decimals}">{value}</t:{tag}>'
    text = instance(
        fact("Stock", "end", "money", -4, 70000) + fact("Stock", "bare", "money", -1, 71230) + fact("Stock", "end", "money", -1, 71240) + fact("Stock", "plan", "money", "INF", 9)
        + fact("Sales", "late", "money", 0, 11) + fact("Sales", "half", "money", 0, 12) + fact("Price", "half", "rate", 2, "-0.0") + fact("Floor", "end", "area", "INF", 33) + fact("Lost", "end", "nowhere", 0, 1)
    )
    df = spark.createDataFrame([("A", text), ("B", "<broken"), ("C", None)], "accession string, xml string")
    end = dt.date(2031, 6, 30)
    got = [tuple(r) for r in filings.instances(df).orderBy("tag").collect()]
    assert got == [("A", "Floor", end, 0, "m*m", 33.0), ("A", "Price", end, 2, "CHF", 0.0), ("A", "Sales", end, 2, "CHF", 12.0), ("A", "Stock", end, 0, "CHF", 71230.0)]
    assert filings.instances(df, ["Stock"]).count() == 1


def test_month_end():
    d = dt.date
    assert [filings.month_end(d(2025, 2, 1)), filings.month_end(d(2025, 1, 20)), filings.month_end(d(2025, 4, 15)), filings.month_end(d(2025, 12, 31))] == [d(2025, 1, 31), d(2025, 1, 31), d(2025, 3, 31), d(2025, 12, 31)]


def test_house_trades(spark):
    text = "ID Owner Asset Transaction\nSP Apple Inc.\nCommon (AAPL) [ST] P 01/05/2024 01/10/2024 $1,001 - $15,000\nF S : New\nD : bought\nTreasury bill [GS] S 02/01/2024 02/02/2024 $50,001 - $100,000\nF S : New\nOdd Co (ODD) [ST] P 04/30/3031 02/02/2024 $1,001 - $15,000"
    got = {r.n: r for r in filings.house_trades(spark.createDataFrame([(7, text.split("\n", 1)[1]), (8, None), (9, "")], "doc_id int, text string")).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.owner, a.asset, a.ticker, a.asset_type, a.ttype, a.trans_date, a.amount_lo, a.amount_hi, a.status, a.description) == ("SP", "Apple Inc. Common (AAPL) [ST]", "AAPL", "ST", "P", dt.date(2024, 1, 5), 1001.0, 15000.0, "New", "bought")
    assert (b.owner, b.ticker, b.asset_type, b.ttype, b.amount_mid) == ("self", None, "GS", "S", 75000.5)
    assert c.ticker == "ODD" and c.trans_date is None and len(got) == 3
