"""Queries that must read all ids, not a part of them."""

from barloom.plans import catalog
from barloom.sources.roles import bars

SF = "/root/testdata/sf0.001"


def test_watchlist_tracks_every_name(spark):
    b, got = bars(spark, SF), catalog.QUERIES["E97_watchlist_all"](spark, SF)
    assert got.count() == b.count() and got.select("ticker").distinct().count() == b.select("ticker").distinct().count()
    assert {"worst", "ahead"} <= set(got.columns)
    assert catalog.QUERIES["E97_watchlist"](spark, SF).count() == b.count()


def test_missing_sessions_of_each_name(spark):
    rows = {(x.ticker, x.session) for x in bars(spark, SF).select("ticker", "session").collect()}
    days = {s for _, s in rows}
    spans = {t: [s for x, s in rows if x == t] for t in {t for t, _ in rows}}
    want = {(t, s) for t, own in spans.items() for s in days if min(own) < s < max(own) and (t, s) not in rows}
    got = [tuple(x) for x in catalog.QUERIES["H4_missing_by_ticker"](spark, SF).select("ticker", "session").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_purchases_of_owners_with_any_number(spark):
    for name in ("C10_purchase_filter", "C10_purchase_owners"):
        got = {x.owner % 10 for x in catalog.QUERIES[name](spark, SF).collect()}
        assert got == set(range(10))
