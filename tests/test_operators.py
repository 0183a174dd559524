"""Hand-worked cases of the research operators."""

import datetime as dt
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.functions.ranks import rank_pct, safe_divide, sum_reported, t_stat
from barloom.operators import accounting as ac
from barloom.operators import asof, crosssection, events, levels, mapping, news, screening, upsert, windows
from barloom.operators import backtest as bt
from barloom.sources import formats
from barloom.streaming import incremental, registry


def day(s):
    return dt.date.fromisoformat(s)


def test_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 4.0), (1, None)], "g int, v double")
    assert sorted((r[0] for r in df.select(rank_pct("v", "g")).collect()), key=lambda x: (x is None, x)) == [0.25, 0.625, 0.625, 1.0, None]


def test_divide_and_sum(spark):
    row = spark.range(1).select(safe_divide(F.lit(1.0), F.lit(0.0)), safe_divide(F.lit(1.0), F.lit(None).cast("double")), safe_divide(F.lit(1e9), F.lit(1.0)), sum_reported(F.lit(None).cast("double"), F.lit(None).cast("double")), sum_reported(F.lit(None).cast("double"), F.lit(2.0))).first()
    assert tuple(row) == (None, None, 1e6, None, 2.0)


def test_t_needs_three(spark):
    assert spark.createDataFrame([(1.0,), (2.0,)], "v double").agg(t_stat("v")).first()[0] is None


FLOWS = [
    ("a", [("2025-12-31", 4, 7408.0), ("2025-03-28", 1, -5202.0), ("2026-04-03", 1, 2021.0)], 14631.0),
    ("b", [("2026-02-01", 4, 16325.0), ("2025-05-04", 1, 4325.0), ("2026-05-03", 1, 6032.0)], 18032.0),
    ("c", [("2025-12-31", 4, 8450.0), ("2025-06-30", 2, 2666.0), ("2026-06-30", 2, 3083.0)], 8867.0),
    ("d", [("2025-12-31", 4, 1000.0), ("2026-03-31", 1, 200.0)], 1000.0),
    ("e", [("2025-03-31", 1, 100.0), ("2025-06-30", 1, 110.0), ("2025-09-30", 1, 120.0), ("2025-12-31", 1, 90.0)], 420.0),
]


def flows(spark, cases):
    rows = [(i, name, day(d), q, v, day("2026-12-01")) for i, (name, facts, _) in enumerate(cases) for d, q, v in facts]
    return spark.createDataFrame(rows, "cik int, concept string, ddate date, qtrs int, value double, filed date")


def test_trailing_year(spark):
    got = {r.concept: r.value for r in ac.trailing_year(flows(spark, FLOWS)).collect()}
    assert got == {name: want for name, _, want in FLOWS}


def test_fourth_quarter(spark):
    quarters = [("2025-03-31", 1, 100.0), ("2025-06-30", 1, 110.0), ("2025-09-30", 1, 120.0)]
    cases = [("full", [*quarters, ("2025-12-31", 4, 500.0)], 0), ("gap", [*quarters[:2], ("2025-12-31", 4, 500.0)], 0), ("held", [*quarters, ("2025-12-31", 1, 9.0), ("2025-12-31", 4, 500.0)], 0)]
    assert [(r.concept, r.value) for r in ac.fill_fourth_quarter(flows(spark, cases)).collect()] == [("full", 170.0)]


def test_near_periods(spark):
    rows = flows(spark, [("x", [("2025-07-27", 1, 1.0), ("2025-07-31", 1, 2.0), ("2025-10-31", 1, 3.0)], 0)])
    assert sorted({r.period for r in ac.near_periods(rows).collect()}) == [day("2025-07-27"), day("2025-10-31")]


def test_backward_join_is_causal(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5), (3, 7)], "k int, t int")
    right = spark.createDataFrame([(1, 10, "a"), (1, 15, "b"), (1, 21, "c"), (2, 9, "d")], "k int, u int, v string")
    loose = {(r.k, r.t): r.v for r in asof.backward(left, right, "k", "t", "u", ["v"]).collect()}
    strict = {(r.k, r.t): r.v for r in asof.backward(left, right, "k", "t", "u", ["v"], strict=True).collect()}
    assert loose == {(1, 10): "a", (1, 20): "b", (2, 5): None, (3, 7): None} and strict[1, 10] is None and strict[1, 20] == "b"


def test_public_session(spark):
    cal = spark.createDataFrame([(day(s),) for s in ("2026-10-21", "2026-10-22", "2026-10-23", "2026-10-26", "2026-11-02")], "session date")
    days = spark.createDataFrame([(day(s),) for s in ("2026-10-22", "2026-10-24", "2026-10-30", "2026-11-03")] + [(None,)], "d date")
    at = {r.d: r.s for r in asof.next_session(days, cal, "d", "s", at_or_after=True).collect()}
    after = {r.d: r.s for r in asof.next_session(days, cal, "d", "s").collect()}
    assert at[day("2026-10-22")] == day("2026-10-22") and after[day("2026-10-22")] == day("2026-10-23")
    assert at[day("2026-10-24")] == day("2026-10-26") and at[day("2026-10-30")] == day("2026-11-02") and at[day("2026-11-03")] is None and at[None] is None


def test_peer_price(spark):
    prices = [10.0, 10.5, 9.8, 4000.0]
    df = spark.createDataFrame([(1, i, day("2025-01-01"), p) for i, p in enumerate(prices)] + [(2, 9, day("2025-01-01"), 25.0)], "issuer int, owner int, filed date, price double")
    got = {r.owner: (r.n_peers, r.peer_median) for r in asof.neighbours_within(df, "issuer", "filed", 15, "price", "owner").collect()}
    assert got[3] == (3, 10.0) and got[9] == (0, None) and got[0] == (3, 10.5)


def path_row(spark, bars, entry=100.0, atr=5.0):
    return spark.createDataFrame([("t", day("2025-01-01"), entry, atr, [tuple(map(float, b)) for b in bars])], "ticker string, session date, entry double, atr double, path array<struct<h:double,l:double,c:double>>")


@pytest.mark.parametrize(
    "bars,rule,ret,held",
    [
        ([(101, 99, 100), (111, 100, 110)], "bracket_1x2", 0.10, 2),
        ([(101, 94, 96)], "bracket_1x2", -0.05, 1),
        ([(120, 90, 100)], "bracket_1x2", -0.05, 1),
        ([(101, 99, 100)] * 3, "bracket_1x2", 0.0, 3),
        ([(106, 100, 106), (107, 104, 105), (105, 100, 100)], "trail_1", 0.01, 3),
        ([(101, 99, 102), (101, 99, 103), (101, 99, 104), (101, 99, 107)], "hold_3", 0.04, 3),
    ],
)
def test_exits(spark, bars, rule, ret, held):
    row = bt.exits(path_row(spark, bars), [rule]).first()
    assert row.ret == pytest.approx(ret) and row.held == held


def test_exits_match_folds(spark):
    rng = np.random.default_rng(6)
    frames = None
    for _ in range(20):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, rng.integers(1, 25))))
        f = path_row(spark, [(x * 1.02, x * 0.98, x) for x in c]).withColumn("ticker", F.lit(f"t{_}"))
        frames = f if frames is None else frames.unionByName(f)
    for name, fold in {"stop2_hold20": bt.stop(2), "bracket_1x1.5": bt.bracket(1, 1.5), "trail_1.5": bt.trail(1.5), "hold_10": bt.hold(10)}.items():
        want = {r[0]: (pytest.approx(r[1]), r[2]) for r in frames.select("ticker", fold["price"] / F.col("entry") - 1, fold["held"]).collect()}
        assert {r.ticker: (r.ret, r.held) for r in bt.exits(frames, [name]).collect()} == want


def test_episodes(spark):
    df = spark.createDataFrame([("a", b) for b in (0, 5, 20, 21, 25, 60)], "ticker string, bar int")
    assert [r.bar for r in events.thin_episodes(df, 21).orderBy("bar").collect()] == [0, 21, 60]


def test_visits_and_bounces():
    low = np.full(200, 110.0)
    close = np.full(200, 112.0)
    for i in (5, 17, 100):
        low[i], close[i] = 100.0, 101.0
    high = np.full(200, 115.0)
    high[120] = 150.0
    visits = levels.visit_spans(low, close, 100.0)
    assert visits == [(5, 5), (17, 17), (100, 100)]
    assert levels.bounce_history(close, high, visits, 100.0) == [pytest.approx(0.15), pytest.approx(0.5)]
    assert len(levels.bounce_history(close[:130], high[:130], visits, 100.0)) == 1


def test_peaks():
    x = np.array([0, 1, 0, 3, 0, 2, 2, 2, 0, 5, 4.9, 5.2, 0])
    assert levels.peaks(x, 0.5, 1).tolist() == [1, 3, 6, 11]
    assert levels.peaks(x, 2.5, 1).tolist() == [3, 11]
    assert levels.peaks(x, 0.5, 4).tolist() == [3, 11]
    assert levels.peaks(np.insert(x, 4, np.nan), 2.5, 1).tolist() == [3, 12]
    assert levels.peaks(np.array([1.0, 2.0]), 0.1, 1).tolist() == []


def test_pivots_do_not_see_the_future():
    rng = np.random.default_rng(2)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.04, 400)))
    high, low = close * 1.02, close * 0.98
    cut = 300
    changed = close.copy()
    changed[cut:] *= rng.uniform(0.4, 2.5, 100)
    a = levels.pivot_places(high[:cut], low[:cut], close[:cut])
    b = levels.pivot_places((changed * 1.02)[:cut], (changed * 0.98)[:cut], changed[:cut])
    assert all((x == y).all() for x, y in zip(a, b, strict=True)) and len(a[0]) > 2


def test_information_coefficient(spark):
    rng = np.random.default_rng(1)
    rows = [(d, f"t{i}", float(v), float(v), float(-v)) for d in range(10) for i, v in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(rows, "d int, ticker string, v double, up double, down double")
    assert all(r.ic > 0.99 for r in crosssection.spearman_by(df, ["d"], "v", "up").collect())
    assert all(r.ic < -0.99 for r in crosssection.spearman_by(df, ["d"], "v", "down").collect())
    assert crosssection.spearman_by(df.where("ticker in ('t1', 't2', 't3')"), ["d"], "v", "up").first().ic is None
    assert all(r.spread > 0 for r in crosssection.quantile_spread(df, ["d"], "v", "up").collect())


def test_turnover_of_a_constant_ranking(spark):
    df = spark.createDataFrame([(d, f"t{i}", float(i), d) for d in range(1, 5) for i in range(20)], "d int, ticker string, v double, i int")
    assert {r.turnover for r in crosssection.turnover(df, "d", "v", 5, "i").collect()} == {0.0}


def test_squares_of_ema(spark):
    df = spark.createDataFrame([("a", day(f"2025-01-0{i}"), float(v)) for i, v in enumerate((1, 2, 2, 4), 1)], "ticker string, session date, close double")
    assert [r.e for r in windows.with_recursive(df, {"e": ("close", 0.5)}).orderBy("session").collect()] == [1.0, 1.5, 1.75, 2.875]


@pytest.mark.parametrize(
    "headline,event,sign",
    [
        ("Acme beats estimates", "EARNINGS_BEAT", 1),
        ("Acme misses Q3 EPS", "EARNINGS_MISS", -1),
        ("Acme prices $50M common stock offering", "OFFERING", -1),
        ("Here's how much you would have made owning Acme stock", "NOISE", 0),
        ("Broker maintains overweight, raises price target to $180", "ANALYST_MAINTAIN", 0),
        ("Acme opens a plant", "OTHER", 0),
        (None, "OTHER", 0),
    ],
)
def test_taxonomy(spark, headline, event, sign):
    row = news.classified(spark.createDataFrame([(headline,)], "headline string")).first()
    assert (row.event_type, row.event_dir) == (event, sign)


def test_lexicon():
    score = lambda t: news.LEXICON.score(t)[0]
    assert score("Acme fails to beat") < 0 < score("Acme beats")
    assert -1 <= score("guidance cut") < 0 and news.LEXICON.hits("guidance cut") == [-2.8]
    assert score("sharply strong") > score("strong") > score("slightly strong") > 0
    assert news.LEXICON.score(None) == (0.0, 0, 0)


def test_severity(spark):
    f = lambda base, burst, n, quiet: tx.severity(F.lit(base), F.lit(burst), F.lit(n), F.lit(quiet))
    row = spark.range(1).select(f(3.0, 0.0, 1, False), f(3.0, 3.0, 1, False), f(3.0, 0.0, 20, False), f(3.0, 3.0, 1, True), f(9.0, 9.0, 1, False)).first()
    assert row[0] < row[1] and row[2] < row[0] and row[3] == 0 and row[4] == 100


def test_written_values(spark):
    row = spark.range(1).select(tx.symbol(F.lit(" brk-b ")), tx.entity_name(F.lit("Acme Holdings, Inc.")), tx.number(F.lit("1,234.5")), tx.number(F.lit("n/a")), tx.any_date(F.lit("01-jan-2024")), tx.any_date(F.lit("20240102")), tx.any_date(F.lit("x")), tx.amount_range(F.lit("$1,001 - $15,000"))).first()
    assert tuple(row[:4]) == ("BRK.B", "acme", 1234.5, None) and row[4:7] == (day("2024-01-01"), day("2024-01-02"), None) and tuple(row[7]) == (1001.0, 15000.0)


def test_gates(spark):
    gates = [("A", "x > 1"), ("B", "y > 1"), ("C", "x < 9")]
    df = spark.createDataFrame([(2, 2), (0, 0), (5, None), (10, 3)], "x int, y int")
    assert [(r[0], r[1]) for r in df.select(screening.first_failure(gates), screening.failures(gates)).collect()] == [(None, []), ("A", ["A", "B"]), ("B", ["B"]), ("C", ["C"])]


def test_store_round_trip(spark, tmp_path):
    path = f"{tmp_path}/bars"
    rows = lambda *x: spark.createDataFrame([(t, day(s), c, s[:7]) for t, s, c in x], "ticker string, session date, close double, month string")
    for _ in range(2):  # writing twice changes nothing
        upsert.upsert(spark, path, rows(("a", "2025-01-02", 1.0), ("a", "2025-02-03", 2.0)), ["ticker", "session"], ["month"])
    upsert.upsert(spark, path, rows(("a", "2025-01-02", 9.0), ("b", "2025-01-05", 3.0)), ["ticker", "session"], ["month"])
    assert sorted((r.ticker, str(r.session), r.close) for r in spark.read.parquet(path).collect()) == [("a", "2025-01-02", 9.0), ("a", "2025-02-03", 2.0), ("b", "2025-01-05", 3.0)]


def test_mapping(spark):
    m = spark.createDataFrame([("BRK-B", 1), ("X", 2)], "ticker string, cik long")
    got = {(r.ticker, r.cik) for r in mapping.cik_aliases(m, spark.createDataFrame([(2, 7)], "cik long, old_cik long")).collect()}
    assert got == {("BRK-B", 1), ("BRK.B", 1), ("X", 2), ("X", 7)}
    mine = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "k int, a double, b double")
    theirs = spark.createDataFrame([(1, None, 5.0)], "k int, a double, b double")
    assert sorted(tuple(r) for r in mapping.overlay(mine, theirs, "k", ["a", "b"]).select("k", "a", "b").collect()) == [(1, 1.0, 5.0), (2, 2.0, 3.0)]


def test_short_volume(spark, tmp_path):
    (tmp_path / "f.txt").write_text("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n20240105|ABC|10|1|100|Q\n20240105|DEF|1|0|0|Q\n3\n")
    assert [tuple(r) for r in formats.short_volume(spark, str(tmp_path)).collect()] == [(day("2024-01-05"), "ABC", 10.0, 1.0, 100.0)]


def test_quarterly_facts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "2024q1.zip", "w") as z:
        z.writestr("sub.txt", "adsh\tcik\tform\tfiled\tfy\tfp\tsic\nA1\t7\t10-K\t20240301\t2023\tFY\t3571\nA2\t8\t8-K\t20240301\t2023\tFY\t1\n")
        z.writestr("num.txt", "adsh\ttag\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue\nA1\tAssets\t20231231\t0\tUSD\t\t\t5.5\nA1\tAssets\t20231231\t0\tUSD\tseg\t\t1\nA1\tOther\t20231231\t0\tUSD\t\t\t2\nA2\tAssets\t20231231\t0\tUSD\t\t\t3\n")
    got = [tuple(r) for r in formats.quarterly_facts(spark, f"{tmp_path}/*.zip", ["Assets"], ["10-K"]).select("cik", "adsh", "ddate", "value", "filed", "sic").collect()]
    assert got == [(7, "A1", day("2023-12-31"), 5.5, day("2024-03-01"), 3571)]


def test_company_facts(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2023-01-01", "end": "2023-12-31", "val": 9.5, "accn": "A", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01"}, {"end": "2023-12-31", "val": 1, "accn": "A", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01"}]}}}}}')
    assert sorted((r.cik, r.tag, r.qtrs, r.value, r.uom) for r in formats.company_facts(spark, str(tmp_path)).collect()) == [(7, "Revenues", 0, 1.0, "USD"), (7, "Revenues", 4, 9.5, "USD")]


def test_filing_index_and_submissions(spark, tmp_path):
    (tmp_path / "master.idx").write_text("Description: x\nCIK|Company Name|Form Type|Date Filed|Filename\n---\n7|Acme|4|2024-01-05|edgar/data/7/0000000007-24-000001.txt\n")
    assert [(r.cik, r.form, r.filed, r.accession) for r in formats.filing_index(spark, f"{tmp_path}/master.idx").collect()] == [(7, "4", day("2024-01-05"), "0000000007-24-000001")]
    (tmp_path / "s.json").write_text('{"cik": "7", "filings": {"recent": {"accessionNumber": ["A", "B"], "form": ["8-K", "S-1"], "filingDate": ["2024-01-05", "2024-01-06"], "items": ["2.02,9.01", ""], "acceptanceDateTime": ["2024-01-05T17:00:00.000Z", "2024-01-06T17:00:00.000Z"]}}}')
    assert [(r.cik, r.accession, r["items"]) for r in formats.submissions(spark, f"{tmp_path}/s.json", ["8-K"]).collect()] == [(7, "A", "2.02,9.01")]


def test_form4(spark):
    xml = "<ownershipDocument><periodOfReport>2024-01-03</periodOfReport><issuer><issuerCik>0000000007</issuerCik><issuerName>Acme</issuerName><issuerTradingSymbol>acm</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>0000000009</rptOwnerCik><rptOwnerName>Doe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2024-01-03</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts><postTransactionAmounts><sharesOwnedFollowingTransaction><value>300</value></sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    row = formats.form4(spark.createDataFrame([("A", xml)], "accession string, xml string")).first()
    assert (row.issuer_cik, row.issuer_symbol, row.owner_cik, row.is_director, row.trans_date, row.trans_code, row.value, row.shares_after) == (7, "ACM", 9, True, day("2024-01-03"), "P", 250.0, 300.0)


def test_feed_and_payload(spark):
    xml = "<rss><item><title><![CDATA[Extex soars]]></title><link>u</link><pubDate>now</pubDate><description>Extex (NASDAQ: EXTX) up</description></item></rss>"
    row = formats.feed_items(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (row.title, row.tickers) == ("Extex soars", ["EXTX"])
    page = '{"A": [{"t": "2024-01-05T14:30:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 5}, {"t": "2024-01-05T23:30:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 5}]}'
    got = formats.bars_payload(spark.createDataFrame([(page,)], "payload string")).collect()
    assert [(r.ticker, r.date, r.datetime.hour, r.trades) for r in got] == [("A", day("2024-01-05"), 9, 0)]


def test_registry():
    s = registry.step([], 0, 100, 3, 20)
    s = registry.step(s, 5, 102, 3, 20)
    s = registry.step(s, 10, 300, 3, 20)
    assert [(x["peak_idx"], x["seen"], x["run"], x["status"]) for x in s] == [(100, 2, 2, "active"), (300, 1, 1, "active")]
    s = registry.step(s, 40, 301, 3, 20)
    assert [x["status"] for x in s] == ["cooled", "active"]
    assert [x["status"] for x in registry.step(s, 200, 500, 3, 20)] == ["retired", "retired", "active"]


def test_registry_stream_equals_batch(spark, tmp_path):
    rows = pd.DataFrame({"ticker": [1, 1, 2, 1, 2], "day": [0, 5, 1, 50, 2], "peak_idx": [10, 12, 7, 99, 7]}).astype("int64")
    batch = registry.fold_setups(spark.createDataFrame(rows))
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = incremental.files(spark, f"{tmp_path}/in", spark.createDataFrame(rows).schema)
    held = []
    incremental.drain(registry.stream_setups(stream), lambda b, _: held.extend(b.collect()), f"{tmp_path}/cp", "update").awaitTermination()
    assert sorted(map(tuple, held)) == sorted(map(tuple, batch.collect()))


def test_incremental_upsert(spark, tmp_path):
    src, store, cp = f"{tmp_path}/src", f"{tmp_path}/store", f"{tmp_path}/cp"
    schema = "ticker string, session date, close double, month string"
    rows = lambda *x: spark.createDataFrame([(t, day(s), c, s[:7]) for t, s, c in x], schema)
    run = lambda: incremental.drain(incremental.files(spark, src, rows(("a", "2025-01-02", 1.0)).schema), incremental.upsert_sink(store, ["ticker", "session"], ["month"], "2025-01-31"), cp).awaitTermination()
    rows(("a", "2025-01-02", 1.0), ("a", "2025-02-01", 7.0)).write.mode("append").parquet(src)
    run()
    rows(("a", "2025-01-02", 2.0), ("b", "2025-01-03", 3.0)).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.ticker, r.close) for r in spark.read.parquet(store).collect()) == [("a", 2.0), ("b", 3.0)]


def test_steps():
    marks = {"a": "2025-01-02", "w": "2025-01-06"}

    def fail(_):
        raise ValueError("no")

    steps = [incremental.Step("a", lambda s: 3), incremental.Step("b", fail), incremental.Step("c", lambda s: 1, ["b"]), incremental.Step("w", lambda s: 1, weekly=True)]
    got = {r["step"]: r["status"] for r in incremental.run_steps(steps, marks, "2025-01-07")}
    assert got == {"a": "ok", "b": "failed", "c": "blocked", "w": "not due"} and marks["a"] == "2025-01-07"


def test_surprise_and_currency(spark):
    rows = [(1, "x", day(f"{2015 + i // 4}-{3 * (i % 4) + 1:02d}-01"), float(i * i)) for i in range(20)]
    got = [r.sue for r in ac.surprise(spark.createDataFrame(rows, "cik int, concept string, ddate date, value double")).orderBy("ddate").collect()]
    assert got[:8] == [None] * 8 and got[-1] is not None and math.isfinite(got[-1])
    df = spark.createDataFrame([(1, "USD"), (1, "EUR/shares"), (1, "EUR"), (1, "USD"), (2, "pure")], "cik int, uom string")
    assert [tuple(r) for r in ac.main_currency(df).collect()] == [(1, "EUR")]


def test_zeros_do_not_end_the_job(spark):
    """A zero price or value gives a null, where ANSI division would fail."""
    from barloom.operators import mapping, windows

    df = spark.createDataFrame([(1, i, float(o), 1.0, 0.0, float(c), 0.0) for i, (o, c) in enumerate([(1, 0), (0, 0), (2, 3), (4, 5)])], "ticker int, session int, open double, high double, low double, close double, volume double")
    up, down = windows.excursions(2)
    out = df.select("session", windows.forward_return(1).alias("f"), up.alias("up"), down.alias("down"), windows.drawdown(2).alias("d"), windows.vwma("close", "volume", 1).alias("v")).orderBy("session").collect()
    assert [r.f for r in out] == [None, 0.5, 0.25, None] and out[0].up is None and out[0].d is None and all(r.v is None for r in out)
    assert windows.with_step_z(df, 2, 1).count() == 4 and windows.with_market_beta(df).count() == 4
    pairs = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 1.04), (None, 1.0)], "a double, b double")
    assert [r[0] for r in pairs.select(mapping.compare(F.col("a"), F.col("b"), 0.05)).collect()] == ["differs", "ok", "ok", "missing"]


def test_repeats_inside_one_batch(spark):
    from barloom.operators import upsert

    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, upsert.insert_only(old, new, ["k"]).collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, upsert.keep_last(old, new, ["k"]).collect())) == [(1, "z"), (2, "c")]


def bounce_path() -> pd.DataFrame:
    """A base near 7.7 to 8.8 with three lows, a run to 26, and the way back to the base's lows."""
    legs = [(8, 8.6, 20), (8.6, 7.7, 15), (7.7, 8.8, 20), (8.8, 7.8, 20), (7.8, 8.4, 15), (8.4, 7.75, 15), (7.75, 26, 42), (26, 15, 20), (15, 17, 6), (17, 7.9, 22), (7.9, 9.4, 4)]
    c = np.concatenate([np.geomspace(a, b, n, endpoint=False) for a, b, n in legs]) * np.exp(np.random.default_rng(1).normal(0, 0.004, sum(n for *_, n in legs)))
    g = pd.DataFrame({"ticker": 1, "session": pd.bdate_range("2024-01-01", periods=len(c)).date, "open": np.r_[c[0], c[:-1]], "close": c, "volume": 1e6})
    return g.assign(high=g[["open", "close"]].max(axis=1) * 1.01, low=g[["open", "close"]].min(axis=1) * 0.99)


def test_bounce_screen(spark):
    """The run starts in the base, not inside the way up; the level is the base's lows, with its earlier visits only."""
    from barloom.operators import bounce

    g = bounce_path()
    flat = g.assign(ticker=2, open=10.0, close=10.0, high=10.1, low=9.9)
    rows = {x.ticker: x for x in bounce.screen(spark.createDataFrame(pd.concat([g, flat, flat.head(20).assign(ticker=3)]))).collect()}
    one = rows[1]
    assert set(rows) == {1, 2} and one.failed is None and one.shape == "SINGLE"
    assert one.peak == pytest.approx(g["high"].max()) and 3.2 < one.run_x < 3.7 and one.run_bars > 60
    assert 0.95 < one.retrace_of_run < 1.05 and abs(one.level / 7.7 - 1) < 0.02 and one.touches >= 2 and one.pre_run >= 1
    assert (one.grade, one.stage, one.bucket) == ("B", "CONFIRMED", "PRIME") and 45 <= one.score <= 100
    assert rows[2].failed == "NO_RUN" and rows[2].score is None


def test_bounce_reads_only_the_past():
    """A shorter history gives the row that was known then, whatever follows."""
    from barloom.operators import bounce

    g = bounce_path()
    later = g.tail(40).assign(close=99.0, high=100.0, low=98.0)
    assert bounce.read_name(g.head(190)) == bounce.read_name(pd.concat([g.head(190), later]).head(190).reset_index(drop=True))


def test_zone_scan_tells_of_every_name(spark):
    """Names with zones, a name without support, and a name whose price leapt without volume."""
    import math

    from barloom.operators import levels

    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    rows = []
    for i in range(300):
        x = 100 + 10 * math.sin(i / 8)
        for t, c in ((1, x), (2, 50 * 1.004**i), (3, x * (10 if i > 200 else 1))):
            rows.append((t, day(i), c, c * 1.01, c * 0.99, c, 100.0))
    got = levels.zone_scan(spark.createDataFrame(rows, "ticker long, session date, open double, high double, low double, close double, volume double")).collect()
    by = {t: [r for r in got if r.ticker == t] for t in (1, 2, 3)}
    assert by[1] and not any(r.no_support or r.suspect for r in by[1]) and all(r.touches >= 2 for r in by[1])
    assert [(r.level, r.no_support, r.suspect) for r in by[2]] == [(None, True, False)]
    assert [(r.level, r.no_support, r.suspect) for r in by[3]] == [(None, False, True)]
