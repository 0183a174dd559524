"""Results that must not hang on the order of rows, and ties that the SQL settles; tables too large for all pairs."""

import datetime as dt
import random
import statistics

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions.text import first_match
from barloom.operators import asof
from barloom.plans import catalog
from barloom.sources.roles import bars

DAY = dt.datetime(1997, 3, 3)


def lines(spark, path, rows):
    """lineitem of (order, line, name, day offset, price, quantity), in the order given."""
    made = pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_suppkey", "day", "l_extendedprice", "l_quantity"])
    made["l_shipdate"] = [DAY + dt.timedelta(days=int(d)) for d in made.pop("day")]
    spark.createDataFrame(made).write.parquet(f"{path}/lineitem.parquet")
    return path


def like_sql(spark, path, name, tables):
    con = duckdb.connect()
    con.execute("SET threads=1")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.SQL[name]).fetchall()
    got = catalog.QUERIES[name](spark, path)
    names = [c[0] for c in con.description]
    assert {tuple(x[c] for c in names) for x in got.collect()} == set(want) and got.count() == len(want)


def test_names_with_the_same_lines_have_the_same_bars(spark, tmp_path):
    """sums of doubles in any order gave prices that differ in the last bit."""
    base = [(k, 1, 0, 0, p, q) for k, (p, q) in enumerate([(0.1, 3.0), (1e9 + 0.3, 7.0), (0.2, 11.0), (12345.67, 13.0), (0.7, 17.0)])]
    rows = []
    for name in range(40):
        mine = [(k + 10 * name, line, name, d, p, q) for k, line, _, d, p, q in base]
        random.Random(name).shuffle(mine)
        rows += mine
    b = bars(spark, lines(spark, str(tmp_path), rows))
    assert b.select("open", "close").distinct().count() == 1


def test_break_needs_two_bars_under_a_level(spark, tmp_path):
    """the bar before the first level counted as one under it."""
    closes = [1200.0, 90.0, 89.0, 60.0]
    rows = [(d, 1, 1, d, x, 1.0) for d, x in enumerate(closes)]
    path = lines(spark, str(tmp_path), [*rows, (9, 1, 1, 0, 100.0, 1.0)])
    like_sql(spark, path, "F21_support_broken", ["lineitem"])
    low = lines(spark, f"{tmp_path}/low", [(0, 1, 1, 0, 90.0, 1.0), (1, 1, 1, 0, 100.0, 1.0), (2, 1, 1, 1, 86.0, 1.0), (3, 1, 1, 2, 84.0, 1.0)])
    like_sql(spark, low, "F21_support_broken", ["lineitem"])
    odd = lines(spark, f"{tmp_path}/odd", [(0, 1, 1, 0, 100.0, 1.0), (1, 1, 1, 0, 100.0, 9.0), (2, 1, 1, 1, 10.7, 1.0)])
    like_sql(spark, odd, "F21_support_broken", ["lineitem"])


def test_first_of_equal_values_is_the_top(spark, tmp_path):
    """of a user's events with the same greatest value any one came."""
    at = dt.datetime(2024, 1, 9, 10)
    rows = [(e, at + dt.timedelta(minutes=e), e % 3, "view", float(v)) for e, v in enumerate([5, 1, 2, 5, 7, 2, 4, 7, 1])] + [(20, at, 5, "view", None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(1).orderBy("event_id").write.parquet(f"{tmp_path}/events.parquet")
    like_sql(spark, str(tmp_path), "E80_news_windows", ["events"])
    assert {x.user_id: x.top for x in catalog.QUERIES["E80_news_windows"](spark, str(tmp_path)).collect()} == {0: 0, 1: 4, 2: 2, 5: None}


def test_percentile_reads_the_bars_once(spark, tmp_path):
    """F8: the last close came from a second reading of the bars, which could differ in the last bit."""
    path = lines(spark, str(tmp_path), [(10 * d + k, 1, 1, d, 100.0 + k / 3, 3.0 + k) for d in range(9) for k in range(4)])
    q = catalog.QUERIES["E85_profile_percentile"](spark, path)
    assert q._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    like_sql(spark, path, "E85_profile_percentile", ["lineitem"])


def test_first_lines_are_classed_as_by_the_sql(spark, tmp_path):
    """letters beyond ASCII at ends of words, line ends inside a line, and a word before and after another."""
    texts = ["Acme beats, then a miss, then beats", "Caféfed and fedé plan", "raises\u000bFY guidance", "raises the FY guidance", "q2 a\rb sales", "the ſettlement", "banKrupt", "wins a   award", "q2\u0085 eps", "Acme misses", "beats it\nmiss", "", None, "Überfda fda"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    like_sql(spark, str(tmp_path), "I1_document_taxonomy", ["documents"])
    assert spark.range(1).select(first_match(F.lit("a beat, a miss, a beat"), [("x", r"\bbeats?\b(?!.*\bmiss)|tops")], "o").alias("k")).first().k == "o"


def test_peers_of_many_rows_on_few_days(spark, tmp_path):
    """values around a row were gathered for each row; here that would be 36 million numbers. Also brute force."""
    few = [(i % 2, i % 7 if i % 11 else None, dt.date(2025, 1, 1) + dt.timedelta(days=(i * 37) % 90) if i % 13 else None, None if i % 17 == 0 else float(i * 7919 % 101)) for i in range(1, 300)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(few)], "id int, issuer int, owner int, filed date, price double")
    for x in asof.neighbours_within(df, "issuer", "filed", 15, "price", "owner").collect():
        near = [y for y in few if None not in (x.owner, x.filed, y[1], y[2]) and y[0] == x.issuer and y[1] != x.owner and abs((y[2] - x.filed).days) <= 15]
        prices = [y[3] for y in near if y[3] is not None]
        assert x.n_peers == len(near) and x.peer_median == (statistics.median(prices) if len(near) >= 2 and prices else None), x
    many = spark.range(6000).selectExpr("0 as issuer", "id % 3000 as owner", "date_add(date'2025-01-01', cast(id % 4 as int)) as filed", "cast(id as double) as price")
    got = asof.neighbours_within(many, "issuer", "filed", 15, "price", "owner")
    assert got.where("n_peers = 5998 and peer_median between 2998 and 3001").count() == 6000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
