"""Rows without a price, an id or with scores half-way between two roundings, held against the SQL."""

import datetime as dt

import numpy as np
import pandas as pd
from test_order_and_ties import DAY, like_sql


def priced(spark, path, rows):
    """lineitem of (name, day offset, price or None, quantity)."""
    made = [(k, 1, n, DAY + dt.timedelta(days=d), p, q) for k, (n, d, p, q) in enumerate(rows)]
    spark.createDataFrame(made, "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return path


def test_size_of_a_bar_without_a_price(spark, tmp_path):
    """null where the SQL says mid."""
    rows = [(n, d, None if n == 3 and d == 1 else 100.0 + 7 * n + d, 2.0) for n in range(12) for d in range(3)]
    like_sql(spark, priced(spark, str(tmp_path), rows), "E13_size_terciles", ["lineitem"])


def test_last_price_of_a_name_whose_last_day_has_none(spark, tmp_path):
    """the last day's missing price made the share 0; a name without any price had 0 and not null."""
    rows = [(n, d, None if n == 3 or n == 2 and d > 8 else 100.0 + d * (-1) ** d, 2.0) for n in range(4) for d in range(11)]
    like_sql(spark, priced(spark, str(tmp_path), rows), "E85_profile_percentile", ["lineitem"])


def test_top_event_has_an_id(spark, tmp_path):
    """the greatest value of an event without id gave null, where the SQL passes it over."""
    at = dt.datetime(2024, 1, 9, 10)
    rows = [(1, at, 1, 2.0), (None, at, 1, 9.0), (2, at, 1, 5.0), (3, at, 1, 5.0), (None, at, 2, 1.0), (-(2**63), at, 3, 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").repartition(1).write.parquet(f"{tmp_path}/events.parquet")
    like_sql(spark, str(tmp_path), "E80_news_windows", ["events"])


def test_ranks_of_scores_between_two_roundings(spark, tmp_path):
    """shares of 1,024 names lie half-way between two ninth digits, where two ways of rounding part."""
    draw = np.random.default_rng(1)
    n, days = 1024, 22
    made = pd.DataFrame({"l_suppkey": np.repeat(np.arange(n), days), "day": np.tile(np.arange(days), n), "l_extendedprice": np.round(draw.uniform(900, 9000, n * days), 2), "l_quantity": draw.integers(1, 50, n * days).astype(float)})
    made["l_orderkey"], made["l_linenumber"] = np.arange(len(made)), 1
    made["l_shipdate"] = pd.Timestamp(DAY) + pd.to_timedelta(made.pop("day"), unit="D")
    spark.createDataFrame(made).write.parquet(f"{tmp_path}/lineitem.parquet")
    like_sql(spark, str(tmp_path), "E93_strategy_rank", ["lineitem"])
