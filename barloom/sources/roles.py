"""Market roles of the driver's tables: bars, calendar, sectors, facts, filings and news."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.ranks import ratio


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition at most, so that what a task holds does not grow with the tables.
ROWS_A_PART = 500_000


def parts(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int:
    """How many partitions hold a table's rows; the count is read from the files' footers."""
    return -(-table(spark, sf_dir, name).count() // ROWS_A_PART)


def dealt(df: DataFrame, n: int, *by: str) -> DataFrame:
    """df dealt by columns: as Spark would where that is enough, in n partitions where it would make fewer, larger ones."""
    return df.repartition(n, *by) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*by)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier's parts. Sums of doubles depend on their order, so lines are added in that of their orders:
    any task order gives one result, and names with the same lines have the same prices to the last bit.

    Lines are dealt by name once: the grouping and all windows by name that follow take no other exchange. A name and day
    has few lines, so that summing before the exchange would save little."""
    price = ratio(F.col("l_extendedprice"), F.col("l_quantity"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("session"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return (
        dealt(lines, parts(spark, sf_dir), "ticker")
        .sortWithinPartitions("ticker", "session", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
        .groupBy("ticker", "session")
        .agg(F.avg(price).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), ratio(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"), F.count("*").alias("trades"))
    )


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose prices move in steps: each name's volume of a session, modulo 21, is its move, from -10 to 10 percent. These
    have runs, retraces and levels, which prices that are drawn anew each session have not."""
    move = (F.pmod(F.col("volume").cast("long"), F.lit(21)) - 10) / 100.0
    past = Window.partitionBy("ticker").orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = bars(spark, sf_dir).withColumn("__move", move).withColumn("close", 50 * F.exp(F.sum("__move").over(past)))
    begun = F.col("close") * F.exp(-F.col("__move"))
    return b.select("ticker", "session", begun.alias("open"), (F.greatest(begun, F.col("close")) * 1.01).alias("high"), (F.least(begun, F.col("close")) * 0.99).alias("low"), "close", "volume", "trades")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and their numbers. A calendar has some hundred rows a year whatever the data, so one window holds it."""
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct()
    return days.withColumn("session_idx", F.row_number().over(Window.orderBy("session")).cast("long"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, subind, sector) of suppliers."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ticker"), F.col("n_name").alias("subind"), F.col("r_name").alias("sector"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal facts from orders: ddate is the quarter end before the filing."""
    filed = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("adsh"), F.col("o_orderpriority").alias("concept"), F.date_sub(F.trunc(filed, "quarter"), 1).alias("ddate"), filed.alias("filed"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("form"))


#: The same roles as DuckDB common table expressions, for the checks.
BARS = """bars AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS session, avg(l_extendedprice / l_quantity) AS open,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close,
 sum(l_quantity) AS volume, count(*) AS trades FROM lineitem GROUP BY 1, 2)"""
WALK = """wm AS (SELECT *, (CAST(volume AS BIGINT) % 21 - 10) / 100.0 AS mv FROM bars), wk AS (SELECT *, 50 * exp(sum(mv) OVER (PARTITION BY ticker ORDER BY session ROWS UNBOUNDED PRECEDING)) AS c FROM wm),
walk AS (SELECT ticker, session, c * exp(-mv) AS open, greatest(c * exp(-mv), c) * 1.01 AS high, least(c * exp(-mv), c) * 0.99 AS low, c AS close, volume, trades FROM wk)"""
CALENDAR = """cal AS (SELECT session, row_number() OVER (ORDER BY session) AS session_idx FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem))"""
SECTORS = """sectors AS (SELECT s_suppkey AS ticker, n_name AS subind, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FACTS = """facts AS (SELECT o_custkey AS cik, o_orderkey AS adsh, o_orderpriority AS concept, CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS ddate,
 CAST(o_orderdate AS DATE) AS filed, o_totalprice AS value, o_orderstatus AS form FROM orders)"""
