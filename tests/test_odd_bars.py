"""Zero prices, zero volumes, a flat name and tied ranks through every registered query that reads bars or orders."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from barloom.plans import catalog

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables, with a name that never moves, a name of zero prices, and zero quantities."""
    path = str(tmp_path_factory.mktemp("odd"))
    for name in os.listdir(BASE):
        if name.endswith(".parquet") and name not in ("lineitem.parquet", "orders.parquet"):
            shutil.copy(f"{BASE}/{name}", f"{path}/{name}")
    flat, zero = F.col("l_suppkey") == 1, F.col("l_suppkey") == 2
    lines = spark.read.parquet(f"{BASE}/lineitem.parquet")
    lines = lines.withColumn("l_extendedprice", F.when(flat, F.col("l_quantity") * 10.0).when(zero | (F.col("l_orderkey") % 97 == 0), 0.0).otherwise(F.col("l_extendedprice")))
    lines = lines.withColumn("l_quantity", F.when(~flat & (F.col("l_orderkey") % 89 == 0), 0.0).otherwise(F.col("l_quantity")))
    # On some days all names have one price, so that ranks have no spread.
    tied = F.dayofmonth("l_shipdate").isin(3, 4, 5)
    lines.withColumn("l_extendedprice", F.when(tied, F.col("l_quantity") * 10.0).otherwise(F.col("l_extendedprice"))).write.parquet(f"{path}/lineitem.parquet")
    spark.read.parquet(f"{BASE}/orders.parquet").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice"))).write.parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize("start", "ABCDEFGHIJK")
def test_odd_rows_end_no_query(spark, odd, start):
    failed = {}
    for name, f in catalog.QUERIES.items():
        if name.startswith(start):
            try:
                f(spark, odd).write.format("noop").mode("overwrite").save()
            except Exception as e:
                failed[name] = str(e)[:150]
    assert not failed
