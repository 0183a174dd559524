"""paths of all bars went through an exchange to meet a handful of listed ones."""

from barloom.plans import catalog


def test_paths_are_not_dealt(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to guess at
    try:
        q = catalog.QUERIES["E99_shortlist_trades"](spark, "/root/testdata/sf0.01")
        plan = q._jdf.queryExecution().executedPlan().toString()
        rows = q.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "Exchange" not in plan[: plan.index("collect_list")]
    lines = plan[plan.index("REPARTITION_BY_COL") :]
    assert lines.index("LeftSemi") < lines.index("FileScan")  # lines of other names go before they are dealt
    assert len(rows) > 0 and max(r.place for r in rows) == 5
