"""Tables written once that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths written in this process and not yet released.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one serves a local session, elsewhere its lack is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="barloom-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what is read twice is computed once, and a lost executor undoes nothing."""
    path = f"{shared_dir(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes all tables written so far; results that rest on them must have been read."""
    for path in WRITTEN:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    WRITTEN.clear()
