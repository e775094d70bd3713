"""Tables in the folder that all executors share: written once, read again, gone when released."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share (spark.checkpoint.dir). Where the session names none,
    a local master gets a temporary folder; on a cluster that is an error, for executors would write to their own disks."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        path = tempfile.mkdtemp(prefix="quillfact-")
        context.setCheckpointDir(path)
    return f"{path.rstrip('/')}/quillfact-{context.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, nothing is computed twice,
    and the table outlives any executor. Shuffle files of the job go with it: nobody reads them again."""
    spark = df.sparkSession
    path, was = f"{shared_dir(spark)}/{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all tables that settle has written; to be called when no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
