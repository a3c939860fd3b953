"""Session settings and the driver's tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "quern", **conf: str) -> SparkSession:
    """A session with this engine's settings; a cluster's own settings of memory and partitions are left alone."""
    b = SparkSession.builder.appName(app).config(map=CONF | conf)
    return (b.master(master) if master else b).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files that a task of work by row gets.
TASK_BYTES = 4 << 20


def spread(df: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of a table dealt to all cores, if its files are fewer or large: for work by row that weighs more than
    the rows. The number of tasks grows with the files, so the longest task doesn't."""
    n, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if files >= n and size <= files * 4 * task_bytes:
        return df
    return df.repartition(max(n, -(-size // task_bytes)))


def parts_of(source: DataFrame, part_bytes: int = 4 * TASK_BYTES) -> int:
    """As many partitions as a table has ``part_bytes``, or Spark's number if that is more or the size can't be told: in
    so many, what a partition holds of the table's rows doesn't grow with it."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes) if size < 1 << 50 else 0)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the folder all executors share and read again: what it holds no longer depends on replanning."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where all runs on one machine can it be unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where or "file:" + os.path.join(tempfile.gettempdir(), f"quern-tables-{os.getpid()}")
