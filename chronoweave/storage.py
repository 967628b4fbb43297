"""Tables written between steps of an iteration, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_SETTING = "spark.checkpoint.dir"

#: Spark drops the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one gets a folder of its own."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set(_SETTING, own)
    return own


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: ends its lineage, survives lost executors. The shuffle files of the write go when it ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _write(df, lambda w: w.parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As settle, in buckets of key: joins by key and groupings of it need no shuffle of this side. As many buckets as the session has shuffle partitions."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path, n = f"{shared_folder(spark)}/{table}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    _write(df.repartition(n, key), lambda w: w.bucketBy(n, key).format("parquet").option("path", path).saveAsTable(table))
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files are outside the warehouse and stay
    return found


def _write(df: DataFrame, write: Callable[[DataFrameWriter], None]) -> None:
    spark = df.sparkSession
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        write(df.write.option("compression", "zstd"))
    finally:
        spark.conf.set(_CLEANUP, was)
