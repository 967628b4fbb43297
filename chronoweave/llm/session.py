"""What the operators need of a session: the shared folder, shipped code, free column names."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting (tests) gets a new folder of its own.
    """
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set(_SETTING, own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark drops the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs one read, no recomputation,
    and two later uses see the same rows. The shuffle files of the write go
    when it ends, so a chain of steps holds those of one step at a time.
    """
    spark = df.sparkSession
    path, was = new_folder(spark, name), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict = {}


def worker_cache(name, make):
    """What an operator keeps in a Python worker between tasks (make() at first).

    A worker outlives its task and may serve other operators after it: the
    cache of another name is dropped, so a worker holds one at a time.
    """
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


#: Bytes of a batch between Spark and Python, unless the session has another number: a batch is held several times over.
_BATCH, _BATCH_SETTING, _BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, and keep Arrow batches small."""
    if spark.conf.get(_BATCH_SETTING).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_SETTING, f"{_BATCH}b")
    sc = spark.sparkContext
    if getattr(sc, "_chronoweave_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="spark-code-"), "chronoweave.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(folder, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(top)))
    sc.addPyFile(to)
    sc._chronoweave_shipped = True


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added while the input has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_offsets(parts: DataFrame, by: list[str], order: str, count: str, name: str) -> DataFrame:
    """Exclusive running sum of count over order within by. parts holds a row for each part only."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(count).over(w), F.lit(0)).cast("long"))
