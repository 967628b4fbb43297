"""Temporal properties from a stream of writes.

Rows (entity, prop, t, value) say that a property has a value from t on. They are
kept as points, the newest write of a time winning; intervals are made when
they are read. A batch that is repeated after a failure replaces its own folder,
so its writes count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chronoweave.operators.temporal import points_to_intervals

POINTS = "entity BIGINT, prop STRING, t BIGINT, value DOUBLE"
_KEYS = ["entity", "prop"]


def append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start writing the stream's points below path, in one folder for each batch; returns the query."""

    def write(df: DataFrame, batch: int) -> None:
        df.select("entity", "prop", "t", "value").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def points(spark: SparkSession, path: str) -> DataFrame:
    """The points written so far; of several writes of one time, that of the latest batch."""
    schema = T.StructType([*T._parse_datatype_string(POINTS).fields, T.StructField("batch", T.LongType())])
    read = spark.read.schema(schema).parquet(path)
    newest = F.max_by(F.struct("value"), "batch").alias("v")
    return read.groupBy(*_KEYS, "t").agg(newest).select(*_KEYS, "t", F.col("v.value").alias("value"))


def intervals(spark: SparkSession, path: str) -> DataFrame:
    return points_to_intervals(points(spark, path), _KEYS)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the points as one sorted batch to another folder."""
    points(spark, path).repartitionByRange("prop", "entity").sortWithinPartitions("prop", "entity", "t").write.parquet(f"{to}/batch=0")


def windowed_extremes(stream: DataFrame, width: str, late: str) -> DataFrame:
    """entity, prop, window, min_value, max_value of a stream with a timestamp ts, kept open for rows up to `late` behind.

    Rows later than that are left out, as with any watermark.
    """
    own = stream.withWatermark("ts", late).groupBy("entity", "prop", F.window("ts", width))
    return own.agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))
