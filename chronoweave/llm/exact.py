"""Exact deduplication by a stateful stream.

A stream of (digest, key, locator) rows is grouped by digest. The state, one
row for each digest, is kept on disk (RocksDB) and never expires; it retains
the digest, the stable identifier of the row that stays, the locator of its
content and the number of rows. Copies are combined in the map tasks before
they reach the state, so a text with very many copies doesn't fill one task.

Where a digest has more than one row, the full bytes of its texts are compared;
should two texts share a digest, the groups of that digest are formed by the
texts themselves.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from chronoweave.llm.session import new_folder, write_shared

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition sets aside megabytes for its logs
}


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def keyed_state(stream: DataFrame, key: str, folder: str) -> str:
    """Run what the stream has so far through the state; returns the folder of the updated groups.

    stream: digest, key, locator. folder holds checkpoint (state and progress)
    and groups; run again with the same folder, the stream goes on where it was
    and only new rows are read. A batch that is repeated after a failure
    overwrites its own folder, so each update counts once.
    """
    spark = stream.sparkSession
    state = stream.groupBy("digest").agg(F.max(F.struct(F.col(key).alias("keep_key"), "locator")).alias("keep"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
            .foreachBatch(lambda df, epoch: df.select("digest", "keep.keep_key", "keep.locator", "n").write.mode("overwrite").parquet(f"{folder}/groups/epoch={epoch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    return f"{folder}/groups"


def latest(spark, groups: str, key_type: T.DataType) -> DataFrame:
    """digest, keep_key, locator, n: the last update of each digest."""
    fields = [T.StructField("digest", T.StringType()), T.StructField("keep_key", key_type), T.StructField("locator", T.LongType()), T.StructField("n", T.LongType()), T.StructField("epoch", T.LongType())]
    read = spark.read.schema(T.StructType(fields)).parquet(groups)
    last = F.max_by(F.struct("keep_key", "locator", "n"), "epoch").alias("g")
    return read.groupBy("digest").agg(last).select("digest", "g.*")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, files_per_batch: int | None = None, most_sent: int = 2_000_000) -> DataFrame:
    """One row for each row of docs: key, text_key, row, keep_id, group_size, kept, text_sha256, verified.

    Texts are equal when identical; null counts as empty. Of equal texts the row
    with the largest key stays (null keys are the smallest); of repeated rows
    with that key, one. text_key is xxhash64 of the text, row numbers the rows;
    verified says that the full bytes were compared (true for single texts).
    digest: the column that stands for a text in the state.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key).alias("key"), body.alias("body"))
    rows = write_shared(
        own.select("key", sha256(F.col("body")).alias("text_sha256"), digest(F.col("body")).cast("string").alias("digest"), F.xxhash64("body").alias("text_key"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    folder = new_folder(spark, "exact")
    reader = spark.readStream.schema(rows.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = os.path.dirname(rows.inputFiles()[0]) if rows.inputFiles() else None
    if path is None:
        groups = spark.createDataFrame([], T.StructType([T.StructField("digest", T.StringType()), T.StructField("keep_key", docs.schema[key].dataType), T.StructField("locator", T.LongType()), T.StructField("n", T.LongType())]))
    else:
        stream = reader.parquet(path).select("digest", F.col("key"), F.col("row").alias("locator"))
        groups = latest(spark, keyed_state(stream, "key", folder), docs.schema[key].dataType)
    groups = write_shared(groups, "groups")

    # Full bytes on hits: the least and the greatest text of a digest are the same only if all are.
    # The rows to compare are told by their text keys (8 bytes): sent to the tasks while they are few, so that copies are
    # combined before any shuffle; joined by a shuffle beyond that.
    several = rows.join(groups.where("n > 1").select("digest"), "digest", "left_semi").select("text_key").distinct()
    several = write_shared(several, "several")
    if several.limit(most_sent + 1).count() <= most_sent:
        several = F.broadcast(several)
    hits = own.withColumn("text_key", F.xxhash64("body")).join(several, "text_key", "left_semi").withColumn("digest", digest(F.col("body")).cast("string"))
    differ = hits.groupBy("digest").agg((F.min("body") == F.max("body")).alias("same")).where(~F.col("same")).select("digest", F.lit(True).alias("differ"))
    differ = write_shared(differ, "collisions")
    joined = rows.join(groups, "digest")
    if differ.isEmpty():
        found = joined.select("key", "text_key", "row", F.col("keep_key").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("locator")).alias("kept"), "text_sha256")
    else:
        plain = joined.join(differ, "digest", "left_anti")
        found = plain.select("key", "text_key", "row", F.col("keep_key").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("locator")).alias("kept"), "text_sha256")
        texts = own.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", digest(F.col("body")).cast("string")).join(differ, "digest", "left_semi")
        w = Window.partitionBy("body")
        best = F.max(F.struct("key", "row")).over(w)
        exact = texts.select("key", F.xxhash64("body").alias("text_key"), "row", best["key"].alias("keep_id"), F.count("*").over(w).alias("group_size"), (F.col("row") == best["row"]).alias("kept"), sha256(F.col("body")).alias("text_sha256"))
        found = found.unionByName(exact)
    return found.withColumnRenamed("key", key).withColumn("verified", F.lit(True))
