"""Sources and sinks: static tables, temporal points and intervals, raw traffic lines, CSV with line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chronoweave.model import NOW


def _stack(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Long rows (prop, keys, value) from one column for each property; properties of several types become doubles or texts."""
    props = [c for c in df.columns if c not in keys]
    number = all(isinstance(df.schema[c].dataType, T.NumericType) for c in props)
    pairs = F.array(*(F.struct(F.lit(c.removeprefix(prefix)).alias("prop"), F.col(c).cast("double" if number else "string").alias("value")) for c in props))
    return df.select(*keys, F.explode(pairs).alias("p")).select("p.prop", *keys, "p.value")


def read_nodes(spark: SparkSession, path: str, schema: str, label: str, format: str = "csv") -> DataFrame:
    """Nodes of one label; schema starts with `id BIGINT, u_sid STRING`."""
    return _read(spark, path, schema, format).withColumn("labels", F.array(F.lit(label)))


def read_rels(spark: SparkSession, path: str, schema: str, kind: str, format: str = "csv") -> DataFrame:
    """Relationships of one type; schema starts with `id BIGINT, u_sid STRING, r_from BIGINT, r_to BIGINT`."""
    return _read(spark, path, schema, format).withColumnsRenamed({"r_from": "src", "r_to": "dst"}).withColumn("type", F.lit(kind))


def read_points(spark: SparkSession, path: str, schema: str, format: str = "csv") -> DataFrame:
    """prop, entity, t, value from a table `t, entity, <property columns>`."""
    return _stack(_read(spark, path, schema, format), ["t", "entity"], "").select("prop", "entity", F.col("t").cast("bigint").alias("t"), "value")


def read_intervals(spark: SparkSession, path: str, schema: str, format: str = "csv") -> DataFrame:
    """prop, entity, st, et, value from a table `st, et, entity, <property columns>`; ends are closed, NOW is open."""
    found = _stack(_read(spark, path, schema, format), ["st", "et", "entity"], "")
    et = F.when(F.col("et") >= NOW, F.lit(NOW)).otherwise(F.col("et"))
    return found.select("prop", "entity", F.col("st").cast("bigint").alias("st"), et.cast("bigint").alias("et"), "value")


def _read(spark: SparkSession, path: str, schema: str, format: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if format == "csv" else reader.format(format).load(path)


def read_traffic(spark: SparkSession, path: str, year: int) -> DataFrame:
    """road, t, jam_status, segment_count, travel_time from lines `MMDDhhmm road status segments time`; other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.size(parts) == 5)
    stamp = F.concat(F.lit(str(year)), F.get(parts, F.lit(0)))
    t = F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmm")))
    numbers = [F.get(parts, F.lit(i)).try_cast("int").alias(n) for i, n in ((2, "jam_status"), (3, "segment_count"), (4, "travel_time"))]
    return lines.select(F.get(parts, F.lit(1)).alias("road"), t.alias("t"), *numbers).where(F.col("t").isNotNull())


def load_csv(spark: SparkSession, path: str, headers: bool = True, delimiter: str = ",", name: str = "row") -> DataFrame:
    """Rows of a CSV file as a map (headers) or a list of texts, with file; line numbers need with_line_numbers()."""
    found = spark.read.option("header", headers).option("sep", delimiter).option("inferSchema", False).csv(path)
    cells = [F.col(f"`{c}`") for c in found.columns]
    value = F.create_map(*(x for c, cell in zip(found.columns, cells, strict=True) for x in (F.lit(c), cell))) if headers else F.array(*cells)
    return found.select(value.alias(name), F.input_file_name().alias("file"))


def with_line_numbers(df: DataFrame, name: str = "linenumber") -> DataFrame:
    """Numbers from 1 in the order of the file: rank within a partition plus the rows of the partitions before."""
    from pyspark.sql import Window

    marked = df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.shiftleft(F.col("_part").cast("bigint"), 33)
    return marked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") - first + 1).drop("_part", "_row", "_n", "_before")


def write_graph(nodes: DataFrame, rels: DataFrame, path: str) -> None:
    """Nodes by id, relationships by type and start: the layout that scans and expansions read."""
    nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    rels.repartition("type", F.floor(F.col("src") / 1_000_000)).sortWithinPartitions("type", "src").write.mode("overwrite").partitionBy("type").parquet(f"{path}/rels")


def write_temporal(tp: DataFrame, path: str) -> None:
    """Intervals by property, sorted by entity and start, so statistics skip what a read doesn't need."""
    tp.repartitionByRange("prop", "entity").sortWithinPartitions("prop", "entity", "st").write.mode("overwrite").partitionBy("prop").parquet(path)
