"""Joins of intervals, overwriting, several properties at once, and rollups by calendar groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chronoweave.model import NOW
from chronoweave.operators.temporal import ENTITY, bucket, clip, coalesce_equal, drop_invalid, length, points_to_intervals


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], width: int, t0: int, t1: int) -> DataFrame:
    """Pairs of left and right rows of equal keys whose intervals overlap in [t0, t1], with the common part as st, et.

    Both sides are dealt out to the time slots of `width` that they touch, so
    the join is by keys and slot and an entity's time line is shared by many
    tasks; a pair that meets in several slots is kept in the one where its
    common part starts. Other columns of right get the suffix _r if left has them.
    """
    own, other = clip(left, t0, t1), clip(right, t0, t1)

    def slots(df: DataFrame) -> DataFrame:
        return df.withColumn("slot", F.explode(F.sequence(F.floor((F.col("st") - t0) / width), F.floor((F.col("et") - t0) / width))))

    names = {c: f"{c}_r" if c in left.columns else c for c in right.columns if c not in on}
    other = slots(other).select(*on, "slot", *(F.col(c).alias(n) for c, n in names.items()))
    pairs = slots(own).join(other, [*on, "slot"]).where((F.col("st") <= F.col("et_r")) & (F.col("st_r") <= F.col("et")))
    st, et = F.greatest("st", "st_r"), F.least("et", "et_r")
    kept = pairs.where(F.col("slot") == F.floor((st - t0) / width)).withColumns({"_st": st, "_et": et})
    return kept.drop("slot", "st", "et", "st_r", "et_r").withColumnsRenamed({"_st": "st", "_et": "et"})


def overwrite(base: DataFrame, writes: DataFrame, by: Sequence[str] = ENTITY, chunk: int = 86_400, most_chunks: int = 64) -> DataFrame:
    """Base history with writes (seq, entity, st, et, value) applied in the order of seq, later ones winning.

    The time line is cut at every start and after every end. On each elementary
    stretch the value of the highest seq that covers it holds, then that of the
    base; a write to NOW replaces all later history. Null writes win like others.
    Entities without writes pass through.

    The base value of a stretch is the last start before it, found in one pass
    in order of time. Writes meet stretches by entity and chunk of time: a write
    of up to most_chunks chunks is dealt out to them, a longer one to those of
    its entity that hold stretches. So neither history nor writes of an entity
    are paired as a whole.
    """
    by = list(by)
    touched = writes.select(*by).distinct()
    still = base.join(touched, by, "left_anti").select(*by, "st", "et", "value")
    own = base.join(touched, by, "left_semi").select(*by, "st", "et", "value")
    wanted = writes.select(*by, F.col("seq").cast("bigint").alias("seq"), "st", "et", "value")
    ends = [df.where(F.col("et") < NOW).select(*by, (F.col("et") + 1).alias("at")) for df in (own, wanted)]
    cuts = own.select(*by, F.col("st").alias("at")).union(wanted.select(*by, "st")).union(ends[0]).union(ends[1]).distinct()
    w = Window.partitionBy(*by).orderBy("at")
    starts = own.select(*by, F.col("st").alias("at"), F.struct("et", "value").alias("b"))
    parts = cuts.join(starts, [*by, "at"], "left").withColumns({"to": F.coalesce(F.lead("at").over(w) - 1, F.lit(NOW)).cast("bigint"), "b": F.last("b", ignorenulls=True).over(w)})
    parts = parts.withColumn("chunk", F.floor(F.col("at") / chunk))

    spans = wanted.withColumns({"c0": F.floor(F.col("st") / chunk), "c1": F.floor(F.col("et") / chunk)})
    short = F.col("c1") - F.col("c0") < most_chunks
    near = spans.where(short).withColumn("chunk", F.explode(F.sequence("c0", "c1")))
    held = parts.select(*by, "chunk").distinct()
    far = spans.where(~short).join(held, by).where(F.col("chunk").between(F.col("c0"), F.col("c1")))
    dealt = near.unionByName(far).select(*by, "chunk", "seq", "st", "et", F.struct("value").alias("v"))
    hits = parts.select(*by, "chunk", "at").join(dealt, [*by, "chunk"]).where(F.col("at").between(F.col("st"), F.col("et")))
    best = hits.groupBy(*by, "at").agg(F.max_by("v", "seq").alias("v"))
    found = parts.join(best, [*by, "at"], "left").where(F.col("v").isNotNull() | (F.col("b.et") >= F.col("to")))
    value = F.when(F.col("v").isNotNull(), F.col("v.value")).otherwise(F.col("b.value"))
    return still.unionByName(coalesce_equal(found.select(*by, F.col("at").alias("st"), F.col("to").alias("et"), value.alias("value")), by))


def append_open(base: DataFrame, points: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """Set values from t on, to NOW: each clears what its entity had from t on, in order of t.

    So the base is cut before an entity's first new point, and the points follow.
    """
    first = points.groupBy(*by).agg(F.min("t").cast("bigint").alias("first"))
    left = base.join(first, list(by), "left").where(F.col("first").isNull() | (F.col("st") < F.col("first")))
    left = left.select(*by, "st", F.least("et", F.col("first") - 1).alias("et"), "value")
    return left.unionByName(points_to_intervals(points, by).select(*by, "st", "et", "value"))


def overlay(old: DataFrame, new: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """New intervals over old ones: old ones are cut back to what new ones leave."""
    return overwrite(old, new.withColumn("seq", F.lit(0)), by)


def overlay_points(old: DataFrame, new: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """Points of both; at one time the new one."""
    both = old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))
    return both.groupBy(*by, "t").agg(F.max_by(F.struct("value"), "version").alias("v")).select(*by, "t", F.col("v.value").alias("value"))


def region(tables: Sequence[tuple[DataFrame, float, float]], t0: int, t1: int, width: int) -> DataFrame:
    """entity, st, et of the times in [t0, t1] when every property is in its range. tables: (intervals, low, high)."""
    found = None
    for df, low, high in tables:
        own = clip(df.where(F.col("value").between(low, high)), t0, t1).select("entity", "st", "et")
        found = own if found is None else overlap_join(found, own, ["entity"], width, t0, t1).select("entity", "st", "et")
    return found


# --- calendar groups and rollups ---------------------------------------------------------------------------------------


def time_groups(spark: SparkSession, start: int, end: int, every: int, unit: str) -> DataFrame:
    """g, g_start, g_end of the calendar-aligned groups of `every` units that lie wholly in [start, end].

    The first starts at the next full unit at or after start; a group ends a
    second before the next starts, and the stretch from the last start on is no
    group. unit: second, minute, hour, day, month or year (UTC).
    """
    # date_trunc and sequence by an interval keep to the calendar; the range is a parameter, so this is a small table
    at = F.timestamp_seconds(F.lit(start))
    floor = F.date_trunc(unit, at)
    first = F.when(floor == at, floor).otherwise(floor + F.expr(f"interval 1 {unit}"))
    rows = spark.range(1).select(F.sequence(first, F.timestamp_seconds(F.lit(end)), F.expr(f"interval {every} {unit}")).alias("s"))
    starts = rows.where(first <= F.timestamp_seconds(F.lit(end))).select(F.posexplode(F.transform("s", lambda x: F.unix_seconds(x))).alias("g", "g_start"), F.transform("s", lambda x: F.unix_seconds(x)).alias("s"))
    ends = F.get("s", F.col("g") + 1) - 1
    return starts.select(F.col("g").cast("bigint").alias("g"), "g_start", ends.alias("g_end")).where(F.col("g_end").isNotNull())


def split_by_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Intervals cut at the group borders: the columns of df and g, with st, et inside the group.

    Both are dealt out to time slots of the length of the shortest group and
    meet by slot, so an interval is compared with the groups that it touches;
    each pair is kept in the slot where its common part starts.
    """
    r = groups.agg(F.min("g_start").alias("a"), F.max("g_end").alias("b"), F.min(F.col("g_end") - F.col("g_start") + 1).alias("w")).first()
    if r["a"] is None:
        return df.where(F.lit(False)).withColumn("g", F.lit(0).cast("bigint"))

    def slot(t: Column) -> Column:
        return F.floor((t - r["a"]) / r["w"])

    own = clip(df, r["a"], r["b"]).withColumn("slot", F.explode(F.sequence(slot(F.col("st")), slot(F.col("et")))))
    there = groups.withColumn("slot", F.explode(F.sequence(slot(F.col("g_start")), slot(F.col("g_end")))))
    pairs = own.join(there, "slot").where((F.col("st") <= F.col("g_end")) & (F.col("g_start") <= F.col("et")))
    pairs = pairs.withColumns({"st": F.greatest("st", "g_start"), "et": F.least("et", "g_end")})
    return pairs.where(F.col("slot") == slot(F.col("st"))).drop("slot", "g_start", "g_end")


def duration_rollup(df: DataFrame, groups: DataFrame, starts: Sequence[float] | None = None, by: Sequence[str] = ENTITY) -> DataFrame:
    """entity, g, value or bucket, duration: the table behind range queries for durations."""
    own = split_by_groups(drop_invalid(df), groups)
    if starts is None:
        return own.groupBy(*by, "g", "value").agg(F.sum(length()).alias("duration"))
    own = own.withColumn("bucket", bucket(F.col("value"), starts)).where(F.col("bucket").isNotNull())
    return own.groupBy(*by, "g", "bucket").agg(F.sum(length()).alias("duration"))


def extremes_rollup(df: DataFrame, groups: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """entity, g, min_value, max_value."""
    own = split_by_groups(drop_invalid(df), groups)
    return own.groupBy(*by, "g").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def _covered(groups: DataFrame, t0: int, t1: int) -> tuple[DataFrame, int, int]:
    """Groups wholly in [t0, t1], and their first and last second (after t1 if there is none)."""
    full = groups.where((F.col("g_start") >= t0) & (F.col("g_end") <= t1))
    r = full.agg(F.min("g_start").alias("a"), F.max("g_end").alias("b")).first()
    return (full, r["a"], r["b"]) if r["a"] is not None else (full, t1 + 1, t1)


def maximum_from_rollup(df: DataFrame, rollup: DataFrame, groups: DataFrame, t0: int, t1: int, by: Sequence[str] = ENTITY) -> DataFrame:
    """maximum() answered by the rollup for whole groups, and by the intervals for the two ends."""
    full, a, b = _covered(groups, t0, t1)
    inner = rollup.join(F.broadcast(full.select("g")), "g", "left_semi").select(*by, F.col("max_value").alias("value"))
    return inner.unionByName(_edges(df, t0, t1, a, b).select(*by, "value")).groupBy(*by).agg(F.max("value").alias("max_value"))


def duration_from_rollup(df: DataFrame, rollup: DataFrame, groups: DataFrame, t0: int, t1: int, starts: Sequence[float], by: Sequence[str] = ENTITY) -> DataFrame:
    """duration_by_bucket() answered by the rollup for whole groups, and by the intervals for the two ends."""
    full, a, b = _covered(groups, t0, t1)
    inner = rollup.join(F.broadcast(full.select("g")), "g", "left_semi").select(*by, "bucket", "duration")
    edges = _edges(df, t0, t1, a, b).withColumn("bucket", bucket(F.col("value"), starts)).where(F.col("bucket").isNotNull())
    return inner.unionByName(edges.select(*by, "bucket", length().alias("duration"))).groupBy(*by, "bucket").agg(F.sum("duration").alias("duration"))


def _edges(df: DataFrame, t0: int, t1: int, a: int, b: int) -> DataFrame:
    own = drop_invalid(df)
    if a > t1:
        return clip(own, t0, t1)
    return clip(own, t0, a - 1).unionByName(clip(own, b + 1, t1))


def value_index(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write intervals sorted by value, so that row-group statistics answer box queries (read back with where())."""
    own = df.repartitionByRange(partitions, "value") if partitions else df.repartitionByRange("value")
    own.sortWithinPartitions("value", "st", "et").write.parquet(path)


def condition(low, high, t0: int, t1: int) -> Column:
    """The box of a value index query, as a predicate that Parquet can push down."""
    return F.col("value").between(low, high) & (F.col("st") <= t1) & (F.col("et") >= t0)
