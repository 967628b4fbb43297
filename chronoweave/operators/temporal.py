"""Temporal properties: points and intervals, reads at a time and over a range, aggregates over time.

Tables of points: entity, t, value. Tables of intervals: entity, st, et, value,
closed at both ends, not overlapping within an entity. Times are whole numbers
(seconds); NOW is an open end and is clipped before lengths are taken. A null
value says that there is none for that time. Entities may be several columns
(`by`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.model import NOW

ENTITY = ("entity",)


# --- interval algebra --------------------------------------------------------------------------------------------------


def overlaps(st1: Column, et1: Column, st2: Column, et2: Column) -> Column:
    return (st1 <= et2) & (st2 <= et1)


def contains(st1: Column, et1: Column, st2: Column, et2: Column) -> Column:
    """The first interval holds the second."""
    return (st1 <= st2) & (et2 <= et1)


def spans(st: Column, et: Column, t: Column | int) -> Column:
    """from < t <= to, as the reference's interval type has it."""
    return (st < t) & (t <= et)


def before(et: Column, t: Column | int) -> Column:
    return et < t


def from_on(st: Column, t: Column | int) -> Column:
    return st >= t


def clip(df: DataFrame, t0: int, t1: int) -> DataFrame:
    """The parts of the intervals that lie in [t0, t1]."""
    own = df.where((F.col("st") <= t1) & (F.col("et") >= t0))
    return own.withColumns({"st": F.greatest("st", F.lit(t0).cast("bigint")), "et": F.least("et", F.lit(t1).cast("bigint"))})


# --- points and intervals ----------------------------------------------------------------------------------------------


def points_to_intervals(points: DataFrame, by: Sequence[str] = ENTITY, end: int = NOW, chunk: int = 30 * 86_400) -> DataFrame:
    """A value set at t holds until the tick before the next point; the last one until `end`.

    Each entity's time line is cut into chunks, so that one of very many points
    is sorted by many tasks: the next point is looked for in the chunk, and the
    last of a chunk takes the first point of the next chunk that has one, from a
    table of chunks.
    """
    own = points.withColumn("chunk", F.floor(F.col("t") / chunk).cast("bigint"))
    firsts = own.groupBy(*by, "chunk").agg(F.min("t").alias("first"))
    after = firsts.withColumn("after", F.lead("first").over(Window.partitionBy(*by).orderBy("chunk"))).drop("first")
    following = F.lead("t").over(Window.partitionBy(*by, "chunk").orderBy("t"))
    rows = own.withColumn("following", following).join(after, [*by, "chunk"])
    et = F.coalesce(F.coalesce("following", "after") - 1, F.lit(end)).cast("bigint")
    return rows.select(*by, F.col("t").cast("bigint").alias("st"), et.alias("et"), "value")


def intervals_to_points(df: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """Points of intervals: their starts, and a null point after each end that nothing follows directly."""
    following = F.lead("st").over(Window.partitionBy(*by).orderBy("st"))
    marked = df.withColumn("following", following)
    starts = marked.select(*by, F.col("st").alias("t"), "value")
    ends = marked.where((F.col("et") < NOW) & (F.col("following").isNull() | (F.col("following") > F.col("et") + 1)))
    return starts.unionByName(ends.select(*by, (F.col("et") + 1).alias("t"), F.lit(None).cast(df.schema["value"].dataType).alias("value")))


def drop_invalid(df: DataFrame) -> DataFrame:
    """Without the stretches that have no value."""
    return df.where(F.col("value").isNotNull())


def coalesce_equal(df: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """Join neighbouring intervals of equal value (null equals null)."""
    w = Window.partitionBy(*by).orderBy("st")
    new = ~(F.col("value").eqNullSafe(F.lag("value").over(w)) & (F.col("st") == F.lag("et").over(w) + 1))
    runs = df.withColumn("new", F.coalesce(new, F.lit(True))).withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    return runs.groupBy(*by, "run").agg(F.min("st").alias("st"), F.max("et").alias("et"), F.first("value").alias("value")).drop("run")


def drop_redundant(points: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """Points that change something: the first of each entity and those whose value differs from the one before."""
    w = Window.partitionBy(*by).orderBy("t")
    first, last = F.row_number().over(w) == 1, F.lag("value").over(w)
    return points.withColumn("first", first).withColumn("last", last).where(F.col("first") | ~F.col("value").eqNullSafe(F.col("last"))).drop("first", "last")


def drop_never_valid(points: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """Without the entities whose only point has no value."""
    some = points.groupBy(*by).agg(F.count("*").alias("n"), F.count("value").alias("valid"))
    return points.join(some.where("n > 1 or valid > 0").select(*by), list(by), "left_semi")


def latest(points: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """The last point of each entity."""
    return points.groupBy(*by).agg(F.max("t").alias("t"), F.max_by("value", "t").alias("value"))


# --- reads -------------------------------------------------------------------------------------------------------------


def snapshot(df: DataFrame, t: int, by: Sequence[str] = ENTITY) -> DataFrame:
    """The value of each entity at time t; entities without one are left out."""
    return drop_invalid(df.where((F.col("st") <= t) & (F.col("et") >= t))).select(*by, "value")


def snapshot_of_points(points: DataFrame, t: int, by: Sequence[str] = ENTITY) -> DataFrame:
    """As snapshot, from points: the last at or before t, found without sorting."""
    found = points.where(F.col("t") <= t).groupBy(*by).agg(F.max(F.struct("t", "value")).alias("p"))
    return found.select(*by, F.col("p.value").alias("value")).where(F.col("value").isNotNull())


def point_read(df: DataFrame, entity, t: int) -> DataFrame:
    """The value of one entity at time t: no row if it has none."""
    return snapshot(df.where(F.col("entity") == entity), t)


def history(df: DataFrame, t0: int, t1: int, by: Sequence[str] = ENTITY) -> DataFrame:
    """Values over [t0, t1], clipped, equal neighbours joined; stretches without a value are left out."""
    return coalesce_equal(drop_invalid(clip(df, t0, t1)), by)


def history_with_gaps(df: DataFrame, t0: int, t1: int, by: Sequence[str] = ENTITY) -> DataFrame:
    """As history, and null rows for the parts of [t0, t1] in which an entity of the table has no value."""
    own = drop_invalid(clip(df, t0, t1)).select(*by, "st", "et", "value")
    w = Window.partitionBy(*by).orderBy("st")
    marked = own.withColumns({"prior": F.lag("et").over(w), "following": F.lead("st").over(w)})
    none = F.lit(None).cast(df.schema["value"].dataType).alias("value")
    inner = marked.select(*by, F.coalesce(F.col("prior") + 1, F.lit(t0)).cast("bigint").alias("st"), (F.col("st") - 1).alias("et"), none)
    tail = marked.where(F.col("following").isNull()).select(*by, (F.col("et") + 1).alias("st"), F.lit(t1).cast("bigint").alias("et"), none)
    whole = df.select(*by).distinct().join(own.select(*by).distinct(), list(by), "left_anti").select(*by, F.lit(t0).cast("bigint").alias("st"), F.lit(t1).cast("bigint").alias("et"), none)
    gaps = inner.unionByName(tail).where(F.col("st") <= F.col("et")).unionByName(whole)
    return coalesce_equal(own.unionByName(gaps), by)


def within_exists(df: DataFrame, t0: int, t1: int, low, high, by: Sequence[str] = ENTITY) -> DataFrame:
    """Entities whose value was in [low, high] at some time in [t0, t1]."""
    inside = (F.col("st") <= t1) & (F.col("et") >= t0) & F.col("value").between(low, high)
    return df.where(inside).select(*by).distinct()


# --- aggregates over a range -------------------------------------------------------------------------------------------


def aggregate_range(df: DataFrame, t0: int, t1: int, *aggregates: Column, by: Sequence[str] = ENTITY) -> DataFrame:
    """Any aggregates of the values that hold at some time in [t0, t1]; columns st, et are clipped."""
    return drop_invalid(clip(df, t0, t1)).groupBy(*by).agg(*aggregates)


def aggregate_grouped(df: DataFrame, t0: int, t1: int, group: Column, *aggregates: Column, by: Sequence[str] = ENTITY, gaps: bool = False) -> DataFrame:
    """Aggregates by entity and by a group that is told from st, et and value (columns; null groups are left out).

    With gaps, stretches without a value take part with a null value.
    """
    own = history_with_gaps(df, t0, t1, by) if gaps else drop_invalid(clip(df, t0, t1))
    own = own.withColumn("g", group).where(F.col("g").isNotNull())
    return own.groupBy(*by, "g").agg(*aggregates)


def range_until(df: DataFrame, t0: int, t1: int, stop: Column, by: Sequence[str] = ENTITY) -> DataFrame:
    """The entries of [t0, t1] in order of time, up to and with the first of each entity for which stop is true."""
    own = clip(df, t0, t1)
    first = own.where(stop).groupBy(*by).agg(F.min("st").alias("_last"))
    found = own.join(first, list(by), "left").where(F.col("_last").isNull() | (F.col("st") <= F.col("_last")))
    return found.select(*by, "st", "et", "value")


def maximum(df: DataFrame, t0: int, t1: int, by: Sequence[str] = ENTITY) -> DataFrame:
    return aggregate_range(df, t0, t1, F.max("value").alias("max_value"), by=by)


def minimum(df: DataFrame, t0: int, t1: int, by: Sequence[str] = ENTITY) -> DataFrame:
    return aggregate_range(df, t0, t1, F.min("value").alias("min_value"), by=by)


def extremes(df: DataFrame, t0: int, t1: int, by: Sequence[str] = ENTITY) -> DataFrame:
    return aggregate_range(df, t0, t1, F.min("value").alias("min_value"), F.max("value").alias("max_value"), by=by)


def length() -> Column:
    """Ticks of an interval, both ends counted."""
    return F.col("et") - F.col("st") + 1


def duration_by_value(df: DataFrame, t0: int, t1: int, by: Sequence[str] = ENTITY) -> DataFrame:
    """How long each entity had each value in [t0, t1]."""
    return drop_invalid(clip(df, t0, t1)).groupBy(*by, "value").agg(F.sum(length()).alias("duration"))


def bucket(value: Column, starts: Sequence[float]) -> Column:
    """The greatest start that is not above the value; null below the first."""
    marks = F.array(*(F.lit(float(s)) for s in sorted(starts)))
    return F.array_max(F.filter(marks, lambda s: s <= value.cast("double")))


def duration_by_bucket(df: DataFrame, t0: int, t1: int, starts: Sequence[float], by: Sequence[str] = ENTITY) -> DataFrame:
    """How long each entity's value was in each bucket; time below the first bucket is dropped."""
    own = drop_invalid(clip(df, t0, t1)).withColumn("bucket", bucket(F.col("value"), starts)).where(F.col("bucket").isNotNull())
    return own.groupBy(*by, "bucket").agg(F.sum(length()).alias("duration"))


def change_count(df: DataFrame, by: Sequence[str] = ENTITY) -> DataFrame:
    """How often the value changed: the first counts if there is one, and so do changes from and to none."""
    w = Window.partitionBy(*by).orderBy("st")
    last = F.lag("value").over(w)
    changed = df.withColumn("changed", (~F.col("value").eqNullSafe(last)).cast("bigint"))
    return changed.groupBy(*by).agg(F.sum("changed").alias("changes"))


def sample_and_hold(df: DataFrame, t0: int, t1: int, step: int, by: Sequence[str] = ENTITY) -> DataFrame:
    """The value in force at t0, t0 + step, ... up to t1. Each interval yields its own instants, so no join is needed."""
    own = drop_invalid(clip(df, t0, t1))
    first = F.lit(t0) + F.ceil((F.col("st") - t0) / step) * step
    holds = own.withColumn("first", first.cast("bigint")).where(F.col("first") <= F.col("et"))
    return holds.select(*by, F.explode(F.sequence("first", "et", F.lit(step).cast("bigint"))).alias("t"), "value")
