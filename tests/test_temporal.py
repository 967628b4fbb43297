"""Temporal semantics on small cases, and overwriting against a simulation."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.model import NOW, PropertyGraph, TemporalProperty
from chronoweave.operators import intervals as I, temporal as T

IV = "entity long, st long, et long, value string"


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or ("entity", "st", "et", "value"))).collect()), key=repr)


def test_points_hold_until_the_next_even_across_chunks(spark):
    rows = [(1, 9, "A"), (1, 20, "B"), (1, 5_000_000, "C"), (2, 7, None)]
    found = T.points_to_intervals(spark.createDataFrame(rows, "entity long, t long, value string"), chunk=10)
    assert got(found) == [(1, 20, 4_999_999, "B"), (1, 5_000_000, NOW, "C"), (1, 9, 19, "A"), (2, 7, NOW, None)]


def test_overwrite_in_the_middle_keeps_what_was_before_and_after(spark):
    base = spark.createDataFrame([(1, 9, 19, "A"), (1, 20, NOW, "B")], IV)
    write = spark.createDataFrame([(1, 1, 12, 16, "C")], "seq long, entity long, st long, et long, value string")
    assert got(I.overwrite(base, write)) == [(1, 12, 16, "C"), (1, 17, 19, "A"), (1, 20, NOW, "B"), (1, 9, 11, "A")]


def test_overwrite_equals_a_simulation(spark):
    rng = random.Random(5)
    writes, want = [], []
    for entity in range(60):
        line = [None] * 40
        touched = [False] * 40
        for seq in range(rng.randint(1, 7)):
            a = rng.randint(0, 35)
            b = NOW if rng.random() < 0.25 else rng.randint(a, 39)
            v = rng.choice(["x", "y", "z", None])
            writes.append((seq, entity, a, b, v))
            for t in range(a, min(b, 39) + 1):
                line[t], touched[t] = v, True
        want += [(entity, t, line[t]) for t in range(40) if touched[t]]
    base = spark.createDataFrame([], IV)
    found = I.overwrite(base, spark.createDataFrame(writes, "seq long, entity long, st long, et long, value string"))
    ticks = found.select("entity", F.explode(F.sequence("st", F.least("et", F.lit(39).cast("long")))).alias("t"), "value")
    assert got(ticks, "entity", "t", "value") == sorted(want, key=repr)


def test_history_leaves_out_stretches_without_value_and_joins_equal_neighbours(spark):
    iv = spark.createDataFrame([(1, 0, 4, "A"), (1, 5, 9, "A"), (1, 10, 14, None), (1, 15, NOW, "A")], IV)
    assert got(T.history(iv, 2, 20)) == [(1, 15, 20, "A"), (1, 2, 9, "A")]
    assert got(T.history_with_gaps(iv, 2, 20)) == [(1, 10, 14, None), (1, 15, 20, "A"), (1, 2, 9, "A")]


def test_changes_count_the_first_value_and_changes_from_and_to_none(spark):
    iv = spark.createDataFrame([(1, 0, 4, "A"), (1, 5, 9, None), (1, 10, NOW, "A"), (2, 0, 4, None), (2, 5, 9, "B")], IV)
    assert got(T.change_count(iv), "entity", "changes") == [(1, 3), (2, 1)]


def test_time_groups_start_at_full_units_and_lie_inside(spark):
    start, end = 8 * 3600 + 4 * 60 + 33, 8 * 3600 + 23 * 60 + 15
    found = got(I.time_groups(spark, start, end, 7, "minute"), "g", "g_start", "g_end")
    assert found == [(0, 29_100, 29_519), (1, 29_520, 29_939)]


def test_overlap_join_gives_each_pair_once_for_any_slot_width(spark):
    a = spark.createDataFrame([(1, 0, 50, "a"), (1, 51, NOW, "b")], IV)
    b = spark.createDataFrame([(1, 40, 60, "c"), (2, 0, NOW, "d")], IV)
    for width in (1, 7, 1000):
        found = I.overlap_join(a, b, ["entity"], width, 0, 100)
        assert got(found, "st", "et", "value", "value_r") == [(40, 50, "a", "c"), (51, 60, "b", "c")]


def test_buckets_drop_what_is_below_the_first(spark):
    iv = spark.createDataFrame([(1, 0, 9, "5"), (1, 10, 19, "10"), (1, 20, 29, "77")], IV)
    found = T.duration_by_bucket(iv, 5, 25, [10, 50])
    assert got(found, "entity", "bucket", "duration") == [(1, 10.0, 10), (1, 50.0, 6)]


def test_points_and_intervals_round_trip(spark):
    rows = [(1, 0, 4, "A"), (1, 8, 9, "B"), (1, 10, NOW, "C"), (2, 3, 5, "D")]
    iv = spark.createDataFrame(rows, IV)
    assert got(T.drop_invalid(T.points_to_intervals(T.intervals_to_points(iv)))) == sorted(rows, key=repr)


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], IV)
    assert got(T.history(none, 0, 9)) == got(T.points_to_intervals(spark.createDataFrame([], "entity long, t long, value string"))) == []
    assert got(T.maximum(none, 0, 9), "entity") == []


def test_entities_with_one_point_without_value_go(spark):
    rows = spark.createDataFrame([(1, 0, None), (2, 0, None), (2, 5, "A")], "entity long, t long, value string")
    assert got(T.drop_never_valid(rows), "entity", "t") == [(2, 0), (2, 5)]


def test_declared_types_are_fixed(spark):
    g = PropertyGraph(spark.range(1), spark.range(1), node_tp=spark.createDataFrame([("p", 1, 0, 5, "7")], "prop string, entity long, st long, et long, value string"))
    g.declare(TemporalProperty("node", "p", "INT"))
    assert g.temporal("node", "p").collect()[0]["value"] == 7
    with pytest.raises(ValueError):
        g.declare(TemporalProperty("node", "p", "STRING"))
    with pytest.raises(KeyError):
        g.temporal("node", "q")
