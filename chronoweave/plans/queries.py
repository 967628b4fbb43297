"""Queries over the driver's tables, each with DuckDB SQL for the same result.

Temporal properties come from `events`: entity user_id, time in whole seconds,
properties value (a number) and event_type (a text); of two events in one second
the later event_id counts. The graph is that of model.from_tables().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoweave.functions import aggregates as A, calendar, scalars, spatial, values as V
from chronoweave.model import NOW, from_tables
from chronoweave.operators import apply, expand as E, fulltext, intervals as I, scans as S, shaping as P, temporal as T, traversal, updates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Parameters of the queries: a week in January 2024, two instants, buckets and calendar groups.
T0, T1, AT, STEP = 1_704_500_000, 1_705_500_000, 1_705_000_000, 21_600
STARTS = (10.0, 50.0, 120.0)
EVERY_HOURS = 12


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- inputs ------------------------------------------------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str, prop: str = "value") -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return events.groupBy(F.col("user_id").alias("entity"), t.alias("t")).agg(F.max_by(prop, "event_id").alias("value"))


def history_of(spark: SparkSession, sf_dir: str, prop: str = "value") -> DataFrame:
    return T.points_to_intervals(points(spark, sf_dir, prop))


def _points(prop: str = "value", name: str = "pts") -> str:
    return f"{name} AS (SELECT user_id AS entity, floor(epoch(ts))::BIGINT AS t, arg_max({prop}, event_id) AS value FROM events GROUP BY 1, 2)"


def _intervals(prop: str = "value", name: str = "iv") -> str:
    return f"{_points(prop, name + '_pts')}, {name} AS (SELECT entity, t AS st, coalesce(lead(t) OVER (PARTITION BY entity ORDER BY t) - 1, {NOW})::BIGINT AS et, value FROM {name}_pts)"


def _clipped(prop: str = "value", name: str = "cl", t0: int = T0, t1: int = T1) -> str:
    return f"{_intervals(prop, name + '_iv')}, {name} AS (SELECT entity, greatest(st, {t0})::BIGINT AS st, least(et, {t1})::BIGINT AS et, value FROM {name}_iv WHERE st <= {t1} AND et >= {t0} AND value IS NOT NULL)"


NODES_SQL = """nodes AS (
  SELECT r_regionkey::BIGINT * 8 AS id, 'Region' AS label, r_name AS name, NULL::DOUBLE AS amount FROM region
  UNION ALL SELECT n_nationkey::BIGINT * 8 + 1, 'Nation', n_name, NULL FROM nation
  UNION ALL SELECT c_custkey * 8 + 2, 'Customer', c_mktsegment, c_acctbal FROM customer
  UNION ALL SELECT s_suppkey * 8 + 3, 'Supplier', s_name, s_acctbal FROM supplier
  UNION ALL SELECT p_partkey * 8 + 4, 'Part', p_brand, p_retailprice FROM part
  UNION ALL SELECT o_orderkey * 8 + 5, 'Order', o_orderstatus, o_totalprice FROM orders)"""

RELS_SQL = """rels AS (
  SELECT n_nationkey::BIGINT * 8 AS id, 'IN_REGION' AS type, n_nationkey::BIGINT * 8 + 1 AS src, n_regionkey::BIGINT * 8 AS dst, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT c_custkey * 8 + 1, 'CUSTOMER_IN', c_custkey * 8 + 2, c_nationkey::BIGINT * 8 + 1, 1.0 FROM customer
  UNION ALL SELECT s_suppkey * 8 + 2, 'SUPPLIER_IN', s_suppkey * 8 + 3, s_nationkey::BIGINT * 8 + 1, 1.0 FROM supplier
  UNION ALL SELECT o_orderkey * 8 + 3, 'PLACED', o_custkey * 8 + 2, o_orderkey * 8 + 5, o_totalprice FROM orders
  UNION ALL SELECT (l_orderkey * 10000019 + l_partkey) * 8 + 4, 'CONTAINS', l_orderkey * 8 + 5, l_partkey * 8 + 4, sum(l_quantity) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT (l_partkey * 10000019 + l_suppkey) * 8 + 5, 'SUPPLIED_BY', l_partkey * 8 + 4, l_suppkey * 8 + 3, count(*)::DOUBLE FROM lineitem GROUP BY l_partkey, l_suppkey)"""

G = f"WITH {NODES_SQL}, {RELS_SQL} "


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the traversal queries start: every customer."""
    return S.nodes_by_label(from_tables(spark, sf_dir), "Customer").select("id")


STARTS_SQL = "starts AS (SELECT src AS id FROM rels WHERE type = 'CUSTOMER_IN')"  # one for each customer


# --- temporal reads ----------------------------------------------------------------------------------------------------


@query(f"WITH {_intervals()} SELECT entity, value FROM iv WHERE st <= {AT} AND et >= {AT} AND value IS NOT NULL")
def snapshot(spark, sf_dir):
    return T.snapshot(history_of(spark, sf_dir), AT)


@query(f"WITH {_points()} SELECT entity, arg_max(value, t) AS value FROM pts WHERE t <= {AT} GROUP BY entity")
def snapshot_of_points(spark, sf_dir):
    return T.snapshot_of_points(points(spark, sf_dir), AT)


@query(f"WITH {_intervals()} SELECT entity, value FROM iv WHERE entity = 3 AND st <= {AT} AND et >= {AT}")
def point_read(spark, sf_dir):
    return T.point_read(history_of(spark, sf_dir), 3, AT)


@query(f"WITH {_clipped()} SELECT entity, st, et, value FROM cl WHERE entity = 3")
def range_read(spark, sf_dir):
    return T.drop_invalid(T.clip(history_of(spark, sf_dir).where("entity = 3"), T0, T1)).select("entity", "st", "et", "value")


_RUNS = """marked AS (SELECT *, CASE WHEN lag(value) OVER w IS NOT DISTINCT FROM value AND lag(et) OVER w + 1 = st AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM {0} WINDOW w AS (PARTITION BY entity ORDER BY st)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY st) AS run FROM marked)
SELECT entity, min(st)::BIGINT AS st, max(et)::BIGINT AS et, any_value(value) AS value FROM runs GROUP BY entity, run"""


@query(f"WITH {_clipped('event_type')}, {_RUNS.format('cl')}")
def entity_history(spark, sf_dir):
    return T.history(history_of(spark, sf_dir, "event_type"), T0, T1)


@query(f"WITH {_intervals('event_type')}, {_RUNS.format('iv')}")
def coalesce_equal(spark, sf_dir):
    return T.coalesce_equal(history_of(spark, sf_dir, "event_type"))


@query(
    f"WITH {_points('event_type')} SELECT entity, t, value FROM (SELECT *, lag(value) OVER w AS last, row_number() OVER w AS n FROM pts WINDOW w AS (PARTITION BY entity ORDER BY t)) WHERE n = 1 OR value IS DISTINCT FROM last"
)
def drop_redundant(spark, sf_dir):
    return T.drop_redundant(points(spark, sf_dir, "event_type"))


@query(f"WITH {_points()} SELECT entity, max(t) AS t, arg_max(value, t) AS value FROM pts GROUP BY entity")
def latest_value(spark, sf_dir):
    return T.latest(points(spark, sf_dir))


@query(f"WITH {_clipped()} SELECT entity, st // 86400 AS g, count(*) AS n, max(value) AS most, sum(et - st + 1)::BIGINT AS ticks FROM cl GROUP BY ALL")
def aggregate_grouped(spark, sf_dir):
    day = F.floor(F.col("st") / 86_400)
    return T.aggregate_grouped(history_of(spark, sf_dir), T0, T1, day, F.count("*").alias("n"), F.max("value").alias("most"), F.sum(T.length()).alias("ticks"))


@query(f"WITH {_clipped()}, f AS (SELECT entity, min(st) AS last FROM cl WHERE value > 100 GROUP BY entity) SELECT cl.entity, st, et, value FROM cl LEFT JOIN f ON cl.entity = f.entity WHERE last IS NULL OR st <= last")
def range_until(spark, sf_dir):
    return T.range_until(T.drop_invalid(history_of(spark, sf_dir)), T0, T1, F.col("value") > 100)


@query(f"WITH {_clipped()} SELECT entity, max(value) AS max_value FROM cl GROUP BY entity")
def gatp_max(spark, sf_dir):
    return T.maximum(history_of(spark, sf_dir), T0, T1)


@query(f"WITH {_clipped()} SELECT entity, min(value) AS min_value FROM cl GROUP BY entity")
def gatp_min(spark, sf_dir):
    return T.minimum(history_of(spark, sf_dir), T0, T1)


@query(f"WITH {_clipped()} SELECT entity, min(value) AS min_value, max(value) AS max_value FROM cl GROUP BY entity")
def gatp_extremes(spark, sf_dir):
    return T.extremes(history_of(spark, sf_dir), T0, T1)


@query(f"WITH {_clipped('event_type')} SELECT entity, value, sum(et - st + 1)::BIGINT AS duration FROM cl GROUP BY ALL")
def gatp_duration(spark, sf_dir):
    return T.duration_by_value(history_of(spark, sf_dir, "event_type"), T0, T1)


_BUCKET = "CASE WHEN value >= 120 THEN 120.0::DOUBLE WHEN value >= 50 THEN 50.0::DOUBLE WHEN value >= 10 THEN 10.0::DOUBLE END"


@query(f"WITH {_clipped()} SELECT entity, {_BUCKET} AS bucket, sum(et - st + 1)::BIGINT AS duration FROM cl WHERE value >= 10 GROUP BY ALL")
def gatp_duration_bucketed(spark, sf_dir):
    return T.duration_by_bucket(history_of(spark, sf_dir), T0, T1, STARTS)


@query(f"WITH {_clipped()} SELECT DISTINCT entity FROM cl WHERE value BETWEEN 100 AND 110")
def temporal_condition(spark, sf_dir):
    return T.within_exists(history_of(spark, sf_dir), T0, T1, 100, 110)


@query(
    f"WITH {_intervals('event_type')} SELECT entity, sum(CASE WHEN value IS DISTINCT FROM last THEN 1 ELSE 0 END)::BIGINT AS changes FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY st) AS last FROM iv) GROUP BY entity"
)
def change_count(spark, sf_dir):
    return T.change_count(history_of(spark, sf_dir, "event_type"))


@query(f"WITH {_clipped()} SELECT entity, t, value FROM cl, (SELECT unnest(generate_series({T0}, {T1}, {STEP})) AS t) WHERE t BETWEEN st AND et")
def sample_and_hold(spark, sf_dir):
    return T.sample_and_hold(history_of(spark, sf_dir), T0, T1, STEP)


@query(
    f"WITH {_clipped()}, w AS (SELECT * FROM cl WHERE value >= 20), m AS (SELECT *, lag(et) OVER (PARTITION BY entity ORDER BY st) AS prior, lead(st) OVER (PARTITION BY entity ORDER BY st) AS nxt FROM w), "
    f"g AS (SELECT entity, coalesce(prior + 1, {T0})::BIGINT AS st, (st - 1)::BIGINT AS et FROM m UNION ALL SELECT entity, (et + 1)::BIGINT, {T1}::BIGINT FROM m WHERE nxt IS NULL "
    f"UNION ALL SELECT DISTINCT entity, {T0}::BIGINT, {T1}::BIGINT FROM cl_iv WHERE value >= 20 AND entity NOT IN (SELECT entity FROM w)) "
    f"SELECT entity, st, et FROM g WHERE st <= et"
)
def gaps(spark, sf_dir):
    found = T.history_with_gaps(history_of(spark, sf_dir).where("value >= 20"), T0, T1)
    return found.where("value IS NULL").select("entity", "st", "et")


@query(f"WITH {_intervals()} SELECT count(*) FILTER (st < {AT} AND {AT} <= et) AS spanning, count(*) FILTER (et < {AT}) AS before, count(*) FILTER (st >= {AT}) AS after, count(*) FILTER ({T0} <= st AND et <= {T1}) AS inside FROM iv")
def interval_algebra(spark, sf_dir):
    iv, st, et = history_of(spark, sf_dir), F.col("st"), F.col("et")
    tests = {"spanning": T.spans(st, et, AT), "before": T.before(et, AT), "after": T.from_on(st, AT), "inside": T.contains(F.lit(T0), F.lit(T1), st, et)}
    return iv.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in tests.items()))


# --- joins of intervals, writes, rollups -------------------------------------------------------------------------------


@query(
    f"WITH {_clipped('value', 'a')}, {_clipped('event_type', 'b')} SELECT a.entity, greatest(a.st, b.st)::BIGINT AS st, least(a.et, b.et)::BIGINT AS et, a.value, b.value AS value_r FROM a JOIN b ON a.entity = b.entity AND a.st <= b.et AND b.st <= a.et"
)
def overlap_join(spark, sf_dir):
    pairs = I.overlap_join(history_of(spark, sf_dir), history_of(spark, sf_dir, "event_type"), ["entity"], 86_400, T0, T1)
    return pairs.select("entity", "st", "et", "value", "value_r")


@query(
    f"WITH {_clipped('value', 'a')}, {_clipped('event_type', 'b')} SELECT a.entity, greatest(a.st, b.st)::BIGINT AS st, least(a.et, b.et)::BIGINT AS et FROM a JOIN b ON a.entity = b.entity AND a.st <= b.et AND b.st <= a.et WHERE a.value BETWEEN 30 AND 90 AND b.value BETWEEN 'click' AND 'error'"
)
def region_query(spark, sf_dir):
    return I.region([(history_of(spark, sf_dir), 30, 90), (history_of(spark, sf_dir, "event_type"), "click", "error")], T0, T1, 86_400)


#: Writes of the overwrite query: seq, first, last, value; each for every entity, moved on by 1000 seconds an entity.
WRITES = ((1, T0, T0 + 50_000, 1.0), (2, T0 + 20_000, T0 + 30_000, None), (3, T0 + 25_000, T0 + 600_000, 3.0), (4, T1, NOW, 4.0))


def writes(spark, sf_dir):
    users = points(spark, sf_dir).select("entity").distinct()
    table = spark.createDataFrame(WRITES, "seq long, st long, et long, value double")
    move = F.col("entity") * 1000
    moved = users.join(F.broadcast(table), how="cross")
    return moved.withColumns({"st": F.col("st") + move, "et": F.when(F.col("et") == NOW, NOW).otherwise(F.col("et") + move)})


_WRITES_SQL = "w(seq, st0, et0, value) AS (VALUES " + ", ".join(f"({s}::BIGINT, {a}::BIGINT, {b}::BIGINT, {'NULL' if v is None else v}::DOUBLE)" for s, a, b, v in WRITES) + ")"


@query(
    f"WITH {_intervals()}, {_WRITES_SQL}, users AS (SELECT DISTINCT entity FROM iv), "
    f"every_ AS (SELECT entity, -1 AS seq, st, et, value FROM iv UNION ALL SELECT entity, seq, st0 + entity * 1000, CASE WHEN et0 = {NOW} THEN et0 ELSE et0 + entity * 1000 END, value FROM users, w), "
    f"cuts AS (SELECT entity, st AS a FROM every_ UNION SELECT entity, et + 1 FROM every_ WHERE et < {NOW}), "
    f"parts AS (SELECT entity, a, coalesce(lead(a) OVER (PARTITION BY entity ORDER BY a) - 1, {NOW}) AS b FROM cuts), "
    f"iv2 AS (SELECT entity, a AS st, b AS et, value FROM (SELECT p.entity, a, b, e.value, row_number() OVER (PARTITION BY p.entity, a ORDER BY seq DESC) AS n FROM parts p JOIN every_ e ON p.entity = e.entity AND e.st <= a AND b <= e.et) WHERE n = 1), "
    + _RUNS.format("iv2")
)
def overwrite(spark, sf_dir):
    return T.coalesce_equal(I.overwrite(history_of(spark, sf_dir), writes(spark, sf_dir)))


@query(
    f"WITH {_intervals()} SELECT entity, st, CASE WHEN entity IN (1, 2) THEN least(et, {AT} - 1) ELSE et END AS et, value FROM iv WHERE st < {AT} OR entity NOT IN (1, 2) UNION ALL SELECT entity, {AT}::BIGINT, {NOW}::BIGINT, 7.0 FROM (VALUES (1::BIGINT), (2::BIGINT)) t(entity)"
)
def append_open(spark, sf_dir):
    more = spark.createDataFrame([(1, AT, 7.0), (2, AT, 7.0)], "entity long, t long, value double")
    return I.append_open(history_of(spark, sf_dir), more)


_GROUPS = f"g AS (SELECT row_number() OVER (ORDER BY s) - 1 AS g, s AS g_start, lead(s) OVER (ORDER BY s) - 1 AS g_end FROM (SELECT unnest(generate_series((ceil({T0} / 3600.0) * 3600)::BIGINT, {T1}, {EVERY_HOURS * 3600})) AS s))"


@query(f"WITH {_GROUPS} SELECT g, g_start, g_end FROM g WHERE g_end IS NOT NULL")
def time_groups(spark, sf_dir):
    return I.time_groups(spark, T0, T1, EVERY_HOURS, "hour")


_SPLIT = f"{_intervals()}, {_GROUPS}, s AS (SELECT entity, g, value, greatest(st, g_start) AS st, least(et, g_end) AS et FROM iv JOIN g ON st <= g_end AND g_start <= et WHERE g_end IS NOT NULL)"


@query(f"WITH {_SPLIT} SELECT entity, g, {_BUCKET} AS bucket, sum(et - st + 1)::BIGINT AS duration FROM s WHERE value >= 10 GROUP BY ALL")
def duration_rollup(spark, sf_dir):
    return I.duration_rollup(history_of(spark, sf_dir), I.time_groups(spark, T0, T1, EVERY_HOURS, "hour"), STARTS)


@query(f"WITH {_SPLIT} SELECT entity, g, min(value) AS min_value, max(value) AS max_value FROM s GROUP BY ALL")
def extremes_rollup(spark, sf_dir):
    return I.extremes_rollup(history_of(spark, sf_dir), I.time_groups(spark, T0, T1, EVERY_HOURS, "hour"))


@query(f"WITH {_clipped(t0=T0 + 10_000, t1=T1 - 9_000)} SELECT entity, max(value) AS max_value FROM cl GROUP BY entity")
def max_from_rollup(spark, sf_dir):
    iv, groups = history_of(spark, sf_dir), I.time_groups(spark, T0, T1, EVERY_HOURS, "hour")
    return I.maximum_from_rollup(iv, I.extremes_rollup(iv, groups), groups, T0 + 10_000, T1 - 9_000)


@query(f"WITH {_clipped(t0=T0 + 10_000, t1=T1 - 9_000)} SELECT entity, {_BUCKET} AS bucket, sum(et - st + 1)::BIGINT AS duration FROM cl WHERE value >= 10 GROUP BY ALL")
def duration_from_rollup(spark, sf_dir):
    iv, groups = history_of(spark, sf_dir), I.time_groups(spark, T0, T1, EVERY_HOURS, "hour")
    return I.duration_from_rollup(iv, I.duration_rollup(iv, groups, STARTS), groups, T0 + 10_000, T1 - 9_000, STARTS)


# --- earliest arrival: the reach of customers over relationships with changing travel times -----------------------------


def travel_times(spark, sf_dir):
    """Travel time over a relationship: slow by day, fast by night, by its id."""
    rels = from_tables(spark, sf_dir).rels.where("type IN ('CUSTOMER_IN', 'IN_REGION', 'PLACED')")
    parts = F.array(F.struct(F.lit(0).alias("st"), F.lit(499).alias("et"), (500 + F.col("id") % 100).alias("value")), F.struct(F.lit(500).alias("st"), F.lit(NOW).alias("et"), (10 + F.col("id") % 7).alias("value")))
    return rels.select(F.col("id").alias("entity"), F.explode(parts).alias("p")).select("entity", F.col("p.st").cast("long").alias("st"), F.col("p.et").cast("long").alias("et"), F.col("p.value").alias("value"))


_TRAVEL = f"tt AS (SELECT id AS entity, 0::BIGINT AS st, 499::BIGINT AS et, 500 + id % 100 AS value FROM rels WHERE type IN ('CUSTOMER_IN', 'IN_REGION', 'PLACED') UNION ALL SELECT id, 500, {NOW}, 10 + id % 7 FROM rels WHERE type IN ('CUSTOMER_IN', 'IN_REGION', 'PLACED'))"


@query(f"WITH {RELS_SQL}, {_TRAVEL} SELECT entity, min(greatest(st, 300) + value)::BIGINT AS arrival FROM tt WHERE st <= 2000 AND et >= 300 GROUP BY entity")
def earliest_arrival_on(spark, sf_dir):
    return traversal.earliest_arrival_on(travel_times(spark, sf_dir), 300, 2000)


@query(
    f"WITH {RELS_SQL}, {_TRAVEL}, {STARTS_SQL}, hop1 AS (SELECT r.dst AS node, min(greatest(st, 300) + value) AS arrival FROM starts JOIN rels r ON r.src = starts.id JOIN tt ON tt.entity = r.id WHERE et >= 300 AND greatest(st, 300) <= 2000 GROUP BY 1), "
    "hop2 AS (SELECT r.dst AS node, min(greatest(st, h.arrival) + value) AS arrival FROM hop1 h JOIN rels r ON r.src = h.node JOIN tt ON tt.entity = r.id WHERE et >= h.arrival AND greatest(st, h.arrival) <= 2000 GROUP BY 1) "
    "SELECT node, min(arrival)::BIGINT AS arrival FROM (SELECT id AS node, 300 AS arrival FROM starts UNION ALL SELECT * FROM hop1 UNION ALL SELECT * FROM hop2) GROUP BY node"
)
def reachable_earliest(spark, sf_dir):
    starts = customers(spark, sf_dir).select(F.col("id").alias("node"), F.lit(300).alias("t"))
    rels = from_tables(spark, sf_dir).rels.where("type IN ('CUSTOMER_IN', 'IN_REGION', 'PLACED')")
    return traversal.earliest_arrival(starts, rels, travel_times(spark, sf_dir), 2000)


# --- scans -------------------------------------------------------------------------------------------------------------


@query(G + "SELECT label, count(*) AS n, sum(id)::BIGINT AS ids FROM nodes GROUP BY label")
def all_nodes(spark, sf_dir):
    return S.all_nodes(from_tables(spark, sf_dir)).groupBy(F.get("labels", F.lit(0)).alias("label")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(G + "SELECT id, name, amount FROM nodes WHERE label = 'Supplier'")
def nodes_by_label(spark, sf_dir):
    return S.nodes_by_label(from_tables(spark, sf_dir), "Supplier").select("id", "name", "amount")


@query(G + "SELECT id, name FROM nodes WHERE id IN (1, 9, 10, 11, 12, 13)")
def nodes_by_id(spark, sf_dir):
    return S.nodes_by_id(from_tables(spark, sf_dir), [1, 9, 10, 11, 12, 13]).select("id", "name")


@query(G + "SELECT id, name, amount FROM nodes WHERE label = 'Part' AND name = 'Brand#2' AND amount BETWEEN 900 AND 1000")
def node_index_seek(spark, sf_dir):
    return S.seek_range(S.seek(S.nodes_by_label(from_tables(spark, sf_dir), "Part"), name="Brand#2"), "amount", 900, 1000).select("id", "name", "amount")


@query(G + "SELECT id FROM nodes WHERE id = 42 OR amount IS NOT NULL AND name LIKE 'Brand#1%' AND name LIKE '%1' AND name LIKE '%and%'")
def node_text_seeks(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    texts = S.seek_containing(S.seek_suffix(S.seek_prefix(S.having(g.nodes, "amount"), "name", "Brand#1"), "name", "1"), "name", "and")
    return P.union(texts.select("id"), S.seek_unique(g.nodes, id=42).select("id"))


@query(G + "SELECT a.name AS a, b.name AS b FROM nodes a, nodes b WHERE a.id = 1 AND b.id = 0")
def multi_node_seek(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return S.multi_seek(S.seek_unique(g.nodes, id=1), S.seek_unique(g.nodes, id=0), ("x", "y")).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))


@query(G + "SELECT type, count(*) AS n, sum(src)::BIGINT AS s, sum(dst)::BIGINT AS d FROM (SELECT type, src, dst FROM rels WHERE type IN ('PLACED', 'IN_REGION') UNION ALL SELECT type, dst, src FROM rels WHERE type IN ('PLACED', 'IN_REGION') AND src <> dst) GROUP BY type")
def undirected_rels(spark, sf_dir):
    return S.undirected_rels_of_type(from_tables(spark, sf_dir), "PLACED", "IN_REGION").groupBy("type").agg(F.count("*").alias("n"), F.sum("src").alias("s"), F.sum("dst").alias("d"))


@query(G + "SELECT id, type, src, dst FROM rels WHERE id IN (0, 8, 9, 11, 3)")
def rels_by_id(spark, sf_dir):
    return S.rels_by_id(from_tables(spark, sf_dir), [0, 8, 9, 11, 3]).select("id", "type", "src", "dst")


@query(G + "SELECT (SELECT count(*) FROM nodes WHERE label = 'Order') AS orders, (SELECT count(*) FROM rels r JOIN nodes a ON a.id = r.src JOIN nodes b ON b.id = r.dst WHERE type IN ('PLACED', 'CONTAINS') AND a.label = 'Customer' AND b.label = 'Order') AS placed")
def counts(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    n = S.node_count(g, "Order").withColumnRenamed("n", "orders")
    return n.join(S.rel_count(g, ("PLACED", "CONTAINS"), "Customer", "Order").withColumnRenamed("n", "placed"), how="cross")


# --- expansion and paths -----------------------------------------------------------------------------------------------


@query(G + "SELECT n.id AS c, r.id AS r, r.dst AS o, r.weight FROM nodes n JOIN rels r ON r.src = n.id AND r.type = 'PLACED' WHERE n.label = 'Customer' AND n.name = 'BUILDING'")
def expand(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    rows = S.seek(S.nodes_by_label(g, "Customer"), name="BUILDING").select(F.col("id").alias("c"))
    return E.expand(rows, S.rels_of_type(g, "PLACED"), "c", "r", "o", keep=("weight",))


@query(G + "SELECT n.id AS c, r.id AS r, r.dst AS o FROM nodes n LEFT JOIN rels r ON r.src = n.id AND r.type = 'PLACED' AND r.weight > 300000 WHERE n.label = 'Customer'")
def optional_expand(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    rows = S.nodes_by_label(g, "Customer").select(F.col("id").alias("c"))
    return E.optional_expand(rows, S.rels_of_type(g, "PLACED").where("weight > 300000"), "c", "r", "o")


@query(G + "SELECT n.src AS a, n.dst AS b, r.id AS r FROM rels n JOIN rels r ON r.src = n.src AND r.dst = n.dst WHERE n.type = 'CUSTOMER_IN' AND r.type = 'CUSTOMER_IN'")
def expand_into(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    pairs = S.rels_of_type(g, "CUSTOMER_IN").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return E.expand_into(pairs, S.rels_of_type(g, "CUSTOMER_IN"), "a", "b", "r").select("a", "b", "r")


@query(G + "SELECT id AS r, src AS a, dst AS b FROM rels WHERE type = 'IN_REGION' UNION ALL SELECT id, dst, src FROM rels WHERE type = 'IN_REGION' AND src <> dst")
def project_endpoints(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return E.project_endpoints(g.rels.select(F.col("id").alias("r")), g.rels, "r", "a", "b", directed=False, types=("IN_REGION",))


_VAR = f"{NODES_SQL}, {RELS_SQL}, {STARTS_SQL}, walk(start, here, depth, nodes, rels) AS (SELECT id, id, 0, [id], []::BIGINT[] FROM starts UNION ALL SELECT start, r.dst, depth + 1, list_append(nodes, r.dst), list_append(w.rels, r.id) FROM walk w JOIN rels r ON r.src = w.here WHERE depth < 3 AND NOT list_contains(w.rels, r.id))"


@query(f"WITH RECURSIVE {_VAR} SELECT start, here AS \"end\", len(rels)::INTEGER AS hops, array_to_string(nodes, ',') AS nodes FROM walk WHERE depth BETWEEN 1 AND 3")
def var_expand(spark, sf_dir):
    found = E.var_expand(customers(spark, sf_dir).select(F.col("id").alias("start")), from_tables(spark, sf_dir).rels, "start", "end", 1, 3)
    return found.select("start", "end", E.path_length(F.col("path")).alias("hops"), F.array_join("path.nodes", ",").alias("nodes"))


@query(f"WITH RECURSIVE {_VAR} SELECT DISTINCT start, here AS \"end\" FROM walk WHERE depth BETWEEN 1 AND 3")
def reachable(spark, sf_dir):
    return E.reachable(customers(spark, sf_dir), from_tables(spark, sf_dir).rels, 3)


@query(f"WITH RECURSIVE {_VAR} SELECT start, here AS \"end\", min(depth)::INTEGER AS hops FROM walk GROUP BY start, here")
def shortest_lengths(spark, sf_dir):
    return E.shortest_lengths(customers(spark, sf_dir), from_tables(spark, sf_dir).rels, 3)


def _far_pairs(spark, sf_dir):
    starts = customers(spark, sf_dir).select(F.col("id").alias("start"))
    ends = S.nodes_by_label(from_tables(spark, sf_dir), "Region").select(F.col("id").alias("end"))
    return starts.join(F.broadcast(ends), how="cross")  # by the regions of the world, a handful


_SHORT = f"SELECT start, \"end\", array_to_string(nodes, ',') AS nodes, rels FROM (SELECT start, here AS \"end\", nodes, array_to_string(rels, ',') AS rels, depth, min(depth) OVER (PARTITION BY start, here) AS least FROM walk WHERE here % 8 = 0) WHERE depth = least"


@query(f"WITH RECURSIVE {_VAR} SELECT start, \"end\", min(nodes) AS nodes FROM ({_SHORT}) GROUP BY ALL")
def shortest_path(spark, sf_dir):
    found = E.shortest_paths(_far_pairs(spark, sf_dir), from_tables(spark, sf_dir).rels, 3)
    return found.select("start", "end", F.array_join("path.nodes", ",").alias("nodes"))


@query(f"WITH RECURSIVE {_VAR} {_SHORT}")
def all_shortest_paths(spark, sf_dir):
    found = E.shortest_paths(_far_pairs(spark, sf_dir), from_tables(spark, sf_dir).rels, 3, every=True)
    return found.select("start", "end", F.array_join("path.nodes", ",").alias("nodes"), F.array_join("path.rels", ",").alias("rels"))


@query(G + "SELECT DISTINCT a.src AS a, b.dst AS c FROM rels a JOIN rels b ON a.dst = b.src WHERE a.type = 'PLACED' AND b.type = 'CONTAINS' AND NOT EXISTS (SELECT 1 FROM rels x WHERE x.src = a.src AND x.dst = b.dst)")
def triadic_selection(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    two = E.expand(E.expand(S.nodes_by_label(g, "Customer").select(F.col("id").alias("a")), S.rels_of_type(g, "PLACED"), "a", "r1", "b"), S.rels_of_type(g, "CONTAINS"), "b", "r2", "c")
    return E.triads(two.select("a", "c"), g.rels, "a", "c", closed=False).distinct()


@query(G + "SELECT n.id, count(r.id) AS degree FROM nodes n LEFT JOIN rels r ON r.dst = n.id WHERE n.label IN ('Part', 'Nation', 'Region') GROUP BY n.id")
def degrees(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    return E.degrees(g.nodes.where(V.has_any_label(F.col("labels"), "Part", "Nation", "Region")), g.rels, "in")


@query(f"WITH RECURSIVE {_VAR} SELECT start, here AS \"end\", depth, array_to_string(nodes, ',') AS nodes FROM walk WHERE depth = 2")
def traverse_path_unique(spark, sf_dir):
    found = traversal.traverse(customers(spark, sf_dir), from_tables(spark, sf_dir).rels, 2, traversal.at_depth(2), "rel_path")
    return found.select("start", "end", "depth", F.array_join("nodes", ",").alias("nodes"))


@query(f"WITH RECURSIVE {_VAR} SELECT start, here AS \"end\", min(depth) AS depth FROM walk GROUP BY start, here")
def traverse_global(spark, sf_dir):
    return traversal.traverse(customers(spark, sf_dir), from_tables(spark, sf_dir).rels, 3).select("start", "end", "depth")


@query(f"WITH RECURSIVE {_VAR}, c AS (SELECT w.start, w.here, list_sum(list_transform(w.rels, lambda x: 1.0 + x % 5)) AS cost FROM walk w) SELECT start, here AS \"end\", min(coalesce(cost, 0.0)) AS cost FROM c GROUP BY start, here")
def cheapest(spark, sf_dir):
    rels = from_tables(spark, sf_dir).rels.where("type <> 'SUPPLIER_IN'")
    return traversal.cheapest(customers(spark, sf_dir), rels, 1.0 + F.col("id") % 5)


ORACLE_SQL["cheapest"] = ORACLE_SQL["cheapest"].replace("ON r.src = w.here", "ON r.src = w.here AND r.type <> 'SUPPLIER_IN'").replace("depth < 3", "depth < 4")


@query(f"WITH RECURSIVE {_VAR} SELECT start, here AS \"end\", array_to_string(rels, ',') AS rels FROM walk WHERE depth >= 1 AND here % 8 = 0 AND len(list_distinct(nodes)) = len(nodes)")
def all_simple_paths(spark, sf_dir):
    found = traversal.all_simple_paths(_far_pairs(spark, sf_dir), from_tables(spark, sf_dir).rels, 3)
    return found.select("start", "end", F.array_join("path.rels", ",").alias("rels"))


# --- correlated operators ----------------------------------------------------------------------------------------------


def _customers(spark, sf_dir):
    return S.nodes_by_label(from_tables(spark, sf_dir), "Customer").select(F.col("id").alias("c"), F.col("amount"))


def _large(spark, sf_dir):
    return S.rels_of_type(from_tables(spark, sf_dir), "PLACED").where("weight > 200000").select(F.col("src").alias("c"), F.col("dst").alias("o"))


_CUST = G + ", cs AS (SELECT id AS c, amount FROM nodes WHERE label = 'Customer'), lg AS (SELECT src AS c, dst AS o FROM rels WHERE type = 'PLACED' AND weight > 200000) "


@query(_CUST + "SELECT c, amount FROM cs WHERE c IN (SELECT c FROM lg)")
def semi_apply(spark, sf_dir):
    return apply.semi_apply(_customers(spark, sf_dir), _large(spark, sf_dir), ["c"])


@query(_CUST + "SELECT c, amount FROM cs WHERE c NOT IN (SELECT c FROM lg)")
def anti_semi_apply(spark, sf_dir):
    return apply.anti_semi_apply(_customers(spark, sf_dir), _large(spark, sf_dir), ["c"])


@query(_CUST + "SELECT c, c IN (SELECT c FROM lg) AS large FROM cs")
def let_semi_apply(spark, sf_dir):
    return apply.let_semi_apply(_customers(spark, sf_dir), _large(spark, sf_dir), ["c"], "large").select("c", "large")


@query(_CUST + "SELECT c, amount FROM cs WHERE amount < 0 OR c NOT IN (SELECT c FROM lg)")
def select_or_anti_semi_apply(spark, sf_dir):
    return apply.select_or_semi_apply(_customers(spark, sf_dir), _large(spark, sf_dir), ["c"], F.col("amount") < 0, negate=True)


@query(_CUST + "SELECT c, CASE WHEN nullif(amount, 0) > 5000 OR c IN (SELECT c FROM lg) THEN true WHEN amount IS NULL THEN NULL ELSE false END AS flag FROM cs")
def let_select_or_semi_apply(spark, sf_dir):
    return apply.let_select_or_semi_apply(_customers(spark, sf_dir), _large(spark, sf_dir), ["c"], F.col("amount") > 5000, "flag").select("c", "flag")


@query(_CUST + "SELECT cs.c, coalesce((SELECT string_agg(o::VARCHAR, ',' ORDER BY o) FROM lg WHERE lg.c = cs.c), '') AS orders FROM cs")
def roll_up_apply(spark, sf_dir):
    found = apply.roll_up_apply(_customers(spark, sf_dir), _large(spark, sf_dir), ["c"], "o", "orders")
    return found.select("c", F.array_join("orders", ",").alias("orders"))


@query(_CUST + "SELECT cs.c, cs.amount, lg.o FROM cs LEFT JOIN lg ON lg.c = cs.c")
def left_outer_join(spark, sf_dir):
    return apply.node_join(_customers(spark, sf_dir), _large(spark, sf_dir), ["c"], "left")


@query(_CUST + "SELECT cs.c, lg.o FROM cs JOIN lg ON cs.c = lg.c WHERE amount > 0 UNION ALL SELECT c, NULL FROM cs WHERE NOT (amount > 0)")
def conditional_apply(spark, sf_dir):
    rows = _customers(spark, sf_dir).select("c", F.when(F.col("amount") > 0, 1).alias("mark"))
    return apply.conditional_apply(rows, ["mark"], lambda df: apply.node_join(df, _large(spark, sf_dir), ["c"])).select("c", "o")


@query(G + "SELECT a.id AS x, b.id AS y FROM nodes a JOIN nodes b ON a.amount = b.amount WHERE a.label = 'Customer' AND b.label = 'Supplier'")
def value_join(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    a, b = (S.nodes_by_label(g, n).select(F.col("id").alias(x), F.col("amount").alias(f"a{x}")) for n, x in (("Customer", "x"), ("Supplier", "y")))
    return apply.value_join(a, b, F.col("ax") == F.col("ay")).select("x", "y")


@query("SELECT NULL::BIGINT AS c, NULL::DOUBLE AS amount, true AS was_empty")
def optional_and_anti(spark, sf_dir):
    none = P.nothing(_customers(spark, sf_dir))
    return apply.optional(none).join(apply.anti(none).withColumnRenamed("empty", "was_empty"), how="cross")


@query("SELECT o_orderkey AS o, x AS item FROM orders, unnest(CASE WHEN o_custkey % 5 = 0 THEN [] ELSE [o_custkey, o_custkey + 1] END) u(x)")
def unwind(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = F.when(F.col("o_custkey") % 5 != 0, F.array("o_custkey", F.col("o_custkey") + 1))
    return apply.unwind(orders.select(F.col("o_orderkey").alias("o"), items.alias("items")), F.col("items"), "item").select("o", "item")


# --- aggregation, order, set operations --------------------------------------------------------------------------------


@query(
    "SELECT l_returnflag AS flag, count(*) AS n, count(CASE WHEN l_discount > 0.05 THEN l_discount END) AS some, coalesce(sum(l_quantity), 0) AS total, round(avg(l_quantity), 6) AS mean, min(l_shipdate)::DATE AS first, max(l_quantity) AS most, "
    "round(coalesce(stddev_samp(l_quantity), 0), 6) AS sd, round(coalesce(stddev_pop(l_quantity), 0), 6) AS sdp, quantile_cont(l_quantity, 0.3) AS pc, quantile_disc(l_quantity, 0.3) AS pd, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_quantity) AS different FROM lineitem GROUP BY l_returnflag"
)
def aggregation(spark, sf_dir):
    q = F.col("l_quantity")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("l_discount") > 0.05, F.col("l_discount"))).alias("some"), A.total(q).alias("total"), F.round(F.avg(q), 6).alias("mean"),
        F.min("l_shipdate").cast("date").alias("first"), F.max(q).alias("most"), F.round(A.deviation(q), 6).alias("sd"), F.round(A.deviation_of_all(q), 6).alias("sdp"),
        A.percentile_cont(q, 0.3).alias("pc"), A.percentile_disc("l_quantity", 0.3).alias("pd"), F.count_distinct("l_suppkey").alias("suppliers"), A.AGGREGATES["sum_distinct"](q).alias("different"),
    )


@query("SELECT 0::BIGINT AS n, 0.0::DOUBLE AS total, NULL::DOUBLE AS mean, 0.0::DOUBLE AS sd, NULL::DOUBLE AS pc, '' AS items")
def aggregation_of_nothing(spark, sf_dir):
    q = F.col("l_quantity")
    return P.nothing(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).agg(
        F.count(q).alias("n"), A.total(q).cast("double").alias("total"), F.avg(q).alias("mean"), A.deviation(q).alias("sd"), A.percentile_cont(q, 0.5).alias("pc"), F.array_join(A.collect(q.cast("string")), ",").alias("items")
    )


@query("SELECT o_custkey AS c, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def collect(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.groupBy(F.col("o_custkey").alias("c")).agg(F.array_join(A.collect(F.col("o_orderkey")), ",").alias("orders"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf_dir):
    return P.distinct(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_linestatus")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top(spark, sf_dir):
    return P.top(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), 25, "-o_totalprice", "o_orderkey")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)")
def first_with_ties(spark, sf_dir):
    return P.first_with_ties(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity"), "-l_quantity")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 10")
def sort_skip_limit(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    return P.limit(P.skip(P.sort(rows, "c_acctbal", "c_custkey"), 10), 20)


@query("SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def union(spark, sf_dir):
    a, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("n")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return P.union(a, b)


@query("SELECT c_nationkey AS n, count(*) AS k FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def union_all(spark, sf_dir):
    a, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("n")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return P.union_all(a, b).groupBy("n").agg(F.count("*").alias("k"))


# --- functions ---------------------------------------------------------------------------------------------------------


@query(
    "SELECT o_orderkey AS k, abs(x) AS a, ceil(x)::DOUBLE AS c, floor(x)::DOUBLE AS f, sign(x)::BIGINT AS s, round(sqrt(abs(x)), 9) AS q, round(ln(abs(x) + 1), 9) AS l, round(log10(abs(x) + 1), 9) AS l10, round(sin(x), 9) AS si, round(atan2(x, 2.0), 9) AS at, "
    "round(degrees(x), 3) AS d, round((1 - cos(x)) / 2, 9) AS h, round(exp(x / 1000000), 9) AS e, CASE WHEN x < 0 THEN -1 ELSE 1 END * floor(abs(x) / 100 + 0.5) * 100 AS r FROM (SELECT o_orderkey, o_totalprice - 200000 AS x FROM orders)"
)
def math_functions(spark, sf_dir):
    x = F.col("o_totalprice") - 200000
    f = scalars.call
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("k"), f("abs", x).alias("a"), f("ceil", x).alias("c"), f("floor", x).alias("f"), f("sign", x).alias("s"), F.round(f("sqrt", F.abs(x)), 9).alias("q"), F.round(f("log", F.abs(x) + 1), 9).alias("l"),
        F.round(f("log10", F.abs(x) + 1), 9).alias("l10"), F.round(f("sin", x), 9).alias("si"), F.round(f("atan2", x, F.lit(2.0)), 9).alias("at"), F.round(f("degrees", x), 3).alias("d"), F.round(f("haversin", x), 9).alias("h"),
        F.round(f("exp", x / 1000000), 9).alias("e"), (f("round", x / 100) * 100).alias("r"),
    )


@query(
    "SELECT c_custkey AS k, left(c_name, 4) AS l, right(c_name, 3) AS r, substr(c_name, 3, 4) AS s, replace(c_name, '#', '-') AS p, split_part(c_name, '#', 2) AS sp, lower(c_mktsegment) AS lo, upper(c_name) AS u, reverse(c_name) AS re, length(c_name)::INTEGER AS n, "
    "try_cast(substr(c_name, 10) AS BIGINT) AS i, try_cast(c_mktsegment AS DOUBLE) AS d, CASE WHEN c_custkey % 2 = 0 THEN true END AS b, c_custkey::VARCHAR AS t FROM customer"
)
def text_functions(spark, sf_dir):
    n, f = F.col("c_name"), scalars.call
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("k"), f("left", n, 4).alias("l"), f("right", n, 3).alias("r"), f("substring", n, 2, 4).alias("s"), f("replace", n, F.lit("#"), F.lit("-")).alias("p"), F.get(f("split", n, "#"), F.lit(1)).alias("sp"),
        f("toLower", F.col("c_mktsegment")).alias("lo"), f("toUpper", n).alias("u"), f("reverse", n).alias("re"), f("length3_5", n).alias("n"), f("toInteger", f("substring", n, 9)).alias("i"), f("toFloat", F.col("c_mktsegment")).alias("d"),
        f("toBoolean", F.when(F.col("c_custkey") % 2 == 0, F.lit(" TRUE ")).otherwise("x")).alias("b"), f("toString", F.col("c_custkey")).alias("t"),
    )


@query(
    "SELECT c_custkey AS k, n AS size, l[1] AS head, l[n] AS last, array_to_string(l[2:], ',') AS tail, array_to_string(list_filter(l, lambda x: x % 2 = 0), ',') AS even, list_sum(l)::BIGINT AS total, array_to_string(l[2:3], ',') AS slice, l[n - 1] AS second_last, "
    "list_contains(l, 3) AS has3, len(list_filter(l, lambda x: x > 2)) = 1 AS one FROM (SELECT c_custkey, range(c_custkey % 4, 5) AS l, len(range(c_custkey % 4, 5)) AS n FROM customer)"
)
def list_functions(spark, sf_dir):
    items = scalars.call("range", F.col("c_custkey") % 4, F.lit(4))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), items.alias("l"))
    c = F.col("l")
    return rows.select(
        "k", F.size(c).cast("long").alias("size"), V.head(c).alias("head"), V.last(c).alias("last"), F.array_join(V.tail(c), ",").alias("tail"), F.array_join(V.comprehension(c, lambda x: x % 2 == 0), ",").alias("even"),
        V.reduce_list(c, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_join(V.list_slice(c, 1, 3), ",").alias("slice"), V.item(c, -2).alias("second_last"), V.is_in(F.lit(3), c).alias("has3"), V.single_of(c, lambda x: x > 2).alias("one"),
    )


@query("SELECT * FROM (VALUES (1, NULL::BOOLEAN, false, true, NULL::BOOLEAN, 3::BIGINT, 0::BIGINT), (2, true, true, true, true, -3, 0)) t(k, equal, empty_in, xor1, unknown_in, quotient, n_range) WHERE k = 1")
def null_rules(spark, sf_dir):
    a, b = F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(None).cast("int"), F.lit(3))
    none = F.lit(None).cast("int")
    return spark.range(1).select(
        F.lit(1).alias("k"), V.list_equals(a, b).alias("equal"), V.is_in(none, F.array().cast("array<int>")).alias("empty_in"), V.xor(F.lit(True), F.lit(False)).alias("xor1"), V.is_in(F.lit(2), b).alias("unknown_in"),
        V.divide(F.lit(7), F.lit(2), whole=True).alias("quotient"), F.size(V.number_range(F.lit(5), F.lit(1), 1)).cast("long").alias("n_range"),
    )


@query(
    "SELECT o_orderkey AS k, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, month(o_orderdate)::INTEGER AS m, week(o_orderdate)::INTEGER AS w, isoyear(o_orderdate)::INTEGER AS wy, isodow(o_orderdate)::INTEGER AS dow, dayofyear(o_orderdate)::INTEGER AS doy, "
    "(date_diff('day', date_trunc('quarter', o_orderdate), o_orderdate) + 1)::INTEGER AS doq, (o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY + INTERVAL 90 SECOND)::TIMESTAMP AS later FROM orders"
)
def calendar_functions(spark, sf_dir):
    d = F.col("o_orderdate")
    parts = {"y": "year", "q": "quarter", "m": "month", "w": "week", "wy": "weekYear", "dow": "dayOfWeek", "doy": "ordinalDay", "doq": "dayOfQuarter"}
    later = calendar.plus(d, calendar.duration(months=1, days=3, seconds=90)).cast("timestamp_ntz")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), *(calendar.part(d, f).alias(n) for n, f in parts.items()), later.alias("later"))


@query("SELECT c_custkey AS k, round(sqrt(power(c_acctbal - 100, 2) + power(c_nationkey - 2, 2)), 6) AS d, c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 1 AND 9 AS inside, NULL::DOUBLE AS other FROM customer")
def spatial_functions(spark, sf_dir):
    p, q = spatial.point(F.col("c_acctbal"), F.col("c_nationkey")), spatial.point(F.lit(100), F.lit(2))
    box = spatial.within_box(p, spatial.point(F.lit(0), F.lit(1)), spatial.point(F.lit(5000), F.lit(9)))
    globe = spatial.point(F.lit(1.0), F.lit(2.0), geographic=True)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.round(spatial.distance(p, q), 6).alias("d"), box.alias("inside"), spatial.distance(p, globe).alias("other"))


# --- updates -----------------------------------------------------------------------------------------------------------


@query(G + "SELECT count(*) AS n, sum(id)::BIGINT AS ids, count(*) FILTER (label = 'Nation' OR id = -7) AS nations, round(sum(CASE WHEN label = 'Supplier' AND amount < 0 THEN 0 ELSE amount END), 2) AS amounts FROM (SELECT id, label, amount FROM nodes UNION ALL SELECT -7, 'Nation', 5.0)")
def updates_of_nodes(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    new = spark.createDataFrame([(-7, ["Nation"], "NATION_NEW", 5.0)], "id long, labels array<string>, name string, amount double")
    g = updates.merge_nodes(updates.create_nodes(g, new), new.select("id"), ["id"])
    changed = updates.set_properties(g.nodes, F.array_contains("labels", "Supplier") & (F.col("amount") < 0), amount=F.lit(0.0))
    return changed.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count(F.when(V.has_labels(F.col("labels"), "Nation"), 1)).alias("nations"), F.round(F.sum("amount"), 2).alias("amounts"))


@query(
    G + ", gone AS (SELECT id FROM nodes WHERE label = 'Nation' AND name LIKE '%3') SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (FROM gone)) AS nodes_left, "
    "(SELECT count(*) FROM rels WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)) AS rels_left"
)
def detach_delete(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    left = updates.detach_delete_nodes(g, S.seek_suffix(S.nodes_by_label(g, "Nation"), "name", "3").select("id"))
    return left.nodes.agg(F.count("*").alias("nodes_left")).join(left.rels.agg(F.count("*").alias("rels_left")), how="cross")


# --- full text ---------------------------------------------------------------------------------------------------------


@query(
    "WITH ts AS (SELECT p_partkey AS id, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS l FROM part), st AS (SELECT count(*) AS n, avg(len(l)) AS mean FROM ts), tf AS (SELECT id, t, count(*) AS tf, any_value(len(l)) AS len FROM ts, unnest(l) u(t) WHERE t IN ('small', 'economy') GROUP BY id, t), "
    "df AS (SELECT t, count(*) AS df FROM tf GROUP BY t) SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM tf JOIN df USING (t), st GROUP BY id ORDER BY score DESC, id LIMIT 20"
)
def full_text(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    found = fulltext.search(fulltext.build(parts, "p_partkey", "text"), "Small economy", most=20)
    return found.select("id", F.round("score", 9).alias("score"))
