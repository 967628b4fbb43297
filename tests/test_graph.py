"""Graph operators on small graphs."""

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import scalars, values as V
from chronoweave.model import PropertyGraph
from chronoweave.operators import apply, expand as E, fulltext, scans as S, shaping as P, traversal as R, updates as U
from chronoweave.sources import procedures


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(i, ["N"] if i != 4 else ["N", "Blocked"], f"n{i}") for i in range(1, 7)], "id long, labels array<string>, name string")
    rels = spark.createDataFrame([(1, "T", 1, 2, 1.0), (2, "T", 2, 3, 1.0), (3, "T", 3, 4, 1.0), (4, "T", 1, 3, 5.0), (5, "T", 3, 1, 1.0), (6, "S", 5, 5, 1.0)], "id long, type string, src long, dst long, weight double")
    return PropertyGraph(nodes, rels)


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "start long")


def pairs(df, *c):
    return sorted(tuple(r) for r in df.select(*c).collect())


def test_relationships_occur_once_in_a_path_but_nodes_may_repeat(spark, graph):
    found = E.var_expand(start(spark, 1), graph.rels, "start", "end", 1, 6)
    paths = pairs(found, F.array_join("path.nodes", "-"))
    assert ("1-2-3-1-3-4",) in paths and all(len(set(r["path"]["rels"])) == len(r["path"]["rels"]) for r in found.collect())


def test_nodes_of_a_path_can_be_limited(spark, graph):
    ok = graph.nodes.where(~F.array_contains("labels", "Blocked"))
    found = E.var_expand(start(spark, 2), graph.rels.where("id < 4"), "start", "end", 1, 3, nodes_ok=ok)
    assert pairs(found, "end") == [(3,)]


def test_length_zero_is_the_node_itself(spark, graph):
    assert pairs(E.var_expand(start(spark, 6), graph.rels, "start", "end", 0, 2), "start", "end") == [(6, 6)]


def test_a_self_loop_is_seen_once_in_both_directions(graph):
    assert S.undirected_rels_of_type(graph, "S").count() == 1
    assert S.undirected_rels_of_type(graph, "T").count() == 10


def test_shortest_paths_one_and_all(spark, graph):
    more = graph.rels.unionByName(spark.createDataFrame([(7, "T", 1, 6, 1.0), (8, "T", 6, 4, 1.0)], graph.rels.schema))
    want = spark.createDataFrame([(1, 4), (1, 1), (4, 1)], "start long, end long")
    one = pairs(E.shortest_paths(want, more, 5), "start", "end", F.array_join("path.rels", "-"))
    assert one == [(1, 1, ""), (1, 4, "4-3")]
    every = pairs(E.shortest_paths(want, more, 5, every=True), "start", "end", F.array_join("path.rels", "-"))
    assert every == [(1, 1, ""), (1, 4, "4-3"), (1, 4, "7-8")]


def test_cheapest_goes_round_a_dear_relationship(spark, graph):
    found = R.cheapest(start(spark, 1).withColumnRenamed("start", "id"), graph.rels, F.col("weight"))
    assert pairs(found, "end", "cost") == [(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)]


@pytest.mark.parametrize(("uniqueness", "n"), [("none", 3), ("node_path", 2), ("rel_path", 3), ("node_global", 1), ("node_level", 3), ("rel_global", 3)])
def test_uniqueness(spark, graph, uniqueness, n):
    found = R.traverse(start(spark, 1).withColumnRenamed("start", "id"), graph.rels, 3, R.from_depth(2), uniqueness)
    assert found.where("depth = 2").count() == n
    if uniqueness == "node_global":
        assert pairs(found, "end", "depth") == [(4, 2)]


def test_evaluators_prune(spark, graph):
    found = R.traverse(start(spark, 1).withColumnRenamed("start", "id"), graph.rels, 4, R.ends_where(lambda n: n == 3).and_(R.exclude_start()), "rel_path")
    assert {r["end"] for r in found.collect()} == {3}


def test_earliest_arrival_waits_for_a_faster_time(spark, graph):
    travel = spark.createDataFrame([(1, 0, 9, 100), (1, 10, 99, 5), (2, 0, 99, 7)], "entity long, st long, et long, value long")
    starts = spark.createDataFrame([(1, 3)], "node long, t long")
    assert pairs(R.earliest_arrival(starts, graph.rels, travel, 50), "node", "arrival") == [(1, 3), (2, 15), (3, 22)]
    assert pairs(R.earliest_arrival(starts, graph.rels, travel, 12), "node", "arrival") == [(1, 3), (2, 15)]


def test_triads_and_degrees(spark, graph):
    two = spark.createDataFrame([(1, 3), (1, 4)], "a long, c long")
    assert pairs(E.triads(two, graph.rels, "a", "c", closed=False), "c") == [(4,)]
    assert dict(pairs(E.degrees(graph.nodes, graph.rels), "id", "degree"))[6] == 0


def test_unique_lookups(spark, graph):
    assert S.seek_unique(graph.nodes, id=3).count() == 1 and S.seek_unique(graph.nodes, id=99).count() == 0
    with pytest.raises(Exception, match="unique"):
        S.seek_unique(graph.nodes.unionByName(graph.nodes), id=3).collect()
    assert S.asserting_seek(S.seek(graph.nodes, id=3), S.seek(graph.nodes, name="n3")).count() == 1
    with pytest.raises(Exception, match="different"):
        S.asserting_seek(S.seek(graph.nodes, id=3), S.seek(graph.nodes, name="n4")).collect()


def test_updates(spark, graph):
    with pytest.raises(Exception, match="relationships"):
        U.delete_nodes(graph, spark.createDataFrame([(1,)], "id long")).nodes.collect()
    assert U.delete_nodes(graph, spark.createDataFrame([(6,)], "id long")).nodes.count() == 5
    left = U.detach_delete_nodes(graph, spark.createDataFrame([(3,)], "id long"))
    assert (left.nodes.count(), left.rels.count()) == (5, 2)
    rows = spark.createDataFrame([("n1",), ("n9",)], "name string")
    merged = U.merge_nodes(graph, rows, ["name"], on_create={"id": F.lit(9).cast("long"), "labels": F.array(F.lit("New"))}, on_match={"labels": F.array(F.lit("Old"))})
    assert pairs(merged.nodes.where("name IN ('n1', 'n9')"), "id", F.array_join("labels", ",")) == [(1, "Old"), (9, "New")]
    assert merged.nodes.count() == 7
    labelled = U.remove_labels(U.set_labels(graph.nodes, F.col("id") == 1, "X"), F.col("id") == 4, "Blocked")
    assert pairs(labelled.where("id IN (1, 4)"), F.array_join("labels", ",")) == [("N",), ("N,X",)]
    m = spark.createDataFrame([({"a": "1", "b": "2"},)], "props map<string,string>")
    new = F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("3"))
    assert U.set_from_map(m, F.lit(True), "props", new, False).first()[0] == {"a": "1", "c": "3"}
    assert U.set_from_map(m, F.lit(True), "props", new, True).first()[0] == {"c": "3"}
    path = spark.createDataFrame([(1, ([3, 4], [3])), (2, None)], "k long, path struct<nodes: array<long>, rels: array<long>>")
    assert U.delete_paths(graph, path, detach=True).rels.count() == 2


def test_optional_anti_and_same_node(spark, graph):
    none = graph.nodes.where("id > 99")
    assert apply.optional(none).count() == 1 and apply.optional(graph.nodes).count() == 6
    assert apply.anti(none).count() == 1 and apply.anti(graph.nodes).count() == 0
    a = spark.createDataFrame([(1, 5), (2, 6)], "k long, a long")
    with pytest.raises(Exception, match="different"):
        apply.assert_same_node(a, a.withColumnRenamed("a", "b").withColumn("b", F.lit(5).cast("long")), ["k"], "a", "b").collect()


def test_null_is_the_largest_value(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r.x for r in P.sort(df, "x").collect()] == [1, 3, None]
    assert [r.x for r in P.sort(df, "-x").collect()] == [None, 3, 1]
    assert P.first_with_ties(df.union(df), "-x").count() == 2


def test_values(spark):
    one = spark.range(1)
    num = F.array(*map(F.lit, (10, 20, 30)))
    row = one.select(
        V.item(num, 5).alias("out"), F.array_join(V.list_slice(num, -2), ",").alias("end"), F.array_join(V.number_range(F.lit(5), F.lit(1), -2), ",").alias("down"),
        V.is_in(F.lit(7), F.array(F.lit(1), F.lit(None))).alias("unknown"), scalars.call("round", F.lit(-2.5)).alias("r"), scalars.call("round", F.lit(2.5), 0, "HALF_EVEN").alias("even"),
        scalars.call("toInteger", F.lit("7.9")).alias("i"), scalars.call("toInteger", F.lit("x")).alias("no"), scalars.matches(F.lit("abc"), "a.c").alias("m"),
    ).first()
    assert tuple(row) == (None, "20,30", "5,3,1", None, -3.0, 2.0, 7, None, True)
    with pytest.raises(Exception, match="zero"):
        one.select(V.divide(F.lit(1), F.lit(0), whole=True)).collect()
    scalars.define("twice", lambda c: c * 2)
    assert one.select(scalars.call("TWICE", F.lit(4))).first()[0] == 8
    with pytest.raises(ValueError):
        scalars.call("nosuch")


def test_user_aggregates(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from chronoweave.functions import aggregates as A

    @pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    A.define("spread", spread)
    assert spark.range(5).agg(A.call("Spread", F.col("id").cast("double")).alias("s")).first()["s"] == 4.0
    with pytest.raises(ValueError):
        A.call("nosuch", F.col("id"))


def test_procedures(spark, graph):
    assert pairs(procedures.call(spark, "db.labels", graph), "label") == [("Blocked",), ("N",)]
    assert procedures.call(spark, "dbms.components", yields=("name",)).columns == ["name"]
    assert procedures.call(spark, "dbms.functions").count() > 50


def test_full_text_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "Red fish, blue fish"), (2, "one fish"), (3, None), (4, "")], "id long, text string")
    fulltext.build(df, "id", "text").save(f"{tmp_path}/ix")
    index = fulltext.TextIndex.load(spark, f"{tmp_path}/ix")
    assert [r["id"] for r in fulltext.search(index, "Blue FISH").collect()] == [1, 2]
    assert [r["id"] for r in fulltext.search(index, "blue fish", every=True).collect()] == [1]


def test_paths_between_pairs_leave_out_what_leads_to_no_end(spark, graph):
    fan = spark.range(100, 160).select("id", F.lit("T").alias("type"), F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    kept = E.towards(E.oriented(graph.rels.unionByName(fan)).select("from_id", "rel", "to_id"), spark.createDataFrame([(4,)], "id long"), 3)
    assert pairs(kept, "rel", "left") == [(1, 2), (2, 1), (3, 0), (4, 1), (5, 2)]
    want = spark.createDataFrame([(1, 4), (2, 1)], "start long, end long")
    found = R.all_paths(want, graph.rels.unionByName(fan), 3)
    assert pairs(found, "start", "end", F.array_join("path.rels", "-")) == [(1, 4, "1-2-3"), (1, 4, "4-3"), (2, 1, "2-5")]


def test_shortest_paths_write_no_level_of_nodes_that_lead_nowhere(spark, graph, monkeypatch):
    sizes, settle = [], E.settle
    monkeypatch.setattr(E, "settle", lambda df, name: (out := settle(df, name), sizes.append((name, out.count())))[0])
    fan = spark.range(100, 160).select("id", F.lit("T").alias("type"), F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    want = spark.createDataFrame([(1, 4)], "start long, end long")
    for every in (False, True):
        found = E.shortest_paths(want, graph.rels.unionByName(fan), 3, every=every)
        assert pairs(found, F.array_join("path.rels", "-")) == [("4-3",)]
    assert max(n for name, n in sizes if name == "arrivals") <= 2


def _written(monkeypatch, module):
    """Names and rows of what is written from here on."""
    sizes, settle = [], module.settle
    for m in (E, R):
        monkeypatch.setattr(m, "settle", lambda df, name: (out := settle(df, name), sizes.append((name, out.count())))[0])
    return sizes


def _ladder(spark, graph):
    """Three nodes after each other, the last with 900 leaves, two ways to the third."""
    rows = [(1, 1, 2), (2, 2, 3), (3, 1, 3), (4, 3, 1)] + [(10 + i, 3, 100 + i) for i in range(900)] + [(2000, 2, 100)]
    rels = spark.createDataFrame([(i, "T", a, b, float(i % 7)) for i, a, b in rows], graph.rels.schema)
    least = {1: 0, 2: 1, 3: 1} | {100 + i: 2 for i in range(900)}
    return rels, least


@pytest.mark.parametrize("share", [2_000_000, 50])
def test_reachable_and_lengths_write_no_last_level_and_split_hubs(spark, graph, monkeypatch, share):
    rels, least = _ladder(spark, graph)
    monkeypatch.setattr(E, "SHARE", share)
    sizes = _written(monkeypatch, E)
    one = spark.createDataFrame([(1,)], "id long")
    assert pairs(E.shortest_lengths(one, rels, 2), "end", "hops") == sorted(least.items())
    assert pairs(E.reachable(one, rels, 2), "end") == [(n,) for n in sorted(least)]
    assert max(n for name, n in sizes if name == "level") == 2
    assert pairs(E.shortest_lengths(one, rels, 9), "end", "hops") == sorted(least.items())


@pytest.mark.parametrize("share", [2_000_000, 50])
def test_traversal_writes_no_last_level_and_takes_the_smallest_relationships(spark, graph, monkeypatch, share):
    rels, least = _ladder(spark, graph)
    monkeypatch.setattr(E, "SHARE", share)
    sizes = _written(monkeypatch, R)
    found = R.traverse(spark.createDataFrame([(1,)], "id long"), rels, 2)
    assert pairs(found, "end", "depth") == sorted(least.items())
    paths = {r["end"]: (r["nodes"], r["rels"]) for r in found.collect()}
    assert paths[100] == ([1, 2, 100], [1, 2000]) and paths[101] == ([1, 3, 101], [3, 11])
    assert max(n for name, n in sizes if name == "traversal") == 2


@pytest.mark.parametrize("share", [2_000_000, 50])
def test_cheapest_writes_no_nodes_that_lead_nowhere(spark, graph, monkeypatch, share):
    rels, least = _ladder(spark, graph)
    monkeypatch.setattr(E, "SHARE", share)
    sizes = _written(monkeypatch, R)
    got = dict(pairs(R.cheapest(spark.createDataFrame([(1,)], "id long"), rels, F.col("weight")), "end", "cost"))
    assert got == {1: 0.0, 2: 1.0, 3: 3.0} | {100 + i: 3.0 + (10 + i) % 7 for i in range(900)} | {100: min(3.0 + 10 % 7, 1.0 + 2000 % 7)}
    assert max(n for name, n in sizes if name == "costs") == 3
    assert set(dict(pairs(R.cheapest(spark.createDataFrame([(1,)], "id long"), rels, F.col("weight"), most_cost=3.0), "end", "cost")).values()) <= {0.0, 1.0, 3.0}


def test_triads_are_dealt_into_tasks_of_bounded_size(spark, graph, monkeypatch):
    monkeypatch.setattr(E, "SHARE", 100)
    many = spark.range(3000).select((F.col("id") % 3 + 1).alias("a"), (F.col("id") % 1000).alias("c"))
    found = E.triads(many, graph.rels, "a", "c", closed=False)
    rows = found.rdd.glom().map(len).collect()
    assert len(rows) == 31 and sum(rows) == 2995 and max(rows) < 400
    assert pairs(E.triads(many, graph.rels, "a", "c", closed=True).distinct(), "a", "c") == [(1, 2), (1, 3), (2, 3), (3, 1), (3, 4)]


def test_paths_of_several_lengths_are_walked_once(spark, graph, monkeypatch):
    sizes = _written(monkeypatch, E)
    found = E.var_expand(start(spark, 1, 1), graph.rels, "start", "end", 1, 3)
    assert [n for name, n in sizes if name == "paths"] == [4, 6]
    assert len(pairs(found, "end", F.array_join("path.rels", "-"))) == 16


def _shuffled(spark, df):
    """Bytes that running df shuffles, from the first step that it calls."""
    sc = spark.sparkContext._jsc.sc()

    def so_far():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = so_far()
    df().write.format("noop").mode("overwrite").save()
    return so_far() - before


#: Queries over rels from the ids of starts, each of at most two relationships.
CROWD = {
    "cheapest": lambda starts, rels: R.cheapest(starts, rels, F.col("weight")),
    "traverse_global": lambda starts, rels: R.traverse(starts, rels, 2).select("start", "end", "depth"),
    "shortest_lengths": lambda starts, rels: E.shortest_lengths(starts, rels, 2),
    "reachable": lambda starts, rels: E.reachable(starts, rels, 2),
}


def _crowd(spark, graph):
    """300 starts, all with one relationship to the same node, which has 2,000 leaves."""
    leaf = F.abs(F.xxhash64("id")) + 10_000
    to, on = (spark.range(n).select(F.col("id") + first, F.lit("T"), a, b, (F.col("id") % 7).cast("double")) for n, first, a, b in (
        (300, 0, F.col("id"), F.lit(1000)), (2000, 5000, F.lit(1000), leaf)
    ))
    return spark.range(300), spark.createDataFrame(to.union(on).collect(), graph.rels.schema)


@pytest.mark.parametrize("name", ["cheapest", "traverse_global", "shortest_lengths", "reachable"])
def test_neighbours_are_sent_once_to_all_starts_that_share_them(spark, graph, name):
    starts, rels = _crowd(spark, graph)
    assert _shuffled(spark, lambda: CROWD[name](starts, rels)) < 500_000
    found = CROWD[name](starts, rels)
    assert found.count() == 300 * 2001 + 300 * (name != "reachable") and found.select("start", "end").distinct().count() == found.count()


def test_var_expand_shuffles_relationships_once(spark, graph):
    """Three relationships of a path and 20,000 others; before, each length shuffled all."""
    other = spark.range(20_000).select(F.col("id") + 100, F.lit("T"), F.abs(F.xxhash64("id")), F.abs(F.xxhash64("id", "id")), F.lit(1.0))
    rels = graph.rels.where("id < 4").unionByName(spark.createDataFrame(other.collect(), graph.rels.schema))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if they were many
    try:
        once = _shuffled(spark, lambda: rels.select("id", "src", "dst").repartition("src"))
        assert _shuffled(spark, lambda: E.var_expand(start(spark, 1), rels, "start", "end", 1, 3)) < 2 * once
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
