"""Scans and lookups of nodes and relationships. Predicates reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.model import PropertyGraph


def all_nodes(graph: PropertyGraph) -> DataFrame:
    return graph.nodes


def nodes_by_label(graph: PropertyGraph, *labels: str, ordered: bool = False) -> DataFrame:
    """Nodes with every one of labels, in order of id if wanted."""
    found = graph.nodes
    for label in labels:
        found = found.where(F.array_contains("labels", label))
    return found.orderBy("id") if ordered else found


def nodes_by_id(graph: PropertyGraph, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Nodes by id; a DataFrame of ids (column id) is joined."""
    if isinstance(ids, DataFrame):
        return graph.nodes.join(ids.select("id").distinct(), "id", "left_semi")
    return graph.nodes.where(F.col("id").isin(list(ids)))


def having(df: DataFrame, prop: str) -> DataFrame:
    """Rows with the property present."""
    return df.where(F.col(prop).isNotNull())


def seek(df: DataFrame, **values) -> DataFrame:
    """Rows whose properties equal the values (composite: all of them). Null equals nothing."""
    for prop, v in values.items():
        df = df.where(F.col(prop) == F.lit(v))
    return df


def seek_unique(df: DataFrame, **values) -> DataFrame:
    """As seek, for keys that are unique: a second row is an error when the result is read."""
    found = seek(df, **values)
    n = found.agg(F.count("*").alias("n")).where(F.assert_true(F.col("n") <= 1, F.lit("more than one row for a unique key")).isNull())
    return found.join(F.broadcast(n.select(F.lit(True).alias("_one"))), how="left_semi")


def seek_range(df: DataFrame, prop: str, low=None, high=None, include_low: bool = True, include_high: bool = True) -> DataFrame:
    c = F.col(prop)
    if low is not None:
        df = df.where(c >= low if include_low else c > low)
    if high is not None:
        df = df.where(c <= high if include_high else c < high)
    return df


def seek_prefix(df: DataFrame, prop: str, prefix: str) -> DataFrame:
    return df.where(F.col(prop).startswith(prefix))


def seek_suffix(df: DataFrame, prop: str, suffix: str) -> DataFrame:
    return df.where(F.col(prop).endswith(suffix))


def seek_containing(df: DataFrame, prop: str, part: str) -> DataFrame:
    return df.where(F.col(prop).contains(part))


def seek_any(df: DataFrame, prop: str, values: Iterable) -> DataFrame:
    return df.where(F.col(prop).isin(list(values)))


def multi_seek(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Every pair of two lookups, as structs under the two names. Lookups by unique keys, so each side is a row or few."""
    a, b = (df.select(F.struct(*df.columns).alias(n)) for df, n in zip((first, second), names, strict=True))
    return a.join(b, how="cross")


def asserting_seek(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two lookups that must give the same node: rows of first; an error when read if a row is in one only."""
    a = first.withColumn("_a", F.lit(True))
    both = a.join(second.select("id", F.lit(True).alias("_b")), "id", "full_outer")
    same = F.assert_true(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit("the lookups give different nodes"))
    return both.where(same.isNull()).drop("_a", "_b")


def rels_of_type(graph: PropertyGraph, *types: str) -> DataFrame:
    """Relationships of one of the types (all if none is given)."""
    return graph.rels.where(F.col("type").isin(list(types))) if types else graph.rels


def both_ways(rels: DataFrame) -> DataFrame:
    """Each relationship in both orientations, a self-loop once; `forward` tells them apart."""
    back = rels.where(F.col("src") != F.col("dst")).withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return rels.withColumn("forward", F.lit(True)).unionByName(back.withColumn("forward", F.lit(False)))


def undirected_rels_of_type(graph: PropertyGraph, *types: str) -> DataFrame:
    return both_ways(rels_of_type(graph, *types))


def rels_by_id(graph: PropertyGraph, ids: Iterable[int], directed: bool = True) -> DataFrame:
    found = graph.rels.where(F.col("id").isin(list(ids)))
    return found if directed else both_ways(found)


def node_count(graph: PropertyGraph, *labels: str) -> DataFrame:
    """n: nodes with all labels."""
    return nodes_by_label(graph, *labels).agg(F.count("*").alias("n"))


def rel_count(graph: PropertyGraph, types: tuple[str, ...] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """n: relationships of the types whose ends have the labels. Only the ids of labelled nodes are joined."""
    found = rels_of_type(graph, *types)
    for label, side in ((start, "src"), (end, "dst")):
        if label:
            found = found.join(nodes_by_label(graph, label).select(F.col("id").alias(side)), side, "left_semi")
    return found.agg(F.count("*").alias("n"))


def within_distance(df: DataFrame, point: Column, centre: Column, most: float) -> DataFrame:
    """Rows whose point is at most `most` from the centre (of the same coordinate system)."""
    from chronoweave.functions.spatial import distance

    return df.where(distance(point, centre) <= most)
