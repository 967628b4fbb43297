"""Updates as new tables: create, merge, set, remove, delete. A graph is read, changed and written; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.model import PropertyGraph


def new_ids(rows: DataFrame, *key: str, name: str = "id") -> DataFrame:
    """Ids by a hash of the key columns: the same for a repeated run."""
    return rows.withColumn(name, F.xxhash64(*key))


def create_nodes(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """rows have id, labels and any of the property columns."""
    return replace(graph, nodes=graph.nodes.unionByName(rows, allowMissingColumns=True))


def create_rels(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    return replace(graph, rels=graph.rels.unionByName(rows, allowMissingColumns=True))


def merge_nodes(graph: PropertyGraph, rows: DataFrame, key: Sequence[str], on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> PropertyGraph:
    """Match nodes by key; set on_match columns on those found, create the others with on_create columns.

    Columns are over the node and over row_<column> of the matching row. Of
    several rows of one key, one counts; null keys never match and are created.
    """
    one = rows.dropDuplicates(list(key))
    marked = one.select(*(F.col(c).alias(f"row_{c}") for c in one.columns))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"row_{k}"))
    found = graph.nodes.join(marked, same, "left")
    hit = F.col(f"row_{key[0]}").isNotNull()
    changed = found.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in (on_match or {}).items()}).select(*graph.nodes.columns)
    missing = one.join(graph.nodes.select(*key), list(key), "left_anti").withColumns(on_create or {})
    return replace(graph, nodes=changed.unionByName(missing.select(*(c for c in missing.columns if c in graph.nodes.columns)), allowMissingColumns=True))


def set_properties(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Set properties on the rows for which where is true; a null value removes one."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) if c in df.columns else F.when(where, v) for c, v in values.items()})


def set_from_map(df: DataFrame, where: Column, props: str, new: Column, replace_all: bool) -> DataFrame:
    """= or += of a map on a map column: all of it, or key by key; keys of null value go."""
    old = F.coalesce(props, F.create_map().cast(df.schema[props].dataType))
    merged = new if replace_all else F.map_zip_with(old, new, lambda k, a, b: F.when(F.map_contains_key(new, k), b).otherwise(a))
    return df.withColumn(props, F.when(where, F.map_filter(merged, lambda k, v: v.isNotNull())).otherwise(F.col(props)))


def set_labels(df: DataFrame, where: Column, *labels: str) -> DataFrame:
    return df.withColumn("labels", F.when(where, F.array_union("labels", F.array(*map(F.lit, labels)))).otherwise(F.col("labels")))


def remove_labels(df: DataFrame, where: Column, *labels: str) -> DataFrame:
    return df.withColumn("labels", F.when(where, F.array_except("labels", F.array(*map(F.lit, labels)))).otherwise(F.col("labels")))


def remove_properties(df: DataFrame, where: Column, *props: str) -> DataFrame:
    return df.withColumns({p: F.when(~F.coalesce(where, F.lit(False)), F.col(p)) for p in props})


def delete_rels(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """ids: column id. Null ids delete nothing."""
    return replace(graph, rels=graph.rels.join(ids.select("id"), "id", "left_anti"))


def detach_delete_nodes(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Nodes and all their relationships."""
    gone = ids.select("id").distinct()
    rels = graph.rels
    for side in ("src", "dst"):
        rels = rels.join(gone.withColumnRenamed("id", side), side, "left_anti").select(*graph.rels.columns)
    return replace(graph, nodes=graph.nodes.join(gone, "id", "left_anti"), rels=rels)


def delete_nodes(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Nodes without relationships; reading the result is an error if one has any."""
    gone = ids.select("id").distinct()
    held = graph.rels.select(F.col("src").alias("id")).union(graph.rels.select("dst")).join(gone, "id", "left_semi").agg(F.count("*").alias("n"))
    checked = held.where(F.assert_true(F.col("n") == 0, F.lit("a node to delete still has relationships")).isNull()).select(F.lit(True).alias("_fine"))
    return replace(graph, nodes=graph.nodes.join(gone, "id", "left_anti").join(F.broadcast(checked), how="left_semi"))


def delete_paths(graph: PropertyGraph, paths: DataFrame, path: str = "path", detach: bool = False) -> PropertyGraph:
    """All nodes and relationships of paths (struct of nodes, rels); null paths delete nothing."""
    left = delete_rels(graph, paths.select(F.explode(f"{path}.rels").alias("id")))
    nodes = paths.select(F.explode(f"{path}.nodes").alias("id"))
    return detach_delete_nodes(left, nodes) if detach else delete_nodes(left, nodes)


def in_batches(rows: DataFrame, batches: int, write: Callable[[DataFrame, int], None]) -> int:
    """Write rows in so many parts by hash, one transaction each; returns their number."""
    for k in range(batches):
        write(rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(batches)) == k), k)
    return batches
