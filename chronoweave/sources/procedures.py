"""Procedures: named table functions with parameters and result columns, and listings of what is registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from chronoweave.functions.aggregates import AGGREGATES
from chronoweave.functions.scalars import SCALARS
from chronoweave.model import PropertyGraph


@dataclass(frozen=True)
class Procedure:
    name: str
    parameters: tuple[str, ...]
    columns: tuple[str, ...]
    run: Callable[..., DataFrame]


PROCEDURES: dict[str, Procedure] = {}


def register(name: str, parameters: tuple[str, ...], columns: tuple[str, ...]):
    """Decorator: make a function (spark, ...) -> DataFrame callable by name."""

    def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        PROCEDURES[name.lower()] = Procedure(name, parameters, columns, run)
        return run

    return add


def call(spark: SparkSession, name: str, *args, yields: tuple[str, ...] = ()) -> DataFrame:
    """CALL name(args) YIELD columns."""
    if name.lower() not in PROCEDURES:
        raise ValueError(f"no procedure {name}")
    p = PROCEDURES[name.lower()]
    return p.run(spark, *args).select(*(yields or p.columns))


@register("db.labels", ("graph",), ("label",))
def _labels(spark: SparkSession, graph: PropertyGraph) -> DataFrame:
    return graph.nodes.selectExpr("explode(labels) AS label").distinct()


@register("db.relationshipTypes", ("graph",), ("relationshipType",))
def _types(spark: SparkSession, graph: PropertyGraph) -> DataFrame:
    return graph.rels.selectExpr("type AS relationshipType").distinct()


@register("db.propertyKeys", ("graph",), ("propertyKey",))
def _keys(spark: SparkSession, graph: PropertyGraph) -> DataFrame:
    own = {*graph.nodes.columns, *graph.rels.columns, *(n for _, n in graph.schema)} - {"id", "labels", "type", "src", "dst"}
    return spark.createDataFrame([(n,) for n in sorted(own)], "propertyKey string")


@register("dbms.components", (), ("name", "version"))
def _components(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("chronoweave", "1"), ("spark", spark.version)], "name string, version string")


@register("dbms.procedures", (), ("name", "parameters", "columns"))
def _procedures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p.name, list(p.parameters), list(p.columns)) for p in PROCEDURES.values()], "name string, parameters array<string>, columns array<string>")


@register("dbms.functions", (), ("name", "kind"))
def _functions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*((n, "scalar") for n in SCALARS), *((n, "aggregate") for n in AGGREGATES)], "name string, kind string")
