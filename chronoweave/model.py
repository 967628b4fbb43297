"""The data model: a property graph whose properties may change over time.

nodes: id BIGINT, labels ARRAY<STRING> and property columns.
rels: id BIGINT, type STRING, src BIGINT, dst BIGINT and property columns.
node_tp, rel_tp: prop STRING, entity BIGINT, st BIGINT, et BIGINT, value; closed
intervals in seconds, NOW as the open end. A null value is a stretch without a
value and is kept, since it ends the one before.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The open end of an interval.
NOW = 2_147_483_647

#: Types that a temporal property may have, and their Spark types.
PROPERTY_TYPES = {"INT": "int", "LONG": "bigint", "FLOAT": "float", "DOUBLE": "double", "STRING": "string"}


@dataclass(frozen=True)
class TemporalProperty:
    """A temporal property: of nodes or rels, with one fixed type."""

    kind: str
    name: str
    type: str

    def __post_init__(self) -> None:
        if self.kind not in ("node", "rel") or self.type not in PROPERTY_TYPES:
            raise ValueError(f"no such kind or type: {self.kind} {self.type}")


@dataclass
class PropertyGraph:
    nodes: DataFrame
    rels: DataFrame
    node_tp: DataFrame | None = None
    rel_tp: DataFrame | None = None
    schema: dict[tuple[str, str], TemporalProperty] = field(default_factory=dict)

    def declare(self, *properties: TemporalProperty) -> PropertyGraph:
        """Register temporal properties; a second type for one name is an error."""
        for p in properties:
            if self.schema.setdefault((p.kind, p.name), p) != p:
                raise ValueError(f"{p.kind} property {p.name} has another type")
        return self

    def temporal(self, kind: str, prop: str) -> DataFrame:
        """entity, st, et, value of one declared property, in its type."""
        if (kind, prop) not in self.schema:
            raise KeyError(f"no temporal {kind} property {prop}")
        table = self.node_tp if kind == "node" else self.rel_tp
        to = PROPERTY_TYPES[self.schema[kind, prop].type]
        return table.where(F.col("prop") == prop).select("entity", "st", "et", F.col("value").cast(to).alias("value"))


#: Fixed values of the adapter: ids are key * 8 + the label's or type's number.
LABELS = {"Region": 0, "Nation": 1, "Customer": 2, "Supplier": 3, "Part": 4, "Order": 5}
TYPES = {"IN_REGION": 0, "CUSTOMER_IN": 1, "SUPPLIER_IN": 2, "PLACED": 3, "CONTAINS": 4, "SUPPLIED_BY": 5}


def node_id(key, label: str):
    return (F.col(key) * 8 + LABELS[label]).cast("bigint")


def rel_id(key, kind: str):
    return (key * 8 + TYPES[kind]).cast("bigint")


def from_tables(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The driver's tables as a graph: who placed which order of which parts, who supplies them, and where all are."""

    def read(t: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{t}.parquet")

    def node(table: str, key: str, label: str, name, amount=None) -> DataFrame:
        return read(table).select(
            node_id(key, label).alias("id"), F.array(F.lit(label)).alias("labels"), F.col(name).alias("name"),
            (F.col(amount) if amount else F.lit(None)).cast("double").alias("amount"),
        )

    nodes = node("region", "r_regionkey", "Region", "r_name")
    for args in (
        ("nation", "n_nationkey", "Nation", "n_name"),
        ("customer", "c_custkey", "Customer", "c_mktsegment", "c_acctbal"),
        ("supplier", "s_suppkey", "Supplier", "s_name", "s_acctbal"),
        ("part", "p_partkey", "Part", "p_brand", "p_retailprice"),
        ("orders", "o_orderkey", "Order", "o_orderstatus", "o_totalprice"),
    ):
        nodes = nodes.unionByName(node(*args))

    def rel(df: DataFrame, key, kind: str, src, dst, weight) -> DataFrame:
        return df.select(rel_id(key, kind).alias("id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), weight.cast("double").alias("weight"))

    one, items = F.lit(1.0), read("lineitem")
    supplied = items.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    contained = items.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("n"))
    rels = rel(read("nation"), F.col("n_nationkey"), "IN_REGION", node_id("n_nationkey", "Nation"), node_id("n_regionkey", "Region"), one)
    for more in (
        rel(read("customer"), F.col("c_custkey"), "CUSTOMER_IN", node_id("c_custkey", "Customer"), node_id("c_nationkey", "Nation"), one),
        rel(read("supplier"), F.col("s_suppkey"), "SUPPLIER_IN", node_id("s_suppkey", "Supplier"), node_id("s_nationkey", "Nation"), one),
        rel(read("orders"), F.col("o_orderkey"), "PLACED", node_id("o_custkey", "Customer"), node_id("o_orderkey", "Order"), F.col("o_totalprice")),
        rel(contained, F.col("l_orderkey") * 10_000_019 + F.col("l_partkey"), "CONTAINS", node_id("l_orderkey", "Order"), node_id("l_partkey", "Part"), F.col("n")),
        rel(supplied, F.col("l_partkey") * 10_000_019 + F.col("l_suppkey"), "SUPPLIED_BY", node_id("l_partkey", "Part"), node_id("l_suppkey", "Supplier"), F.col("n")),
    ):
        rels = rels.unionByName(more)
    return PropertyGraph(nodes, rels)
