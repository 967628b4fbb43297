"""Connected components of a large edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronoweave.llm.session import write_shared


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node it reaches.

    Each round links neighbours to the smallest neighbour, larger ones first,
    then smaller ones, until nothing changes (logarithmic in practice). The
    minimum is taken by a grouping with partial sums and joined back, so a hub's
    neighbours are never gathered. Every round is written to the shared folder.
    Null nodes and self-links link nothing.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = _kept(now, "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, _ = _kept(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now, was = _kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small"), mark
        now, mark = now
        if mark == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    df = write_shared(df, name)
    mark = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return df, tuple(mark)
