"""Projection, filter, order, limits and set operations, with the reference's null order: null is the largest value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def ascending(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def descending(c: str) -> Column:
    return F.col(c).desc_nulls_first()


def order(keys: Sequence[str]) -> list[Column]:
    """Sort columns from names; a leading minus means descending."""
    return [descending(k[1:]) if k.startswith("-") else ascending(k) for k in keys]


def project(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def select_where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which every condition is true (not null)."""
    for c in conditions:
        df = df.where(c)
    return df


def produce(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def nothing(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def fail(df: DataFrame, message: str) -> DataFrame:
    """df with an error that is raised when a row is read."""
    return df.where(F.raise_error(F.lit(message)).isNull())


def sort(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*order(keys))


def top(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows in order: each task keeps n, no full sort."""
    return df.orderBy(*order(keys)).limit(n)


def first_with_ties(df: DataFrame, *keys: str) -> DataFrame:
    """The first row in order and all that tie with it. The least key is found by a grouping, so nothing is sorted in one task."""
    names = [k.lstrip("-") for k in keys]
    best = df.select(*names).orderBy(*order(keys)).limit(1).select(*(F.col(n).alias(f"_{n}") for n in names))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return df.join(F.broadcast(best), same, "left_semi")


def top_per_group(df: DataFrame, n: int, by: Sequence[str], *keys: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order(keys))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def skip(df: DataFrame, n: int) -> DataFrame:
    return df.offset(n)


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def union_all(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second).distinct()


def ordered_union(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    return first.unionByName(second).orderBy(*order(keys))


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct() if columns else df.distinct()
