"""Joins and what the reference runs row by row: existence, optional parts, nested lists.

Row-by-row evaluation of a correlated part becomes a join on the columns that
tie it to the outer row (`on`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def node_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on node ids; null never matches. how: inner, left or right."""
    return left.join(right, list(on), how)


def value_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Inner join on equal values of two expressions; null never matches."""
    return left.join(right, condition)


def product(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Cartesian product, or a join by any condition."""
    return left.join(right, condition) if condition is not None else left.join(right, how="cross")


def semi_apply(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """EXISTS."""
    return left.join(right, list(on), "left_semi")


def anti_semi_apply(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """NOT EXISTS."""
    return left.join(right, list(on), "left_anti")


def let_semi_apply(left: DataFrame, right: DataFrame, on: Sequence[str], name: str, negate: bool = False) -> DataFrame:
    """left with a boolean: whether right has a row (negate: has none)."""
    mark = right.select(*on).distinct().withColumn(name, F.lit(True))
    flag = F.coalesce(F.col(name), F.lit(False))
    return left.join(mark, list(on), "left").withColumn(name, ~flag if negate else flag)


def select_or_semi_apply(left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column, negate: bool = False) -> DataFrame:
    """Rows for which the condition is true or right has a row (negate: has none)."""
    return let_semi_apply(left, right, on, "_exists", negate).where(condition | F.col("_exists")).drop("_exists")


def let_select_or_semi_apply(left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column, name: str, negate: bool = False) -> DataFrame:
    """left with: true if the condition is, else true if right has a row (negate: none), else null for a null condition, else false."""
    marked = let_semi_apply(left, right, on, name, negate)
    value = F.when(condition | F.col(name), True).when(condition.isNull(), F.lit(None).cast("boolean")).otherwise(False)
    return marked.withColumn(name, value)


def conditional_apply(left: DataFrame, items: Sequence[str], run: Callable[[DataFrame], DataFrame], when_null: bool = False) -> DataFrame:
    """run() on the rows whose items are all non-null (when_null: on the others); the rest go through with nulls for new columns."""
    full = F.lit(True)
    for i in items:
        full = full & F.col(i).isNotNull()
    first, rest = (left.where(~full), left.where(full)) if when_null else (left.where(full), left.where(~full))
    return run(first).unionByName(rest, allowMissingColumns=True)


def roll_up_apply(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, name: str) -> DataFrame:
    """left with the list of right's values for its row, sorted; empty without any."""
    lists = right.groupBy(*on).agg(F.sort_array(F.collect_list(value)).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return left.join(lists, list(on), "left").withColumn(name, F.coalesce(F.col(name), empty))


def optional(df: DataFrame) -> DataFrame:
    """df, or one row of nulls if it has none."""
    one = df.sparkSession.range(1).select(F.lit(True).alias("_one"))
    return one.join(df.withColumn("_there", F.lit(True)), F.col("_one"), "left").drop("_one", "_there")


def anti(df: DataFrame) -> DataFrame:
    """One row (column empty, true) if df has none, else no row."""
    return df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(True).alias("empty"))


def assert_same_node(left: DataFrame, right: DataFrame, on: Sequence[str], a: str, b: str) -> DataFrame:
    """Join in which both sides must have bound the same node: an error when read if not."""
    both = left.join(right, list(on))
    return both.where(F.assert_true(F.col(a).eqNullSafe(F.col(b)), F.lit("different nodes")).isNull())


def unwind(df: DataFrame, items: Column, name: str) -> DataFrame:
    """A row for each item of a list; none for null or empty lists. A single value: wrap it in listed()."""
    return df.withColumn(name, F.explode(items))


def listed(value: Column) -> Column:
    """A value as a list of one, null as an empty list."""
    return F.when(value.isNull(), F.array()).otherwise(F.array(value))


def foreach_item(df: DataFrame, items: Column, write: Callable[[DataFrame], None], name: str = "item") -> DataFrame:
    """write() the rows of every item; the rows of df are unchanged."""
    write(unwind(df, items, name))
    return df
