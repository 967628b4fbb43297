"""Aggregates with the reference's results for no rows and few rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from chronoweave.functions.calendar import PARTS


def total(c: Column) -> Column:
    """Sum; 0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def total_duration(c: Column) -> Column:
    return F.struct(*(F.coalesce(F.sum(c[n]), F.lit(0)).alias(n) for n in PARTS))


def average_duration(c: Column) -> Column:
    return F.when(F.count(c) > 0, F.struct(*(F.avg(c[n]).cast("bigint").alias(n) for n in PARTS)))


def deviation(c: Column) -> Column:
    """Sample standard deviation; 0.0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def deviation_of_all(c: Column) -> Column:
    return F.coalesce(F.stddev_pop(c), F.lit(0.0))


def collect(c: Column) -> Column:
    """Values without nulls, sorted so that the result is the same each time."""
    return F.sort_array(F.collect_list(c))


def collect_all(c: Column) -> Column:
    """Values with nulls (last), sorted."""
    return F.transform(F.sort_array(F.collect_list(F.struct(c.isNull().alias("n"), c.alias("v")))), lambda s: s["v"])


def percentile_cont(c: Column, p: float) -> Column:
    """Between the two nearest values; null for no rows."""
    if not 0 <= p <= 1:
        raise ValueError("a percentile is between 0 and 1")
    return F.percentile(c, F.lit(p))


def percentile_disc(c: str, p: float) -> Column:
    """The value at place ceil(p * n)."""
    if not 0 <= p <= 1:
        raise ValueError("a percentile is between 0 and 1")
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{c}`)")


AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": F.count, "sum": total, "avg": F.avg, "min": F.min, "max": F.max, "collect": collect, "stdev": deviation,
    "stdevp": deviation_of_all, "percentilecont": percentile_cont, "percentiledisc": percentile_disc,
    "count_distinct": F.count_distinct, "sum_distinct": lambda c: F.coalesce(F.sum_distinct(c), F.lit(0)),
    "collect_distinct": lambda c: F.sort_array(F.collect_set(c)),
}


def define(name: str, aggregate: Callable[..., Column]) -> None:
    """Register a user aggregate: a composition of built-ins, or a grouped-aggregate pandas UDF."""
    AGGREGATES[name.lower()] = aggregate


def call(name: str, *args, **kwargs) -> Column:
    try:
        return AGGREGATES[name.lower()](*args, **kwargs)
    except KeyError:
        raise ValueError(f"no aggregate {name}") from None
