"""Comparison and arithmetic with the reference's null, list and integer rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def list_equals(a: Column, b: Column) -> Column:
    """Equality of two lists in three values: lengths differ or some pair differs: false; else null if a pair is unknown."""
    pairs = F.zip_with(a, b, lambda x, y: x == y)
    some_false = F.exists(pairs, lambda p: p.isNotNull() & ~p)
    some_null = F.exists(pairs, lambda p: p.isNull())
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean"))
        .when((F.size(a) != F.size(b)) | some_false, False)
        .when(some_null, F.lit(None).cast("boolean"))
        .otherwise(True)
    )


def different_types() -> Column:
    """Equality of values whose types can never be equal: false, not null."""
    return F.lit(False)


def xor(a: Column, b: Column) -> Column:
    return a != b


def is_in(x: Column, items: Column) -> Column:
    """x IN list: false for an empty list; true if some item is equal; null if one is unknown."""
    hit = F.exists(items, lambda i: i.isNotNull() & (i == x))
    unknown = x.isNull() | F.exists(items, lambda i: i.isNull())
    return (
        F.when(items.isNull(), F.lit(None).cast("boolean")).when(F.size(items) == 0, False).when(hit, True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
    )


def divide(a: Column, b: Column, whole: bool) -> Column:
    """Division: of whole numbers towards zero, by zero an error; of others as floating point."""
    if not whole:
        return a.cast("double") / b.cast("double")
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.when(b == 0, F.raise_error(F.lit("/ by zero"))).otherwise(F.call_function("div", a, b)))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % b


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


# --- predicates over lists ---------------------------------------------------------------------------------------------


def all_of(items: Column, test) -> Column:
    return F.forall(items, test)


def any_of(items: Column, test) -> Column:
    return F.exists(items, test)


def none_of(items: Column, test) -> Column:
    return ~F.exists(items, test)


def single_of(items: Column, test) -> Column:
    """Exactly one item passes; null if that depends on unknown ones."""
    sure = F.size(F.filter(items, lambda x: F.coalesce(test(x), F.lit(False))))
    unknown = F.size(F.filter(items, lambda x: test(x).isNull()))
    return F.when(items.isNull(), None).when(sure > 1, False).when(unknown > 0, F.lit(None).cast("boolean")).otherwise(sure == 1)


# --- lists and maps ----------------------------------------------------------------------------------------------------


def item(items: Column, i: Column | int) -> Column:
    """items[i] from 0, negative from the end, null out of range."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.try_element_at(items, F.when(i >= 0, i + 1).otherwise(i).cast("int"))


def list_slice(items: Column, start: Column | int | None = None, end: Column | int | None = None) -> Column:
    """items[start..end], end not included, negative from the end; null bounds give null."""
    n = F.size(items)

    def place(x, default) -> Column:
        x = default if x is None else F.lit(x) if isinstance(x, int) else x
        x = F.when(x < 0, x + n).otherwise(x)
        return F.greatest(F.lit(0), F.least(x, n))

    a, b = place(start, F.lit(0)), place(end, n)
    found = F.slice(items, a + 1, F.greatest(b - a, F.lit(0)))
    known = items.isNotNull() & a.isNotNull() & b.isNotNull()
    for x in (start, end):
        if isinstance(x, Column):
            known = known & x.isNotNull()
    return F.when(known, found)


def head(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def tail(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1)))


def number_range(start: Column, end: Column, step: Column | int = 1) -> Column:
    """Whole numbers from start to end, both included; empty where the step goes the other way."""
    step = F.lit(step) if isinstance(step, int) else step
    start, end, step = (c.cast("bigint") for c in (start, end, step))
    none = F.array().cast("array<bigint>")
    right_way = ((step > 0) & (start <= end)) | ((step < 0) & (start >= end))
    safe = F.when(right_way, F.sequence(start, end, step))
    return F.when(step == 0, F.raise_error(F.lit("a step of 0"))).when(start.isNull() | end.isNull(), None).otherwise(F.coalesce(safe, none))


def reduce_list(items: Column, start: Column, step) -> Column:
    return F.aggregate(items, start, step)


def comprehension(items: Column, where=None, then=None) -> Column:
    """[x IN items WHERE where(x) | then(x)]."""
    found = F.filter(items, where) if where else items
    return F.transform(found, then) if then else found


def is_empty(value: Column, of_text: bool = False) -> Column:
    return F.char_length(value) == 0 if of_text else F.size(value) == 0


def key_exists(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def keys(m: Column) -> Column:
    return F.map_keys(m)


def map_projection(row: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(n) for n, c in row.items()))


def has_labels(labels: Column, *wanted: str) -> Column:
    found = F.lit(True)
    for w in wanted:
        found = found & F.array_contains(labels, w)
    return found


def has_any_label(labels: Column, *wanted: str) -> Column:
    return F.arrays_overlap(labels, F.array(*map(F.lit, wanted)))
