"""Scalar functions by their names in the query language: SCALARS[name](columns...) -> Column. Names are not case-sensitive."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from chronoweave.functions import calendar, spatial, values


def _text(c: Column) -> Column:
    return c.cast("string")


def to_integer(c: Column) -> Column:
    """A number, or text of one, as a whole number towards zero; else null."""
    t = _text(c)
    d = t.try_cast("double")
    return F.coalesce(t.try_cast("bigint"), F.when(F.abs(d) < 9.2e18, d).cast("bigint"))


def to_float(c: Column) -> Column:
    return _text(c).try_cast("double")


def to_boolean(c: Column) -> Column:
    t = F.lower(F.trim(_text(c)))
    return F.when(t == "true", True).when(t == "false", False)


def split(text: Column, by: str | list[str]) -> Column:
    """Parts of a text between delimiters, empty ones kept."""
    marks = [by] if isinstance(by, str) else by
    return F.split(text, "|".join(re.escape(m) for m in marks), -1)


def substring(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """From 0."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.char_length(text) if length is None else F.lit(length) if isinstance(length, int) else length
    return F.substring(text, start + 1, length)


def left(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def right(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def rounded(c: Column, digits: int = 0, mode: str = "HALF_UP") -> Column:
    """Rounding by mode: UP, DOWN, CEILING, FLOOR, HALF_UP, HALF_DOWN or HALF_EVEN."""
    scale = 10.0**digits
    x = c.cast("double") * scale
    low = F.floor(F.abs(x))
    half = F.abs(x) - low
    whole = {
        "UP": F.signum(x) * F.ceil(F.abs(x)),
        "DOWN": F.signum(x) * low,
        "CEILING": F.ceil(x),
        "FLOOR": F.floor(x),
        "HALF_UP": F.signum(x) * F.floor(F.abs(x) + 0.5),
        "HALF_DOWN": F.signum(x) * F.when(half > 0.5, low + 1).otherwise(low),
        "HALF_EVEN": F.signum(x) * F.when((half > 0.5) | ((half == 0.5) & (low % 2 == 1)), low + 1).otherwise(low),
    }[mode]
    return whole.cast("double") / scale


def matches(text: Column, pattern: str) -> Column:
    """=~: the whole text matches."""
    return text.rlike(f"^(?:{pattern})$")


SCALARS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "ceil": lambda c: F.ceil(c).cast("double"), "floor": lambda c: F.floor(c).cast("double"), "round": rounded,
    "sign": lambda c: F.signum(c).cast("bigint"), "rand": F.rand, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log10": F.log10,
    "e": F.e, "pi": F.pi, "sin": F.sin, "cos": F.cos, "tan": F.tan, "cot": F.cot, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "atan2": F.atan2, "degrees": F.degrees, "radians": F.radians, "haversin": lambda c: (1 - F.cos(c)) / 2,
    "left": left, "right": right, "substring": substring, "replace": F.replace, "split": split, "trim": F.trim, "ltrim": F.ltrim,
    "rtrim": F.rtrim, "tolower": F.lower, "toupper": F.upper, "reverse": F.reverse, "tostring": _text, "tostringornull": _text,
    "tostringlist": lambda c: F.transform(c, _text), "tointeger": to_integer, "tointegerornull": to_integer,
    "tointegerlist": lambda c: F.transform(c, to_integer), "tofloat": to_float, "tofloatornull": to_float,
    "tofloatlist": lambda c: F.transform(c, to_float), "toboolean": to_boolean, "tobooleanornull": to_boolean,
    "tobooleanlist": lambda c: F.transform(c, to_boolean), "randomuuid": F.uuid,
    "size": F.size, "head": values.head, "last": values.last, "tail": values.tail, "range": values.number_range,
    "reduce": values.reduce_list, "keys": values.keys, "isempty": values.is_empty, "coalesce": F.coalesce,
    "exists": lambda c: c.isNotNull(), "properties": lambda **c: values.map_projection(c), "labels": F.sort_array, "id": lambda c: c,
    "type": lambda c: c, "nodes": lambda p: p["nodes"], "relationships": lambda p: p["rels"], "length": lambda p: F.size(p["rels"]),
    "length3_5": F.char_length, "file": F.input_file_name, "point": spatial.point, "point.distance": spatial.distance,
    "point.withinbbox": spatial.within_box, "date": calendar.date, "localdatetime": calendar.local_datetime,
    "localtime": calendar.local_time, "time": calendar.time, "duration": calendar.duration,
}


def call(name: str, *args, **kwargs) -> Column:
    """The function of that name: a built-in, or one registered with define()."""
    try:
        return SCALARS[name.lower()](*args, **kwargs)
    except KeyError:
        raise ValueError(f"no function {name}") from None


def define(name: str, function: Callable[..., Column]) -> None:
    """Register a user function of columns (a composition of built-ins, or a pandas UDF)."""
    SCALARS[name.lower()] = function
