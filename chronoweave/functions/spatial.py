"""Points in Cartesian or WGS-84 coordinates, two or three of them: structs of srid, x, y, z."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Identifiers of the coordinate systems, and the earth's radius in metres.
WGS84, WGS84_3D, CARTESIAN, CARTESIAN_3D = 4326, 4979, 7203, 9157
_RADIUS = 6378140.0


def point(x: Column, y: Column, z: Column | None = None, geographic: bool = False) -> Column:
    """A point; null if a coordinate is."""
    srid = (WGS84 if geographic else CARTESIAN) if z is None else (WGS84_3D if geographic else CARTESIAN_3D)
    third = F.lit(None).cast("double") if z is None else z.cast("double")
    known = x.isNotNull() & y.isNotNull() & (F.lit(True) if z is None else z.isNotNull())
    return F.when(known, F.struct(F.lit(srid).alias("srid"), x.cast("double").alias("x"), y.cast("double").alias("y"), third.alias("z")))


def distance(a: Column, b: Column) -> Column:
    """Euclidean or great-circle distance (metres; with heights: at their mean, then by Pythagoras); null across systems."""
    dz = F.coalesce(a["z"] - b["z"], F.lit(0.0))
    flat = F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + F.pow(dz, 2))
    lat1, lat2 = F.radians(a["y"]), F.radians(b["y"])
    half = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(F.radians(b["x"] - a["x"]) / 2), 2)
    height = F.coalesce((a["z"] + b["z"]) / 2, F.lit(0.0))
    arc = 2 * (F.lit(_RADIUS) + height) * F.asin(F.sqrt(F.least(half, F.lit(1.0))))
    globe = F.sqrt(F.pow(arc, 2) + F.pow(dz, 2))
    return F.when(a["srid"] == b["srid"], F.when(a["srid"].isin(WGS84, WGS84_3D), globe).otherwise(flat))


def within_box(p: Column, low: Column, high: Column) -> Column:
    """Whether p lies in the box of two corners of its system; a geographic box may cross the date line."""
    def inside(c: str) -> Column:
        return p[c].between(low[c], high[c])

    wraps = p["srid"].isin(WGS84, WGS84_3D) & (low["x"] > high["x"])
    x = F.when(wraps, (p["x"] >= low["x"]) | (p["x"] <= high["x"])).otherwise(inside("x"))
    z = F.when(p["z"].isNull(), True).otherwise(inside("z"))
    same = (p["srid"] == low["srid"]) & (p["srid"] == high["srid"])
    return F.when(same, x & inside("y") & z)
