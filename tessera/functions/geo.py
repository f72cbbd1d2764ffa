"""Simple-feature functions on WKT strings, in Spark's own expressions: points, line strings and polygons without holes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once a row; an expression named twice inside a lambda is computed at each element."""
    return F.get(F.transform(F.array(value), f), 0)


def points(wkt: Column) -> Column:
    """The coordinates as an array of (x, y)."""
    body = F.regexp_extract(wkt, r"\(+([^()]*)\)+", 1)
    numbers = F.transform(F.split(body, ","), lambda t: F.transform(F.split(F.trim(t), r"\s+"), lambda v: v.try_cast("double")))
    return F.transform(numbers, lambda v: F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y")))


def kind(wkt: Column) -> Column:
    return F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))


def _edges(ring: Column) -> Column:
    """Consecutive pairs (ax, ay, bx, by) of the ring."""
    pair = lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))
    pairs = lambda r: F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), pair)
    return _let(ring, pairs)


def within(point: Column, polygon: Column) -> Column:
    """Whether a point lies inside a polygon (ray casting; its boundary is left to rounding)."""
    crosses = lambda e, p: ((e["ay"] > p["y"]) != (e["by"] > p["y"])) & (p["x"] < (e["bx"] - e["ax"]) * (p["y"] - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    odd = lambda p: F.size(F.filter(_edges(points(polygon)), lambda e: F.coalesce(crosses(e, p), F.lit(False)))) % 2 == 1
    return _let(F.get(points(point), 0), odd)


def distance(a: Column, b: Column) -> Column:
    """Between two points, in their own units."""
    ends = F.struct(F.get(points(a), 0).alias("p"), F.get(points(b), 0).alias("q"))
    return _let(ends, lambda e: F.hypot(e["p"]["x"] - e["q"]["x"], e["p"]["y"] - e["q"]["y"]))


def area(polygon: Column) -> Column:
    return F.abs(F.aggregate(_edges(points(polygon)), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def length(line: Column) -> Column:
    return F.aggregate(_edges(points(line)), F.lit(0.0), lambda s, e: s + F.hypot(e["ax"] - e["bx"], e["ay"] - e["by"]))


def bounds(wkt: Column) -> Column:
    """(x1, y1, x2, y2)."""
    least, most = (lambda r, k, f=f: f(F.transform(r, lambda p: p[k])) for f in (F.array_min, F.array_max))
    return _let(points(wkt), lambda r: F.struct(least(r, "x").alias("x1"), least(r, "y").alias("y1"), most(r, "x").alias("x2"), most(r, "y").alias("y2")))


def envelope(wkt: Column) -> Column:
    b = bounds(wkt)
    at = lambda x, y: F.concat_ws(" ", b[x].cast("string"), b[y].cast("string"))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2"), at("x1", "y1")), F.lit("))"))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether the bounding boxes intersect: the filter before any exact test."""
    p, q = bounds(a), bounds(b)
    return (p["x1"] <= q["x2"]) & (q["x1"] <= p["x2"]) & (p["y1"] <= q["y2"]) & (q["y1"] <= p["y2"])
