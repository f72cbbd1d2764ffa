"""Simple-feature relations of points, line strings and polygons without holes, as a pandas function over pairs of WKT.

The linework of each geometry is cut where it meets the other's; the middle of every piece, and every point, is then inside, on or
outside the other geometry. From these follow which of interior, boundary and exterior meet, and from those the named relations. Filter
by ``geo.boxes_meet`` first: pairs whose boxes are apart are disjoint.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]
TINY = 1e-9


def parse(wkt: str) -> tuple[str, list[Point]]:
    kind = re.match(r"\s*([A-Za-z]+)", wkt)[1].upper()
    body = re.search(r"\(+([^()]*)\)+", wkt)
    return kind, [tuple(map(float, p.split()[:2])) for p in body[1].split(",")] if body else []


def _side(a: Point, b: Point, p: Point) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a: Point, b: Point, p: Point) -> bool:
    size = math.dist(a, b) or 1.0
    return abs(_side(a, b, p)) <= TINY * size and min(a[0], b[0]) - TINY <= p[0] <= max(a[0], b[0]) + TINY and min(a[1], b[1]) - TINY <= p[1] <= max(a[1], b[1]) + TINY


def _cuts(a: Point, b: Point, c: Point, d: Point) -> list[float]:
    """Places on a-b, from 0 to 1, where c-d meets it."""
    along = lambda p: ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)
    out = [along(p) for p in (c, d) if _on(a, b, p)]
    x, y = _side(c, d, a), _side(c, d, b)
    if x * y < 0 and _side(a, b, c) * _side(a, b, d) < 0:
        out.append(x / (x - y))
    return out


def _segments(g: tuple[str, list[Point]]) -> list[tuple[Point, Point]]:
    return [(a, b) for a, b in zip(g[1], g[1][1:]) if a != b]


def place(p: Point, g: tuple[str, list[Point]]) -> str:
    """``I`` inside, ``B`` on the boundary, ``E`` outside."""
    kind, pts = g
    if kind == "POINT":
        return "I" if math.dist(p, pts[0]) <= TINY else "E"
    segments = _segments(g)
    if any(_on(a, b, p) for a, b in segments):
        ends = pts[0] != pts[-1] and (math.dist(p, pts[0]) <= TINY or math.dist(p, pts[-1]) <= TINY)
        return "B" if kind == "POLYGON" or ends else "I"
    if kind != "POLYGON":
        return "E"
    odd = sum(((a[1] > p[1]) != (b[1] > p[1])) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in segments) % 2
    return "I" if odd else "E"


def _inner_point(g: tuple[str, list[Point]]) -> Point:
    """A point inside a polygon: on a level that meets no corner, between the first two crossings."""
    ys = sorted({p[1] for p in g[1]})
    y = (ys[0] + ys[1]) / 2 if len(ys) > 1 else ys[0]
    xs = sorted((b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in _segments(g) if (a[1] > y) != (b[1] > y))
    return ((xs[0] + xs[1]) / 2, y) if len(xs) > 1 else g[1][0]


def _parts(g: tuple[str, list[Point]], other: tuple[str, list[Point]]) -> list[tuple[str, str]]:
    """(part of g, place in the other) of sample points that stand for every piece."""
    kind, pts = g
    if kind == "POINT":
        return [("I", place(pts[0], other))]
    line, out = "B" if kind == "POLYGON" else "I", []
    for a, b in _segments(g):
        cuts = {0.0, 1.0}
        for c, d in _segments(other) or [(other[1][0], other[1][0])]:
            cuts.update(t for t in (_cuts(a, b, c, d) if c != d else ([math.dist(a, c) / math.dist(a, b)] if _on(a, b, c) else [])) if 0 <= t <= 1)
        ts = sorted(cuts)
        at = lambda t, a=a, b=b: (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
        out += [(line, place(at((s + t) / 2), other)) for s, t in zip(ts, ts[1:]) if t - s > TINY]
        out += [(place(at(t), g), place(at(t), other)) for t in ts]
    if kind == "POLYGON":
        out.append(("I", place(_inner_point(g), other)))
    return out


def matrix(a: str, b: str) -> set[str]:
    """Which of interior, boundary and exterior (I, B, E) of two geometries meet, as pairs such as ``IB``."""
    x, y = parse(a), parse(b)
    met = {p + q for p, q in _parts(x, y)} | {q + p for p, q in _parts(y, x)}
    if x[0] == y[0] == "POLYGON":  # beside a piece of border that runs inside the other lie points of both sides
        met |= {"II", "EI"} if "BI" in met else set()
        met |= {"II", "IE"} if "IB" in met else set()
        met |= {"IE"} if "BE" in met else set()
        met |= {"EI"} if "EB" in met else set()
    elif x[0] == "POLYGON":
        met |= {"IE"} if y[0] != "POLYGON" else set()
    elif y[0] == "POLYGON":
        met |= {"EI"}
    return met


def relations(a: str, b: str) -> dict[str, bool]:
    """The eight simple-feature relations."""
    size = {"POINT": 0, "LINESTRING": 1, "POLYGON": 2}
    met, da, db = matrix(a, b), size[parse(a)[0]], size[parse(b)[0]]
    meets = bool(met & {"II", "IB", "BI", "BB"})
    within, contains = "II" in met and not met & {"IE", "BE"}, "II" in met and not met & {"EI", "EB"}
    crosses = "II" in met and ("IE" in met if da < db else "EI" in met if da > db else da == 1 and not _shares_a_line(a, b) and bool(met & {"IE"}) and bool(met & {"EI"}))
    overlaps = da == db and {"II", "IE", "EI"} <= met and (da != 1 or _shares_a_line(a, b))
    return {"equals": within and contains, "disjoint": not meets, "intersects": meets, "touches": meets and "II" not in met, "within": within, "contains": contains, "crosses": crosses, "overlaps": overlaps}


def _shares_a_line(a: str, b: str) -> bool:
    """Whether two line strings run along each other somewhere."""
    x, y = parse(a), parse(b)
    for p, q in _segments(x):
        ts = sorted({0.0, 1.0, *(t for c, d in _segments(y) for t in _cuts(p, q, c, d) if 0 <= t <= 1)})
        for s, t in zip(ts, ts[1:]):
            mid = (p[0] + (s + t) / 2 * (q[0] - p[0]), p[1] + (s + t) / 2 * (q[1] - p[1]))
            if t - s > TINY and any(_on(c, d, mid) for c, d in _segments(y)):
                return True
    return False


NAMES = ["equals", "disjoint", "intersects", "touches", "within", "contains", "crosses", "overlaps"]


def relate(a: Column, b: Column) -> Column:
    """A struct of the eight relations as booleans; null where a geometry is null. Each distinct pair of a batch is looked at once."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known: dict = {(None, None): dict.fromkeys(NAMES)}
        rows = []
        for p in zip(x, y):
            if None in p:
                p = (None, None)
            if p not in known:
                known[p] = relations(*p)
            rows.append(known[p])
        return pd.DataFrame(rows, columns=NAMES)

    return F.pandas_udf(run, ", ".join(f"{n} boolean" for n in NAMES))(a, b)


def _wkt(kind: str, pts: list[Point]) -> str:
    body = ", ".join(f"{x:.12g} {y:.12g}" for x, y in pts)
    return f"{kind}(({body}))" if kind == "POLYGON" else f"{kind}({body})"


def _hull(points: list[Point]) -> str:
    pts = sorted(set(points))
    if len(pts) < 3:
        return _wkt("POINT" if len(pts) == 1 else "LINESTRING", pts)

    def half(points: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in points:
            while len(out) > 1 and _side(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    ring = half(pts)[:-1] + half(pts[::-1])[:-1]
    return _wkt("POLYGON", [*ring, ring[0]]) if len(ring) > 2 else _wkt("LINESTRING", ring)


def hull(wkt: str) -> str:
    """The convex hull, counter-clockwise from the least point."""
    return _hull(parse(wkt)[1])


def boundary(wkt: str) -> str:
    """A polygon's ring, the ends of an open line, nothing of a point or a closed line."""
    kind, pts = parse(wkt)
    if kind == "POLYGON":
        return _wkt("LINESTRING", pts)
    return _wkt("MULTIPOINT", [pts[0], pts[-1]]) if kind == "LINESTRING" and pts[0] != pts[-1] else "GEOMETRYCOLLECTION EMPTY"


def buffer(wkt: str, radius: float, steps: int = 32) -> str:
    """The convex buffer of a geometry's convex hull: the hull of circles of ``steps`` corners about its corners."""
    circle = [(radius * math.cos(2 * math.pi * k / steps), radius * math.sin(2 * math.pi * k / steps)) for k in range(steps)]
    return _hull([(round(x + u, 12), round(y + v, 12)) for x, y in parse(wkt)[1] for u, v in circle])


def shaped(wkt: Column, how: str, *args: float) -> Column:
    """``hull``, ``boundary`` or ``buffer`` of each geometry. Each distinct one of a batch is looked at once."""
    f = {"hull": hull, "boundary": boundary, "buffer": buffer}[how]
    return F.pandas_udf(lambda s: s.map({w: f(w, *args) for w in s.dropna().unique()}).astype(object).where(s.notna(), None), "string")(wkt)
