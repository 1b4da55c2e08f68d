"""Planar geometry on WKT points, linestrings and polygons, as Arrow-batched functions."""

from __future__ import annotations

import functools
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"


def parse(wkt: str) -> tuple[str, list[list[tuple[float, float]]]]:
    """(kind, rings): a point and a linestring have one ring."""
    found = re.fullmatch(r"\s*(point|linestring|polygon)\s*\((.*)\)\s*", wkt, re.I | re.S)
    if not found:
        raise ValueError(f"not a WKT geometry: {wkt!r}")
    kind, body = found[1].lower(), found[2]
    rings = re.findall(r"\(([^()]*)\)", body) if kind == "polygon" else [body]
    points = [[(float(a), float(b)) for a, b in re.findall(rf"({NUMBER})\s+({NUMBER})", ring)] for ring in rings]
    if not points or not all(points):
        raise ValueError(f"not a WKT geometry: {wkt!r}")
    return kind, points


def segments(rings):
    return [(p, q) for ring in rings for p, q in zip(ring, ring[1:])] or [(rings[0][0], rings[0][0])]


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _on(p, s):
    (a, b) = s
    return abs(_cross(a, b, p)) < 1e-12 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _meet(s, t):
    (a, b), (c, d) = s, t
    turns = [math.copysign(1, x) if abs(x) > 1e-12 else 0 for x in (_cross(a, b, c), _cross(a, b, d), _cross(c, d, a), _cross(c, d, b))]
    return (turns[0] * turns[1] < 0 and turns[2] * turns[3] < 0) or any((_on(c, s), _on(d, s), _on(a, t), _on(b, t)))


def _properly(s, t):
    (a, b), (c, d) = s, t
    return _cross(a, b, c) * _cross(a, b, d) < -1e-24 and _cross(c, d, a) * _cross(c, d, b) < -1e-24


def where(p, g) -> int:
    """1 inside, 0 on the boundary, -1 outside."""
    kind, rings = g
    if kind == "point":
        return 1 if p == rings[0][0] else -1
    if any(_on(p, s) for s in segments(rings)):
        return (0 if p in (rings[0][0], rings[0][-1]) and rings[0][0] != rings[0][-1] else 1) if kind == "linestring" else 0
    if kind == "linestring":
        return -1
    inside = False
    for (x1, y1), (x2, y2) in segments(rings):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            inside = not inside
    return 1 if inside else -1


def _samples(g):
    """Vertices and midpoints."""
    return [p for s in segments(g[1]) for p in (*s, ((s[0][0] + s[1][0]) / 2, (s[0][1] + s[1][1]) / 2))]


def intersects(a, b) -> bool:
    return any(_meet(s, t) for s in segments(a[1]) for t in segments(b[1])) or where(a[1][0][0], b) >= 0 or where(b[1][0][0], a) >= 0


def _to_segment(p, s):
    (a, b) = s
    length = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = 0 if not length else max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / length))
    return math.hypot(p[0] - a[0] - t * (b[0] - a[0]), p[1] - a[1] - t * (b[1] - a[1]))


def distance(a, b) -> float:
    if intersects(a, b):
        return 0.0
    return min(min(_to_segment(s[0], t), _to_segment(s[1], t), _to_segment(t[0], s), _to_segment(t[1], s)) for s in segments(a[1]) for t in segments(b[1]))


def covers(a, b) -> bool:
    crossing = a[0] == "polygon" and any(_properly(s, t) for s in segments(a[1]) for t in segments(b[1]))
    return not crossing and all(where(p, a) >= 0 for p in _samples(b))


def contains(a, b) -> bool:
    return covers(a, b) and (any(where(p, a) > 0 for p in _samples(b)) or (b[0] == "polygon" and a[0] == "polygon"))


def _interiors_meet(a, b) -> bool:
    if any(_properly(s, t) for s in segments(a[1]) for t in segments(b[1])):
        return True
    inner = lambda g, h: any(where(p, g) > 0 and (h[0] == "polygon" or where(p, h) > 0) for p in _samples(h) if h[0] != "polygon" or where(p, g) > 0)
    return inner(a, b) or inner(b, a) or (a[0] == b[0] == "polygon" and (covers(a, b) or covers(b, a)))


def touches(a, b) -> bool:
    return intersects(a, b) and not _interiors_meet(a, b) and not a[0] == b[0] == "point"


def equals(a, b) -> bool:
    return covers(a, b) and covers(b, a)


def area(a) -> float:
    if a[0] != "polygon":
        return 0.0
    ring = lambda r: abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:]))) / 2
    return ring(a[1][0]) - sum(ring(r) for r in a[1][1:])


def _two(of, kind):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        read = functools.lru_cache(256)(parse)  # a constant side is read once a batch
        return pd.Series([None if x is None or y is None else of(read(x), read(y)) for x, y in zip(a, b)], dtype=object)

    return run


st_distance = _two(distance, T.DoubleType())
st_contains, st_intersects, st_equals, st_touches, st_covers = (_two(f, T.BooleanType()) for f in (contains, intersects, equals, touches, covers))


def st_dwithin(a, b, within: float):
    return st_distance(a, b) <= F.lit(float(within))


@F.pandas_udf(T.DoubleType())
def st_area(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else area(parse(x)) for x in a], dtype=object)
