"""Geography and plane geometry: distances, boxes, polygons, grids, as Column arithmetic where possible."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres.
EARTH_RADIUS = 6_371_008.7714
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lat1: Column, lon1: Column, lat2, lon2, radius: float = EARTH_RADIUS) -> Column:
    """Metres between two points."""
    c = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    lat2, lon2 = c(lat2), c(lon2)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def in_box(lat: Column, lon: Column, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    """Within a box, which crosses the date line if min_lon is above max_lon."""
    across = (lon >= min_lon) | (lon <= max_lon) if min_lon > max_lon else lon.between(min_lon, max_lon)
    return lat.between(min_lat, max_lat) & across


def box_around(lat: float, lon: float, radius: float) -> tuple[float, float, float, float]:
    """(min_lat, max_lat, min_lon, max_lon) of a circle; a cheap filter before exact distances."""
    d = math.degrees(radius / EARTH_RADIUS)
    low, high = lat - d, lat + d
    if low <= -90 or high >= 90:
        return max(low, -90.0), min(high, 90.0), -180.0, 180.0
    w = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat)))))
    wrap = lambda x: (x + 540) % 360 - 180
    return low, high, wrap(lon - w), wrap(lon + w)


def within_distance(lat: Column, lon: Column, lat0: float, lon0: float, radius: float) -> Column:
    return in_box(lat, lon, *box_around(lat0, lon0, radius)) & (haversine(lat, lon, lat0, lon0) <= radius)


def check_polygon(points: Sequence[tuple[float, float]]) -> None:
    if len(points) < 4 or points[0] != points[-1]:
        raise ValueError("a polygon needs at least 4 points, the last equal to the first")


def in_polygon(y: Column, x: Column, points: Sequence[tuple[float, float]], holes: Sequence[Sequence[tuple[float, float]]] = ()) -> Column:
    """Inside a polygon of (y, x) points, or on its edge, and in none of its holes: crossings are counted edge by edge."""
    for p in (points, *holes):
        check_polygon(p)

    def crossings(ring: Sequence[tuple[float, float]]) -> tuple[Column, Column]:
        odd, edge = F.lit(0), F.lit(False)
        for (y1, x1), (y2, x2) in zip(ring, ring[1:], strict=False):
            cross = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1) if y2 != y1 else 0.0) + x1) if y1 != y2 else F.lit(False)
            odd = odd + cross.cast("int")
            on = ((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
            edge = edge | on
        return odd % 2 == 1, edge

    ys, xs = [p[0] for p in points], [p[1] for p in points]
    inside, edge = crossings(points)
    out = inside | edge
    for h in holes:
        within, on = crossings(h)
        out = out & (~within | on)
    return y.between(min(ys), max(ys)) & x.between(min(xs), max(xs)) & out


def euclidean(x1: Column, y1: Column, x2, y2) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def encode_latitude(lat: Column) -> Column:
    """A latitude as a 32-bit integer."""
    return F.least(F.floor(lat / (180.0 / (1 << 32))), F.lit((1 << 31) - 1)).cast("long")


def encode_longitude(lon: Column) -> Column:
    return F.least(F.floor(lon / (360.0 / (1 << 32))), F.lit((1 << 31) - 1)).cast("long")


def decode_latitude(code: Column) -> Column:
    return code * (180.0 / (1 << 32))


def decode_longitude(code: Column) -> Column:
    return code * (360.0 / (1 << 32))


def quad_cell(lat: Column, lon: Column, level: int) -> Column:
    """The quad cell of a point as a string of digits: at each level 0 to 3 for north-west, north-east, south-west, south-east."""
    n = 1 << level
    row = F.least(F.floor((90.0 - lat) / 180.0 * n), F.lit(n - 1)).cast("long")
    col = F.least(F.floor((lon + 180.0) / 360.0 * n), F.lit(n - 1)).cast("long")
    digits = []
    for k in range(level - 1, -1, -1):
        bit = 1 << k
        digits.append((((row / bit).cast("long") % 2) * 2 + (col / bit).cast("long") % 2).cast("string"))
    return F.concat(*digits)


def geohash(lat: Column, lon: Column, length: int = 6) -> Column:
    """The geohash of a point: bits of longitude and latitude in turn, five to a character."""
    bits = 5 * length
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * (1 << lon_bits)), F.lit((1 << lon_bits) - 1)).cast("long")
    y = F.least(F.floor((lat + 90.0) / 180.0 * (1 << lat_bits)), F.lit((1 << lat_bits) - 1)).cast("long")
    out = []
    for i in range(length):
        v = F.lit(0)
        for k in range(5):
            b = i * 5 + k
            src, pos = (x, lon_bits - 1 - b // 2) if b % 2 == 0 else (y, lat_bits - 1 - b // 2)
            v = v * 2 + F.shiftright(src, pos).bitwiseAND(F.lit(1).cast("long"))
        out.append(F.substring(F.lit(BASE32), v.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def heatmap_cell(lat: Column, lon: Column, rows: int, cols: int, box: tuple[float, float, float, float] = (-90.0, 90.0, -180.0, 180.0)) -> tuple[Column, Column]:
    """(row, column) of the grid cell that holds a point, rows from the top."""
    a, b, c, d = box
    r = F.least(F.floor((b - lat) / ((b - a) / rows)), F.lit(rows - 1)).cast("int")
    k = F.least(F.floor((lon - c) / ((d - c) / cols)), F.lit(cols - 1)).cast("int")
    return r, k


def box_relation(lo: tuple, hi: tuple, qlo: tuple, qhi: tuple, operation: str) -> Column:
    """How a rectangle of Columns ((min_y, min_x), (max_y, max_x)) relates to a query's: intersects, is_within, contains, is_disjoint_to, equals or overlaps."""
    each = lambda f: f(lo[0], hi[0], qlo[0], qhi[0]) & f(lo[1], hi[1], qlo[1], qhi[1])
    meets = each(lambda a, b, p, q: (a <= q) & (b >= p))
    within = each(lambda a, b, p, q: (a >= p) & (b <= q))
    contains = each(lambda a, b, p, q: (a <= p) & (b >= q))
    equal = each(lambda a, b, p, q: (a == p) & (b == q))
    return {"intersects": meets, "is_within": within, "contains": contains, "is_disjoint_to": ~meets, "equals": equal, "overlaps": meets & ~within & ~contains}[operation]


def overlap_ratio(lo: tuple, hi: tuple, qlo: tuple, qhi: tuple) -> Column:
    """The shared area's share of the query times that of the rectangle."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(hi[i], F.lit(qhi[i])) - F.greatest(lo[i], F.lit(qlo[i])))
    shared = side(0) * side(1)
    own = (hi[0] - lo[0]) * (hi[1] - lo[1])
    query = (qhi[0] - qlo[0]) * (qhi[1] - qlo[1])
    return F.when(own > 0, shared / own).otherwise(0.0) * (shared / query)


def to_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A point on the unit sphere."""
    p, l = F.radians(lat), F.radians(lon)  # noqa: E741
    return F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p)


def arc_distance(a: tuple[Column, Column, Column], b: tuple) -> Column:
    """Radians between points on the unit sphere."""
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), a[0] * b[0] + a[1] * b[1] + a[2] * b[2])))


def ellipsoid_xyz(lat: Column, lon: Column, a: float = 6378137.0, f: float = 1 / 298.257223563) -> tuple[Column, Column, Column]:
    """A point on an ellipsoid, in metres."""
    e2 = f * (2 - f)
    p, l = F.radians(lat), F.radians(lon)  # noqa: E741
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    return n * F.cos(p) * F.cos(l), n * F.cos(p) * F.sin(l), n * (1 - e2) * F.sin(p)


def parse_wkt(wkt: str) -> tuple[str, list[list[tuple[float, float]]]]:
    """A POINT, LINESTRING, POLYGON or ENVELOPE as its kind and rings of (y, x)."""
    kind, _, body = wkt.strip().partition("(")
    kind = kind.strip().upper()
    body = body.rsplit(")", 1)[0]
    if kind == "ENVELOPE":
        x1, x2, y2, y1 = (float(v) for v in body.split(","))
        return "POLYGON", [[(y1, x1), (y1, x2), (y2, x2), (y2, x1), (y1, x1)]]
    rings = [r.strip(" ()") for r in body.split("),")] if kind == "POLYGON" else [body]
    return kind, [[tuple(float(v) for v in reversed(p.split()[:2])) for p in r.split(",")] for r in rings]


def _segments(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ring[:-1], ring[1:]


def _cross(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _holds(ring: np.ndarray, p: np.ndarray) -> bool:
    a, b = _segments(ring)
    on = (_cross(a, b, p) == 0) & (np.minimum(a, b) <= p).all(-1) & (p <= np.maximum(a, b)).all(-1)
    if on.any():
        return True
    up = (a[:, 0] > p[0]) != (b[:, 0] > p[0])
    x = (p[0] - a[up, 0]) * (b[up, 1] - a[up, 1]) / (b[up, 0] - a[up, 0]) + a[up, 1]
    return bool((p[1] < x).sum() % 2)


def relate(one: str, other: str) -> str:
    """How a shape (WKT) relates to another: disjoint, within, contains or intersects. Rings of polygons but the first are holes."""
    (k1, r1), (k2, r2) = parse_wkt(one), parse_wkt(other)
    a, b = [np.array(r, float) for r in r1], [np.array(r, float) for r in r2]
    inside = lambda kind, rings, p: kind == "POLYGON" and _holds(rings[0], p) and not any(_holds(h, p) for h in rings[1:])
    cross = False
    for x in a:
        for y in b:
            if len(x) > 1 and len(y) > 1:
                (p, q), (s, t) = _segments(x), _segments(y)
                d1, d2 = _cross(p[:, None], q[:, None], s[None]), _cross(p[:, None], q[:, None], t[None])
                d3, d4 = _cross(s[None], t[None], p[:, None]), _cross(s[None], t[None], q[:, None])
                cross |= bool(((d1 * d2 < 0) & (d3 * d4 < 0)).any())
    a_in = [inside(k2, b, p) or (k1 == k2 == "POINT" and bool((p == b[0][0]).all())) for p in a[0]]
    b_in = [inside(k1, a, p) or (k1 == k2 == "POINT" and bool((p == a[0][0]).all())) for p in b[0]]
    if not cross and all(a_in):
        return "within"
    if not cross and all(b_in):
        return "contains"
    return "intersects" if cross or any(a_in) or any(b_in) else "disjoint"


def shape_relation(shape: Column, query: str) -> Column:
    """relate() of each WKT shape to one query shape, by Arrow batch."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else relate(w, query))

    return udf(shape)
