"""Geometry functions on well-known binary columns and plain coordinates.

Distances and projections are column expressions and stay in the JVM. Parsing
binary geometry has no built-in that is on by default, so it goes through Arrow UDFs.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wkb

#: Spherical radius of web Mercator, and the WGS 84 ellipsoid.
MERCATOR_RADIUS = 6378137.0
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(MERCATOR_RADIUS) * F.radians(lon), F.lit(MERCATOR_RADIUS) * F.log(F.tan(F.lit(np.pi / 4) + F.radians(lat) / 2))


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - F.lit(np.pi / 2))


def reprojected(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates in another reference system; unchanged if it is the same one."""
    if source == target:
        return x, y
    if (source, target) == (4326, 3857):
        return to_web_mercator(x, y)
    if (source, target) == (3857, 4326):
        return from_web_mercator(x, y)
    raise ValueError(f"no transformation from {source} to {target}")


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _points(raw: bytes, at: int, order: str, dims: int) -> tuple[np.ndarray, int]:
    n = struct.unpack_from(order + "I", raw, at)[0]
    size = 8 * dims * n
    pts = np.frombuffer(raw, order + "f8", dims * n, at + 4).reshape(n, dims)[:, :2].astype(float)
    return pts, at + 4 + size


def parse_wkb(raw: bytes, at: int = 0):
    """(kind, parts, end): kind is 1 to 7; parts are points, rings or nested geometries. ISO and extended headers."""
    order = "<" if raw[at] else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    at += 5
    if code & 0x20000000:
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0xFFFF
    dims += (0, 1, 1, 2)[code // 1000]
    kind = code % 1000
    if kind == 1:
        p = np.frombuffer(raw, order + "f8", dims, at)[:2].astype(float)
        return kind, p.reshape(1, 2), at + 8 * dims
    if kind == 2:
        pts, at = _points(raw, at, order, dims)
        return kind, pts, at
    n = struct.unpack_from(order + "I", raw, at)[0]
    at += 4
    parts = []
    for _ in range(n):
        if kind == 3:
            part, at = _points(raw, at, order, dims)
        else:
            inner, part, at = parse_wkb(raw, at)
            part = (inner, part)
        parts.append(part)
    return kind, parts, at


def _ring(r: np.ndarray) -> tuple[float, np.ndarray]:
    """Signed area and its first moment, about the ring's first point."""
    if len(r) < 3:
        return 0.0, np.zeros(2)
    p = r - r[0]
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    area = cross.sum() / 2
    return area, ((p + q) * cross[:, None]).sum(0) / 6 + area * r[0]


def _measure(kind: int, parts) -> list[tuple[float, np.ndarray]]:
    """(mass, first moment) by dimension: of points, lines and areas."""
    out = [(0.0, np.zeros(2)) for _ in range(3)]

    def add(d: int, mass: float, moment: np.ndarray) -> None:
        out[d] = (out[d][0] + mass, out[d][1] + moment)

    if kind == 1:
        if not np.isnan(parts).any():
            add(0, 1.0, parts[0])
    elif kind == 2:
        length = np.sqrt((np.diff(parts, axis=0) ** 2).sum(1))
        add(1, length.sum(), ((parts[1:] + parts[:-1]) / 2 * length[:, None]).sum(0))
        if len(parts):
            add(0, 1.0, parts[0])
    elif kind == 3:
        for k, r in enumerate(parts):
            area, moment = _ring(r)
            sign = (1 if k == 0 else -1) * (np.sign(area) or 1)
            add(2, sign * area, sign * moment)
            for d, (mass, first) in enumerate(_measure(2, r)[:2]):
                add(d, mass, first)
    else:
        for inner, part in parts:
            for d, (mass, first) in enumerate(_measure(inner, part)):
                add(d, mass, first)
    return out


def centroid(raw: bytes | None) -> tuple[float, float] | None:
    """Of the parts of highest dimension; holes are cut out. None for null and empty geometries."""
    if raw is None:
        return None
    kind, parts, _ = parse_wkb(bytes(raw))
    for mass, moment in reversed(_measure(kind, parts)):
        if mass > 0:
            return float(moment[0] / mass), float(moment[1] / mass)
    return None


def geodesic(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres along the ellipsoid, by Vincenty's inverse formula; antipodal points stop at its last step."""
    a, f = SEMI_MAJOR, FLATTENING
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    along = np.radians(np.asarray(lon2) - np.asarray(lon1))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = along.copy()
    with np.errstate(all="ignore"):
        for _ in range(50):
            sin_s = np.sqrt((c2 * np.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * np.cos(lam)) ** 2)
            cos_s = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, c1 * c2 * np.sin(lam) / np.where(sin_s == 0, 1, sin_s))
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a == 0, 0, cos_s - 2 * s1 * s2 / np.where(cos2_a == 0, 1, cos2_a))
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            after = along + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            done = np.nanmax(np.abs(after - lam), initial=0) < 1e-13
            lam = after
            if done:
                break
        u = cos2_a * (a * a - b * b) / (b * b)
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = big_b * sin_s * (mid + big_b / 4 * (cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return b * big_a * (sigma - d)


def line_length(raw: bytes | None, axis_order: str = "xy") -> float | None:
    """Geodesic metres of a (multi) line; axis_order "yx" reads coordinates as lat, lon."""
    if raw is None:
        return None
    kind, parts, _ = parse_wkb(bytes(raw))
    lines = [parts] if kind == 2 else [p for k, p in parts if k == 2] if kind in (5, 7) else []
    total = 0.0
    for p in lines:
        if axis_order == "yx":
            p = p[:, ::-1]
        if len(p) > 1:
            total += float(geodesic(p[:-1, 0], p[:-1, 1], p[1:, 0], p[1:, 1]).sum())
    return total


def centroid_xy(geometry: Column) -> Column:
    """struct<x, y> of a geometry's centroid; of a point, itself."""

    @F.arrow_udf("struct<x:double,y:double>")
    def run(g: pa.Array) -> pa.Array:
        return wkb.centroids(g)

    return run(geometry)


def length_spheroid(geometry: Column, axis_order: str = "xy") -> Column:
    """Metres of a geometry's lines along the ellipsoid."""

    @F.arrow_udf("double")
    def run(g: pa.Array) -> pa.Array:
        return wkb.lengths(g, geodesic, axis_order == "yx")

    return run(geometry)


def _encoded(head: bytes, *coordinates: Column) -> Column:
    """head and the coordinates' doubles; null if one is null."""

    @F.arrow_udf("binary")
    def run(c: pa.Array) -> pa.Array:
        return wkb.encoded(head, c.flatten())

    return run(F.struct(*(c.cast("double").alias(f"c{k}") for k, c in enumerate(coordinates))))


def point_wkb(x: Column, y: Column) -> Column:
    """A point as little-endian well-known binary."""
    return _encoded(struct.pack("<BI", 1, 1), x, y)


def line_wkb(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The line from one point to another."""
    return _encoded(struct.pack("<BII", 1, 2, 2), x1, y1, x2, y2)


def polygon_wkb(*rings: list[tuple[Column, Column]]) -> Column:
    """A polygon of rings of points, the shell first; rings end where they begin."""
    parts = [_encoded(struct.pack("<I", len(r)), *(c for p in r for c in p)) for r in rings]
    return F.concat(F.lit(struct.pack("<BII", 1, 3, len(rings))), *parts)


def multi_wkb(kind: int, *parts: Column) -> Column:
    """A multi geometry (4 points, 5 lines, 6 polygons, 7 of any) of geometries."""
    return F.concat(F.lit(struct.pack("<BII", 1, kind, len(parts))), *parts)


def line_points(raw: bytes) -> list[np.ndarray]:
    """The points of each line of a (multi) line."""
    kind, parts, _ = parse_wkb(raw)
    return [parts] if kind == 2 else [p for k, p in parts if k == 2] if kind in (5, 7) else []


def lines_wkb(lines: list[np.ndarray]) -> bytes:
    """A line, or a multi line if there are several or none."""
    one = [struct.pack("<BII", 1, 2, len(p)) + p.astype("<f8").tobytes() for p in lines]
    return one[0] if len(one) == 1 else struct.pack("<BII", 1, 5, len(one)) + b"".join(one)
