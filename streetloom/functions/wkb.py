"""Well-known binary as columns: numpy over a column's one buffer and its offsets, whatever the mix of kinds, dimensions and byte orders."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: What a run of points is.
POINT, LINE, SHELL, HOLE = range(4)


@dataclass
class Runs:
    """Runs of points: row, what it is, and its points' places in x and y (from first on, n of them)."""

    row: np.ndarray
    what: np.ndarray
    n: np.ndarray
    x: np.ndarray
    y: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n

    @property
    def of(self) -> np.ndarray:
        """The run of each point."""
        return np.repeat(np.arange(len(self.n)), self.n)


class _Walk:
    """Headers are read for all rows at once; geometries within geometries part by part."""

    def __init__(self, data: np.ndarray):
        self.data, self.found = data, []

    def number(self, at: np.ndarray, little: np.ndarray) -> np.ndarray:
        b = self.data[at[:, None] + np.arange(4)].astype(np.int64)
        return np.where(little, b @ (1 << np.array([0, 8, 16, 24])), b @ (1 << np.array([24, 16, 8, 0])))

    def take(self, rows, what, at, n, dims, little) -> None:
        if len(rows):
            self.found.append((rows, np.full(len(rows), what), at, n, dims, little))

    def walk(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Geometries of rows from at on; where each ends."""
        little = self.data[at] == 1
        code = self.number(at + 1, little)
        at = at + 5 + 4 * (code >> 29 & 1)
        dims = 2 + (code >> 31 & 1) + (code >> 30 & 1)
        code &= 0xFFFF
        dims += np.array([0, 1, 1, 2])[np.clip(code // 1000, 0, 3)]
        kind = code % 1000
        if not np.isin(kind, range(1, 8)).all():
            raise ValueError("unknown kind of geometry")
        at = at.copy()
        k = np.flatnonzero(kind == 1)
        self.take(rows[k], POINT, at[k], np.ones(len(k), np.int64), dims[k], little[k])
        at[k] += 8 * dims[k]
        k = np.flatnonzero(kind == 2)
        self.points(rows, LINE, at, k, dims, little)
        many = np.flatnonzero(kind > 2)
        count = self.number(at[many], little[many])
        at[many] += 4
        for part in range(int(count.max(initial=0))):
            here = many[count > part]
            self.points(rows, SHELL if part == 0 else HOLE, at, here[kind[here] == 3], dims, little)
            inner = here[kind[here] > 3]
            if len(inner):
                at[inner] = self.walk(rows[inner], at[inner])
        return at

    def points(self, rows, what, at, k, dims, little) -> None:
        n = self.number(at[k], little[k])
        self.take(rows[k], what, at[k] + 4, n, dims[k], little[k])
        at[k] += 4 + 8 * dims[k] * n


def runs(column: pa.Array) -> Runs:
    """Of a binary column; null and empty values have none."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    there = np.flatnonzero((np.diff(begin) > 0) & column.is_valid().to_numpy(zero_copy_only=False))
    w = _Walk(data)
    if len(there):
        w.walk(there, begin[:-1][there])
    none = np.zeros(0, np.int64)
    row, what, at, n, dims, little = (np.concatenate(c) for c in zip(*w.found, strict=True)) if w.found else (none, none, none, none, none, none.astype(bool))
    place = np.repeat(at, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * 8 * np.repeat(dims, n)
    order = np.repeat(little, n)

    def value(at: np.ndarray) -> np.ndarray:
        b = data[at[:, None] + np.arange(8)]
        return np.where(order, b.view("<f8")[:, 0], b.view(">f8")[:, 0]) if len(at) else np.zeros(0)

    return Runs(row, what, n, value(place), value(place + 8))


def _next(r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the next point of each in its run, the first after the last; whether it is the last; its run)."""
    of = r.of
    last = np.zeros(len(of), bool)
    last[(r.first + r.n - 1)[r.n > 0]] = True
    after = np.arange(len(of)) + 1
    after[last] = r.first[of[last]]
    return after, last, of


def centroids(column: pa.Array) -> pa.Array:
    """struct<x, y> of the parts of highest dimension, holes cut out; null for null and empty geometries."""
    r, size = runs(column), len(column)
    after, last, of = _next(r)
    row = r.row[of]
    total = lambda at, w: np.bincount(at, w, size)
    x, y = r.x, r.y
    # points, and first points of lines, for what has no length
    single = (r.what[of] == POINT) & ~np.isnan(x) & ~np.isnan(y) | (np.isin(np.arange(len(of)), r.first[(r.n > 0) & (r.what != POINT)]))
    masses = [total(row[single], np.ones(single.sum()))]
    moments = [(total(row[single], x[single]), total(row[single], y[single]))]
    step = ~last & (r.what[of] != POINT)
    nx, ny = x[after], y[after]
    length = np.hypot(nx - x, ny - y)[step]
    masses.append(total(row[step], length))
    moments.append((total(row[step], ((x + nx) / 2)[step] * length), total(row[step], ((y + ny) / 2)[step] * length)))
    ring = (r.what >= SHELL) & (r.n >= 3)
    at = np.flatnonzero(ring[of])
    x0, y0 = x[r.first[of[at]]], y[r.first[of[at]]]
    px, py, qx, qy = x[at] - x0, y[at] - y0, nx[at] - x0, ny[at] - y0
    cross = px * qy - qx * py
    each = lambda w: np.bincount(of[at], w, len(r.n))
    area = each(cross) / 2
    sign = np.where(r.what == HOLE, -1.0, 1.0) * np.where(area < 0, -1.0, 1.0)
    k = np.flatnonzero(ring)
    mx = each((px + qx) * cross) / 6 + area * np.where(ring, x[np.minimum(r.first, max(len(x) - 1, 0))] if len(x) else 0.0, 0.0)
    my = each((py + qy) * cross) / 6 + area * np.where(ring, y[np.minimum(r.first, max(len(y) - 1, 0))] if len(y) else 0.0, 0.0)
    masses.append(total(r.row[k], (sign * area)[k]))
    moments.append((total(r.row[k], (sign * mx)[k]), total(r.row[k], (sign * my)[k])))
    cx, cy, known = np.zeros(size), np.zeros(size), np.zeros(size, bool)
    for mass, (sx, sy) in zip(masses, moments, strict=True):  # the highest dimension comes last
        good = mass > 0
        cx[good], cy[good] = sx[good] / mass[good], sy[good] / mass[good]
        known |= good
    return pa.StructArray.from_arrays([pa.array(cx), pa.array(cy)], ["x", "y"], mask=pa.array(~known))


def lengths(column: pa.Array, measure, swapped: bool = False) -> pa.Array:
    """The sum of measure(x1, y1, x2, y2) over the steps of a geometry's lines; null for null."""
    r = runs(column)
    after, last, of = _next(r)
    step = np.flatnonzero(~last & (r.what[of] == LINE))
    x, y = (r.y, r.x) if swapped else (r.x, r.y)
    far = measure(x[step], y[step], x[after[step]], y[after[step]]) if len(step) else np.zeros(0)
    return pa.array(np.bincount(r.row[of[step]], far, len(column)), mask=~column.is_valid().to_numpy(zero_copy_only=False))


def boxes(column: pa.Array) -> np.ndarray:
    """(west, east, south, north) of each geometry; NaN for null and empty ones."""
    r = runs(column)
    row = r.row[r.of]
    out = np.full((len(column), 4), np.nan)
    for k, (values, least) in enumerate(((r.x, np.fmin), (r.x, np.fmax), (r.y, np.fmin), (r.y, np.fmax))):
        least.at(out[:, k], row, values)
    return out


def encoded(head: bytes, coordinates: list[pa.Array]) -> pa.Array:
    """head and the coordinates as little-endian doubles, a row at a time; null where one is null."""
    n, wide = len(coordinates[0]), len(head) + 8 * len(coordinates)
    out = np.empty((n, wide), np.uint8)
    out[:, : len(head)] = np.frombuffer(head, np.uint8)
    known = np.ones(n, bool)
    for k, c in enumerate(coordinates):
        known &= c.is_valid().to_numpy(zero_copy_only=False)
        values = c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8")
        out[:, len(head) + 8 * k : len(head) + 8 * (k + 1)] = values.reshape(n, 1).view(np.uint8)
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int64) * wide).astype(np.int32))
    valid = pa.py_buffer(np.packbits(known, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), n, [valid, offsets, pa.py_buffer(out)], int(n - known.sum()))
