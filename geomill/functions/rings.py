"""Measures and tests of polygons and lines, a batch of rows at a time in arrays: Columns like those of `geometry`, which are
evaluated edge by edge, but many times as fast; they can't stand within lambdas. Where both exist they give the same values.

A polygon is `rings`: array<array<double>>, each ring flat; a line is a flat array<double>. Null and empty ones measure 0 and hold no
point; edges from or to a point that isn't whole don't count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import FLATTENING, HALF_MERIDIAN, LENGTH_UNITS, RADIUS


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Edges:
    """Edges (x1, y1, x2, y2) of the flat lists of a column, in order, and the list that each is of; `whole` are those without nulls."""

    def __init__(self, flat: pa.Array, closed: bool = True):
        sizes, values = _lengths(flat), flat.flatten()
        n = sizes // 2
        self.of = np.repeat(np.arange(len(n)), n)
        first = np.repeat(np.cumsum(sizes) - sizes, n)
        place = np.arange(len(self.of)) - np.repeat(np.cumsum(n) - n, n)
        after = np.where(place + 1 < n[self.of], place + 1, 0)
        at, to = first + 2 * place, first + 2 * after
        if not closed:
            kept = after > 0
            self.of, at, to = self.of[kept], at[kept], to[kept]
        points = values.to_numpy(zero_copy_only=False).astype(float, copy=False)
        self.x1, self.y1, self.x2, self.y2 = (points[k] for k in (at, at + 1, to, to + 1))
        null = pc.is_null(values).to_numpy(zero_copy_only=False) if values.null_count else None
        if null is not None:
            whole = ~(null[at] | null[at + 1] | null[to] | null[to + 1])
            self.of, self.x1, self.y1, self.x2, self.y2 = (a[whole] for a in (self.of, self.x1, self.y1, self.x2, self.y2))

    def total(self, each: np.ndarray, n: int) -> np.ndarray:
        """Sums by list, added up in the order of the edges."""
        return np.bincount(self.of, each, n)


def _polygon_of(rings: pa.Array) -> np.ndarray:
    """The row of each ring."""
    return np.repeat(np.arange(len(rings)), _lengths(rings))


def _shells(of: np.ndarray) -> np.ndarray:
    """Whether a ring is the first of its row."""
    return np.diff(of, prepend=-1) > 0


def _area(rings: pa.Array) -> pa.Array:
    of, flat = _polygon_of(rings), rings.flatten()
    e = Edges(flat)
    sizes = np.abs(e.total((e.x1 * e.y2 - e.x2 * e.y1) / 2, len(flat)))
    out = -np.bincount(of, sizes, len(rings))
    shells = _shells(of)
    out[of[shells]] += 2 * sizes[shells]
    return pa.array(out)


def _perimeter(rings: pa.Array) -> pa.Array:
    of, flat = _polygon_of(rings), rings.flatten()
    shells = _shells(of)
    e = Edges(flat.filter(pa.array(shells)))
    out = np.zeros(len(rings))
    out[of[shells]] = e.total(geodesic(e.x1, e.y1, e.x2, e.y2), int(shells.sum()))
    return pa.array(out)


def _rings_length(rings: pa.Array) -> pa.Array:
    e = Edges(rings.flatten())
    return pa.array(np.bincount(_polygon_of(rings)[e.of], geodesic(e.x1, e.y1, e.x2, e.y2), len(rings)))


def _line_length(line: pa.Array) -> pa.Array:
    e = Edges(line, closed=False)
    return pa.array(e.total(geodesic(e.x1, e.y1, e.x2, e.y2), len(line)))


def _sums(of: np.ndarray, each: np.ndarray, lists: pa.Array, kind: pa.DataType) -> pa.Array:
    """Sums of `each` by row; null for null rows."""
    return pc.if_else(pc.is_valid(lists), pa.array(np.bincount(of, each, len(lists))).cast(kind), None)


def _total_area(polygons: pa.Array) -> pa.Array:
    return _sums(_polygon_of(polygons), _area(polygons.flatten()).to_numpy(zero_copy_only=False), polygons, pa.float64())


def _outline(polygons: pa.Array) -> pa.Array:
    of, every = _polygon_of(polygons), polygons.flatten()
    ring_of = _polygon_of(every)
    points = np.bincount(ring_of, _lengths(every.flatten()) // 2 - 1, len(every))
    names = ("n_polygons", "n_points", "area")
    sums = (_sums(of, np.ones(len(of)), polygons, pa.int64()), _sums(of, points, polygons, pa.int64()), _total_area(polygons))
    return pa.StructArray.from_arrays(sums, names=names, mask=pc.is_null(polygons))


def _planar_length(lines: pa.Array) -> pa.Array:
    of, e = _polygon_of(lines), Edges(lines.flatten(), closed=False)
    return _sums(of[e.of], np.hypot(e.x2 - e.x1, e.y2 - e.y1), lines, pa.float64())


def _holds(rings: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    e = Edges(rings.flatten())
    of = _polygon_of(rings)[e.of]
    px, py = (pc.cast(c, pa.float64()).to_numpy(zero_copy_only=False)[of] for c in (x, y))
    with np.errstate(all="ignore"):
        crosses = ((e.y1 > py) != (e.y2 > py)) & (px < e.x1 + (e.x2 - e.x1) * (py - e.y1) / (e.y2 - e.y1))
    touches = (e.x2 - e.x1) * (py - e.y1) == (e.y2 - e.y1) * (px - e.x1)
    touches &= (px >= np.minimum(e.x1, e.x2)) & (px <= np.maximum(e.x1, e.x2)) & (py >= np.minimum(e.y1, e.y2)) & (py <= np.maximum(e.y1, e.y2))
    inside = (np.bincount(of[crosses], minlength=len(rings)) % 2 == 1) | (np.bincount(of[touches], minlength=len(rings)) > 0)
    return pa.array(inside)


def _poly(x: np.ndarray, *c: float) -> np.ndarray:
    out = np.full_like(x, c[-1])
    for v in c[-2::-1]:
        out = out * x + v
    return out


def _long_line(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """`geometry.ellipsoid_length` of arrays."""
    b1, b2 = (np.arctan(np.tan(np.radians(y)) * (1 - FLATTENING)) for y in (y1, y2))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    h = np.sin(q) ** 2 + np.cos(b1) * np.cos(b2) * np.sin(np.radians(x2 - x1) / 2) ** 2
    arc = 2 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    far = (arc - np.sin(arc)) * (np.sin(p) * np.cos(q)) ** 2 / np.maximum(1 - h, 1e-18)
    near = (arc + np.sin(arc)) * (np.cos(p) * np.sin(q)) ** 2 / np.maximum(h, 1e-300)
    return np.where(h <= 0, 0.0, RADIUS * (arc - FLATTENING / 2 * (far + near)))


def geodesic(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, steps: int = 8) -> np.ndarray:
    """`geometry.geodesic_length` of arrays: the same iteration."""
    u1, u2 = (np.arctan(np.tan(np.radians(y)) * (1 - FLATTENING)) for y in (y1, y2))
    turn = np.fmod(x2 - x1 + 180, 360.0)
    across = np.radians(np.where(turn < 0, np.fmod(turn + 360, 360.0), turn) - 180)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(b), where=b != 0)

    def sphere(lam: np.ndarray) -> tuple[np.ndarray, ...]:
        sine = np.sqrt((c2 * np.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * np.cos(lam)) ** 2)
        cosine = s1 * s2 + c1 * c2 * np.cos(lam)
        a = over(c1 * c2 * np.sin(lam), sine)
        q = 1 - a * a
        return np.arctan2(sine, cosine), sine, cosine, a, q, np.where(q != 0, cosine - over(2 * s1 * s2, q), 0.0)

    lam, moved = across, np.ones_like(across)
    for _ in range(steps):
        arc, sine, cosine, a, q, m = sphere(lam)
        c = FLATTENING / 16 * q * (4 + FLATTENING * (4 - 3 * q))
        step = across + (1 - c) * FLATTENING * a * (arc + c * sine * (m + c * cosine * (2 * m * m - 1)))
        lam, moved = step, np.abs(step - lam)
    arc, sine, cosine, _, q, m = sphere(lam)
    u = q * (1 / (1 - FLATTENING) ** 2 - 1)
    big, b = _poly(u, 1.0, 1 / 4, -3 / 64, 5 / 256, -175 / 16384), _poly(u, 0.0, 1 / 4, -1 / 8, 37 / 512, -47 / 1024)
    less = b * sine * (m + b / 4 * (cosine * (2 * m * m - 1) - b / 6 * m * (4 * sine * sine - 3) * (4 * m * m - 3)))
    found = RADIUS * (1 - FLATTENING) * big * (arc - less)
    open_ = np.flatnonzero(~((moved < 1e-11) & (np.abs(lam) < math.pi)))
    if len(open_):
        found[open_] = np.minimum(_long_line(*(v[open_] for v in (x1, y1, x2, y2))), HALF_MERIDIAN)
    return np.where((x1 == x2) & (y1 == y2), 0.0, found)


def area(rings: str | Column) -> Column:
    """`geometry.planar_area`."""
    return F.arrow_udf(_area, T.DoubleType())(rings)


def perimeter(rings: str | Column, unit: str = "m") -> Column:
    """Length of the outer ring on the ellipsoid."""
    return F.arrow_udf(_perimeter, T.DoubleType())(rings) / LENGTH_UNITS[unit]


def rings_length(rings: str | Column, unit: str = "m") -> Column:
    """Length of all rings on the ellipsoid."""
    return F.arrow_udf(_rings_length, T.DoubleType())(rings) / LENGTH_UNITS[unit]


def line_length(line: str | Column, unit: str = "m") -> Column:
    """Length of a line on the ellipsoid; 0 for null and single points."""
    return F.arrow_udf(_line_length, T.DoubleType())(line) / LENGTH_UNITS[unit]


def total_area(polygons: str | Column) -> Column:
    """The sum of `area` of a list of polygons; null for null."""
    return F.arrow_udf(_total_area, T.DoubleType())(polygons)


def outline(polygons: str | Column) -> Column:
    """struct(n_polygons, n_points, area) of a list of closed polygons, the closing points not counted; null for null."""
    return F.arrow_udf(_outline, "n_polygons long, n_points long, area double")(polygons)


def planar_length(lines: str | Column) -> Column:
    """Length of a list of lines in the plane; null for null."""
    return F.arrow_udf(_planar_length, T.DoubleType())(lines)


def holds(rings: str | Column, x: str | Column, y: str | Column) -> Column:
    """Whether the polygon holds a point (even-odd rule); points on an edge count."""
    return F.arrow_udf(_holds, T.BooleanType())(rings, x, y)
