"""Measures and tests of polygons as Columns.

A polygon is `rings`: array<array<double>>, each ring flat (x0, y0, x1, y1, ...), the outer one first; repeating the first point at the end is
optional. Null or empty rings have area 0 and hold no point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid, and units in square metres or metres.
RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
AREA_UNITS = {"m2": 1.0, "sqm": 1.0, "ha": 1e4, "hectare": 1e4, "ac": 4046.8564224, "acre": 4046.8564224, "km2": 1e6, "sqkm": 1e6}
LENGTH_UNITS = {"m": 1.0, "meter": 1.0, "km": 1000.0, "kilometer": 1000.0}

HALF_MERIDIAN = 20003931.4586254  # from pole to pole, the longest of all shortest lines

_ECC2 = FLATTENING * (2 - FLATTENING)
_ECC = math.sqrt(_ECC2)
_Q_POLE = 1 + (1 - _ECC2) / (2 * _ECC) * math.log((1 + _ECC) / (1 - _ECC))


def edges(ring: Column) -> Column:
    """The ring's edges as structs, the closing one included."""
    n = F.floor(F.size(ring) / 2).cast("int")
    at = lambda i, k: F.get(ring, i * 2 + k)
    after = lambda i: F.when(i + 1 < n, i + 1).otherwise(F.lit(0))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: F.struct(at(i, 0).alias("x1"), at(i, 1).alias("y1"), at(after(i), 0).alias("x2"), at(after(i), 1).alias("y2")),
    )
    return F.filter(pieces, lambda e: e["x1"].isNotNull() & e["y2"].isNotNull())


def _total(items: Column, each) -> Column:
    return F.coalesce(F.aggregate(items, F.lit(0.0), lambda acc, e: acc + each(e)), F.lit(0.0))


def _shell_less_holes(rings: Column, each) -> Column:
    sizes = F.transform(rings, lambda r: F.abs(_total(edges(r), each)))
    return F.coalesce(let(sizes, lambda every: 2 * F.get(every, 0) - _total(every, lambda s: s)), F.lit(0.0))


def planar_area(rings: Column) -> Column:
    return _shell_less_holes(rings, lambda e: (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2)


def n_points(rings: Column) -> Column:
    return F.coalesce(F.aggregate(rings, F.lit(0), lambda acc, r: acc + F.floor(F.size(r) / 2).cast("int")), F.lit(0))


def wkb_bytes(rings: Column) -> Column:
    """Length of the polygon's WKB: a head of 9 bytes, 4 for each ring and 16 for each point."""
    return F.lit(9) + 4 * F.greatest(F.size(rings), F.lit(0)) + 16 * n_points(rings)


def bounds(rings: Column) -> dict[str, Column]:
    shell = F.get(rings, 0)
    xs, ys = F.filter(shell, lambda _, i: i % 2 == 0), F.filter(shell, lambda _, i: i % 2 == 1)
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def holds(rings: Column, x: Column, y: Column) -> Column:
    """Whether the polygon holds a point (even-odd rule); points on an edge count."""
    every = F.flatten(F.transform(rings, edges))

    def crosses(e):
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))

    def touches(e):
        flat = (e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])
        return flat & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    odd = lambda some: F.size(F.filter(some, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return F.coalesce(let(every, lambda some: odd(some) | F.exists(some, touches)), F.lit(False))


def authalic_sine(lat: Column) -> Column:
    """Sine of the latitude on the sphere with the ellipsoid's area."""
    s = F.sin(F.radians(lat))
    return (1 - _ECC2) * (s / (1 - _ECC2 * s * s) - F.ln((1 - _ECC * s) / (1 + _ECC * s)) / (2 * _ECC)) / _Q_POLE


def ellipsoid_area(rings: Column, unit: str = "m2") -> Column:
    """Area on the ellipsoid; edges are taken as straight between longitude and authalic sine."""
    scale = RADIUS * RADIUS * _Q_POLE / 2 / AREA_UNITS[unit]
    return _shell_less_holes(rings, lambda e: F.radians(e["x2"] - e["x1"]) * (authalic_sine(e["y1"]) + authalic_sine(e["y2"])) / 2) * scale


def ellipsoid_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Lambert's formula for long lines, in metres; good to about 1e-5."""
    b1, b2 = (F.atan(F.tan(F.radians(y)) * (1 - FLATTENING)) for y in (y1, y2))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    h = F.pow(F.sin(q), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    arc = 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    far = (arc - F.sin(arc)) * F.pow(F.sin(p) * F.cos(q), 2) / F.greatest(1 - h, F.lit(1e-18))
    near = (arc + F.sin(arc)) * F.pow(F.cos(p) * F.sin(q), 2) / F.greatest(h, F.lit(1e-300))
    return F.when(h <= 0, F.lit(0.0)).otherwise(RADIUS * (arc - FLATTENING / 2 * (far + near)))


def let(value: Column, use) -> Column:
    """`use(value)`, in which the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _poly(x: Column, *c: float) -> Column:
    out = F.lit(c[-1])
    for v in c[-2::-1]:
        out = out * x + F.lit(v)
    return out


def geodesic_length(x1: Column, y1: Column, x2: Column, y2: Column, steps: int = 8) -> Column:
    """Length of the shortest line on the ellipsoid in metres, by iteration for the longitude on the auxiliary sphere.

    Good to a millimetre. Each step gains a factor of about 300; for points almost opposite each other it doesn't settle, and
    these have `ellipsoid_length`, and at most half a meridian.
    """
    u1, u2 = (F.atan(F.tan(F.radians(y)) * (1 - FLATTENING)) for y in (y1, y2))
    across = F.radians(F.pmod(x2 - x1 + 180, F.lit(360.0)) - 180)
    ends = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), across.alias("l"))

    def sphere(e: Column, lam: Column) -> Column:
        """Arc, its sine and cosine, sine of the azimuth at the equator and its squared cosine, cosine of twice the middle's arc."""
        sine = F.sqrt(F.pow(e["c2"] * F.sin(lam), 2) + F.pow(e["c1"] * e["s2"] - e["s1"] * e["c2"] * F.cos(lam), 2))
        cosine = e["s1"] * e["s2"] + e["c1"] * e["c2"] * F.cos(lam)
        azimuth = lambda t: F.coalesce(e["c1"] * e["c2"] * F.sin(lam) / F.nullif(t["sin"], F.lit(0.0)), F.lit(0.0))
        middle = lambda t, a: F.coalesce(t["cos"] - 2 * e["s1"] * e["s2"] / F.nullif(1 - a * a, F.lit(0.0)), F.lit(0.0))
        both = F.struct(sine.alias("sin"), cosine.alias("cos"))
        return let(both, lambda t: let(azimuth(t), lambda a: F.struct(F.atan2(t["sin"], t["cos"]).alias("arc"), t["sin"].alias("sin"), t["cos"].alias("cos"), a.alias("a"), (1 - a * a).alias("c2"), middle(t, a).alias("m"))))

    def step(e: Column, lam: Column) -> Column:
        def next_(t: Column) -> Column:
            return let(
                FLATTENING / 16 * t["c2"] * (4 + FLATTENING * (4 - 3 * t["c2"])),
                lambda c: e["l"] + (1 - c) * FLATTENING * t["a"] * (t["arc"] + c * t["sin"] * (t["m"] + c * t["cos"] * (2 * t["m"] * t["m"] - 1))),
            )

        return let(sphere(e, lam), next_)

    def length(e: Column, lam: Column) -> Column:
        def of(t: Column, u: Column) -> Column:
            big, small = _poly(u, 1.0, 1 / 4, -3 / 64, 5 / 256, -175 / 16384), _poly(u, 0.0, 1 / 4, -1 / 8, 37 / 512, -47 / 1024)
            d = lambda b: b * t["sin"] * (t["m"] + b / 4 * (t["cos"] * (2 * t["m"] * t["m"] - 1) - b / 6 * t["m"] * (4 * t["sin"] * t["sin"] - 3) * (4 * t["m"] * t["m"] - 3)))
            return RADIUS * (1 - FLATTENING) * big * (t["arc"] - let(small, d))

        return let(sphere(e, lam), lambda t: let(t["c2"] * (1 / (1 - FLATTENING) ** 2 - 1), lambda u: of(t, u)))

    def solve(e: Column) -> Column:
        begin = F.struct(e["l"].alias("lam"), F.lit(1.0).alias("moved"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, lambda s, _: let(step(e, s["lam"]), lambda n: F.struct(n.alias("lam"), F.abs(n - s["lam"]).alias("moved"))))
        return let(found, lambda s: F.when((s["moved"] < 1e-11) & (F.abs(s["lam"]) < math.pi), length(e, s["lam"])).otherwise(F.least(ellipsoid_length(x1, y1, x2, y2), F.lit(HALF_MERIDIAN))))

    return F.when((x1 == x2) & (y1 == y2), F.lit(0.0)).otherwise(let(ends, solve))


def interior_point(rings: Column) -> Column:
    """struct(x, y): a point inside the polygon, away from its edges; null without area.

    It is the middle of the widest stretch (of equal ones the left) inside along a level between two vertices around the middle of the height, so it
    also lies inside shapes whose centre doesn't, and outside of holes.
    """

    def on(every: Column) -> Column:
        ys = F.array_distinct(F.transform(every, lambda e: e["y1"]))
        middle = (F.array_min(ys) + F.array_max(ys)) / 2
        level = (F.array_max(F.filter(ys, lambda y: y <= middle)) + F.array_min(F.filter(ys, lambda y: y > middle))) / 2
        return let(level, lambda y: widest(every, y))

    def widest(every: Column, y: Column) -> Column:
        crossing = F.filter(every, lambda e: (e["y1"] > y) != (e["y2"] > y))
        xs = F.array_sort(F.transform(crossing, lambda e: e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"])))
        pair = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(x) - 2, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(x))), lambda i: F.struct((F.get(x, i + 1) - F.get(x, i)).alias("wide"), (-(F.get(x, i) + F.get(x, i + 1)) / 2).alias("left")))
        best = let(xs, lambda x: F.array_max(pair(x)))
        return let(best, lambda b: F.when(b["wide"] > 0, F.struct((-b["left"]).alias("x"), y.alias("y"))))

    return let(F.flatten(F.transform(rings, edges)), on)


def box_rings(minx: str, miny: str, maxx: str, maxy: str) -> Column:
    x1, y1, x2, y2 = (F.col(c) for c in (minx, miny, maxx, maxy))
    return F.array(F.array(x1, y1, x2, y1, x2, y2, x1, y2, x1, y1))


def homogenize(parts: Column) -> Column:
    """The common kind of parts(kind, coordinates): the kind itself for one part, Multi... for more, else GeometryCollection."""
    kinds = F.array_distinct(F.transform(parts, lambda p: p["kind"]))
    one = F.get(kinds, 0)
    return F.when(F.size(kinds) != 1, F.lit("GeometryCollection")).when(F.size(parts) == 1, one).otherwise(F.concat(F.lit("Multi"), one))


def rings_of(kind: Column, coordinates: Column) -> Column:
    """Rings of a polygon's GeoJSON coordinates, without heights; null for other kinds and for text that is none."""
    shape = F.from_json(coordinates, "array<array<array<double>>>")
    return F.when(kind == "Polygon", F.transform(shape, lambda ring: F.flatten(F.transform(ring, lambda p: F.slice(p, 1, 2)))))


def coordinates_of(rings: Column) -> Column:
    """GeoJSON coordinates of a polygon."""
    points = lambda ring: F.transform(F.filter(F.sequence(F.lit(0), F.size(ring)), lambda i: (i % 2 == 0) & (i + 1 < F.size(ring))), lambda i: F.slice(ring, i + 1, 2))
    return F.to_json(F.transform(rings, points))
