"""Lines and points in overlays, buffers and tiles.

A line is flat (x0, y0, x1, y1, ...), and so is a set of points. Spark finds the pairs by boxes; a kernel cuts the line of one
pair, so no task holds more than a pair at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rings as R
from .outlines import assemble
from .overlay import RINGS, SHARE, TINY, Rings, _listed, _runs, _shares, around, by_pair, expanded, named, overlay, shaped
from .spatial import points_in, spatial_join

LINES = "array<array<double>>"


def with_line_box(df: DataFrame, column: str = "line") -> DataFrame:
    """`df` with the box of a flat line; null for a null or empty line."""
    return df.withColumns(G.bounds(F.array(column)))


def _odd(x1, y1, x2, y2, x, y) -> np.ndarray:
    """Whether the edge crosses the ray from the point to the right."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return ((y1 > y) != (y2 > y)) & (x < x1 + (x2 - x1) * (y - y1) / (y2 - y1))


def _inside(rings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each point is in the polygon."""
    every = Rings.of_lists([rings])
    edges = np.hstack([every.points, every.points[every.following()]])
    return sum((_odd(*e, x, y) for e in edges), np.zeros(len(x), np.int64)) % 2 == 1


def cut_lines(lines: Rings, polygons: Rings, count: int, outside: bool = False) -> list[np.ndarray]:
    """[line of each stretch, points of each stretch, all points]: the stretches of each of `count` lines inside its polygon (or outside of it), in
    order; those along its border count as neither. All lines are cut together, in arrays."""
    first = np.cumsum(lines.sizes) - lines.sizes
    start = np.setdiff1d(np.arange(len(lines.points)), (first + lines.sizes - 1)[lines.sizes > 0], assume_unique=True)
    of = np.repeat(lines.of, lines.sizes)[start]
    a, b = lines.points[start], lines.points[start + 1]
    moves = (a != b).any(1)
    a, b, of = a[moves], b[moves], of[moves]
    d = b - a
    e = np.hstack([polygons.points, polygons.points[polygons.following()]])
    n = np.bincount(np.repeat(polygons.of, polygons.sizes), minlength=count)  # edges of each line's polygon
    begin = np.cumsum(n) - n
    at, hits, lower, upper, flat_of = [np.arange(len(a)).repeat(2)], [np.tile([0.0, 1.0], len(a))], [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for s in _shares(n[of], SHARE):
        k, edge = _runs(begin[of[s]], n[of[s]])
        k = k + s.start
        ex, ey, ox, oy = e[edge, 2] - e[edge, 0], e[edge, 3] - e[edge, 1], e[edge, 0] - a[k, 0], e[edge, 1] - a[k, 1]
        dx, dy = d[k, 0], d[k, 1]
        cross, away = dx * ey - dy * ex, ox * dy - oy * dx
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (ox * ey - oy * ex) / cross, away / cross
        hit = (cross != 0) & (u >= -TINY) & (u <= 1 + TINY) & (t > 0) & (t < 1)
        f = np.flatnonzero((cross == 0) & (np.abs(away) < TINY))
        long = dx[f] * dx[f] + dy[f] * dy[f]
        along = [((e[edge[f], c] - a[k[f], 0]) * dx[f] + (e[edge[f], c + 1] - a[k[f], 1]) * dy[f]) / long for c in (0, 2)]
        lower.append(np.minimum(*along))
        upper.append(np.maximum(*along))
        flat_of.append(k[f])
        at += [k[hit], *(k[f[(v > 0) & (v < 1)]] for v in along)]
        hits += [t[hit], *(v[(v > 0) & (v < 1)] for v in along)]
    at, cuts = np.concatenate(at), np.concatenate(hits)
    by = np.lexsort((cuts, at))
    at, cuts = at[by], cuts[by]
    kept = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(cuts) > TINY)])[: len(at)]
    at, cuts = at[kept], cuts[kept]
    cuts[np.append(np.diff(at) != 0, True)[: len(at)]] = 1.0  # the last one of a segment
    same = np.flatnonzero(np.diff(at) == 0)  # pieces: from a cut to the next one
    k, low, high = at[same], cuts[same], cuts[same + 1]
    middle = (low + high) / 2
    x, y = a[k, 0] + d[k, 0] * middle, a[k, 1] + d[k, 1] * middle
    odd = np.zeros(len(k), np.int64)
    for s in _shares(n[of[k]], SHARE):
        piece, edge = _runs(begin[of[k[s]]], n[of[k[s]]])
        piece = piece + s.start
        crosses = _odd(*e[edge].T, x[piece], y[piece])
        odd[s] = np.bincount(piece[crosses] - s.start, minlength=s.stop - s.start)
    wanted = (odd % 2 == 1) != outside
    lower, upper, flat_of = np.concatenate(lower), np.concatenate(upper), np.concatenate(flat_of)
    left, right = np.searchsorted(k, flat_of), np.searchsorted(k, flat_of, "right")
    border, piece = _runs(left, right - left)
    wanted[piece[(middle[piece] >= lower[border]) & (middle[piece] <= upper[border])]] = False
    follows = np.concatenate([[False], of[k[1:]] == of[k[:-1]]])[: len(k)] & np.concatenate([[False], wanted[:-1]])[: len(k)]
    new = (wanted & ~follows)[wanted]
    k, low, high = k[wanted], low[wanted], high[wanted]
    ends = np.where((high == 1.0)[:, None], b[k], a[k] + d[k] * high[:, None])
    points = np.stack([a[k] + d[k] * low[:, None], ends], 1)
    shown = np.stack([new, np.ones(len(k), bool)], 1)
    sizes = np.bincount(np.cumsum(new) - 1, shown.sum(1), int(new.sum())).astype(np.int64)
    return [of[k[new]], sizes, points[shown]]


def cut_line(line, rings, outside: bool = False) -> list[list[float]]:
    """The stretches of one line, as of many in `cut_lines`."""
    _, sizes, points = cut_lines(Rings.of_lists([[line or []]]), Rings.of_lists([rings]), 1, outside)
    return Rings(points, sizes, np.zeros(len(sizes), int)).lists()


def _rows(df: DataFrame, keys: list[str], inputs: list[str], kernel, column: str, kind: str, value: pa.DataType) -> DataFrame:
    """keys and `column`, kernel(*inputs) of each row where it isn't empty."""

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                made = [kernel(*row) for row in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                at = [k for k, m in enumerate(made) if m]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at, pa.int64())) for c in keys), pa.array([made[k] for k in at], value)], names=[*keys, column])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*dict.fromkeys([*keys, *inputs])).mapInArrow(run, f"{kinds}, {column} {kind}")


def intersect_lines(lines: DataFrame, polygons: DataFrame, size: float = 1.0, value=lambda lines: lines, name: str = "lines", keys: tuple[str, ...] | None = None) -> DataFrame:
    """id, id_b, properties and, as `name`, value(lines) of the stretches of each line inside each polygon it meets, one multi-line a pair.

    lines: id, line, box, properties; polygons: id, rings, box, properties. Properties of the polygon win; _id_a and _id_b are
    added. Lines that only touch a polygon, or run along its border, have no row. Equal lines are cut at equal polygons once, and
    `value`, a function of Columns, is computed once for them. With `keys` properties are a struct of the values of these instead of JSON.
    """

    def inside(line: pa.Array, rings: pa.Array) -> pa.Array:
        of, sizes, points = cut_lines(Rings.of_column(_listed(np.ones(len(line), np.int64), line)), Rings.of_column(rings), len(line))
        n = np.bincount(of, minlength=len(line))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), Rings(points, sizes, of).arrow(), mask=pa.array(n == 0))

    met = spatial_join(shaped(lines, "line", keys), shaped(polygons, "rings", keys), size, spread=True)
    met = met.withColumn(name, value(by_pair(inside, LINES)("line", "rings_b"))).where(F.col(name).isNotNull())
    return expanded(met, name, keys=keys)


def intersect_points(points: DataFrame, polygons: DataFrame, size: float = 1.0, keys: tuple[str, ...] | None = None) -> DataFrame:
    """id, id_b, properties, lon, lat: points in polygons, on the border included; equal polygons are tested once. `keys` as in `intersect_lines`."""
    each = named(points, "lon", "lat", keys=keys)
    dots = each.select("lon", "lat", "names", F.array(F.struct(*(c for c in each.columns if c not in ("lon", "lat", "names")))).alias("members"))
    held = points_in(dots, shaped(polygons, "rings", keys), size, spread=True).where(R.holds("rings_b", "lon", "lat"))
    return expanded(held, "lon", "lat", keys=keys)


def erase_lines(lines: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """id, lines: what polygons leave of each line, one polygon after the other; lines that meet none stay whole, those that are
    covered have no row. The polygons over one line are held together, so very long lines should be subdivided first."""
    box = ["minx", "miny", "maxx", "maxy"]
    met = spatial_join(lines.select("id", "line", *box), polygons.select("rings", *box), size)
    over = met.groupBy("id").agg(F.first("line").alias("line"), F.collect_set("rings_b").alias("every"))
    free = lines.where("line is not null").join(over.select("id"), "id", "left_anti").select("id", F.array("line").alias("lines"))

    def left(line, every):
        out = [line]
        for rings in every:
            out = [piece for one in out for piece in cut_line(one, rings, True)]
        return out

    return free.unionByName(_rows(over, ["id"], ["line", "every"], left, "lines", LINES, pa.list_(pa.list_(pa.float64()))))


def buffer_lines(df: DataFrame, distance: float, quarter: int = 16) -> DataFrame:
    """id, part_index, rings: lines (or, with one point, points) grown by `distance` degrees, with round ends: the union of the
    capsules around their segments, as polygons with holes."""
    if distance <= 0:
        raise ValueError("the distance must be positive")

    def grow(line):
        p = [tuple(q) for q in np.asarray(line or [], float).reshape(-1, 2).tolist()]
        p = [q for k, q in enumerate(p) if k == 0 or q != p[k - 1]]
        if len(p) < 3:
            return [[around(p, distance, quarter)]] if p else []
        return assemble(overlay([(0, [around([a, b], distance, quarter)]) for a, b in zip(p, p[1:], strict=False)], lambda n: n[0] > 0))

    made = _rows(df, ["id"], ["line"], grow, "polygons", f"array<{RINGS}>", pa.list_(pa.list_(pa.list_(pa.float64()))))
    return made.select("id", F.posexplode("polygons").alias("part_index", "rings"))


def explode_parts(df: DataFrame) -> DataFrame:
    """A row for each simple part of features with `parts` (array of structs): the part's fields, `_parent_id` and `_part_index`
    in place of `parts`; other columns stay. Features without parts have none."""
    own = [c for c in df.columns if c not in ("parts", "id")]
    out = df.select(F.col("id").alias("_parent_id"), *own, F.posexplode("parts").alias("_part_index", "_part"))
    fields = [f.name for f in df.schema["parts"].dataType.elementType.fields]
    name = F.concat_ws("_", F.col("_parent_id"), F.col("_part_index"))
    return out.select(name.alias("id"), "_parent_id", "_part_index", *(F.col(f"_part.{f}").alias(f) for f in fields), *own)
