"""Overlays of general polygons: intersection, erase, dissolve, repair, buffer and subdivision.

Spark finds the pairs and deals polygons to grid cells; a small kernel handles one pair, or one cell of one feature, at a time. Results are parts that
don't overlap (trapezoids between vertical cuts), as feature rows are parts anyway. Cells tile the plane, so a large union needs no
last step that holds all of it. Polygons follow the even-odd rule, so invalid rings are repaired as they pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .spatial import BOX, by_shape, spatial_join, to_cells

RINGS = "array<array<double>>"
TINY = 1e-12
#: Polygons that one kernel call of a union takes before it is split by salt.
GROUP = 256
#: Rows of a batch that a kernel works on together, and pairs of edges, or of edges and cuts, that it holds at a time.
ROWS, SHARE = 2048, 1 << 21


class Rings:
    """Rings of many polygons as flat arrays: points (n, 2), the number of points of each ring and the polygon it belongs to."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, of: np.ndarray):
        self.points, self.sizes, self.of = points, sizes, of

    @staticmethod
    def of_column(column) -> Rings:
        """Of an Arrow column of polygons; null: no rings."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        rings = column.flatten()
        of = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        return Rings(rings.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, 2), sizes, of)

    @staticmethod
    def of_lists(polygons) -> Rings:
        every = [(k, np.asarray(r, float).reshape(-1, 2)) for k, rings in enumerate(polygons) for r in rings or []]
        points = np.concatenate([np.zeros((0, 2)), *(p for _, p in every)])
        return Rings(points, np.array([len(p) for _, p in every], np.int64), np.array([k for k, _ in every], np.int64))

    def following(self) -> np.ndarray:
        """The index of the point after each one; the first one's after a ring's last."""
        after = np.arange(1, len(self.points) + 1)
        ends = np.cumsum(self.sizes)[self.sizes > 0]
        after[ends - 1] = ends - self.sizes[self.sizes > 0]
        return after

    def taken(self, which: np.ndarray) -> Rings:
        """The rings of these polygons, which become the polygons 0, 1, ...; rings stand in order of their polygons."""
        n = np.bincount(self.of, minlength=int(which.max(initial=-1)) + 1)
        of, ring = _runs((np.cumsum(n) - n)[which], n[which])
        return Rings(self.points[_runs((np.cumsum(self.sizes) - self.sizes)[ring], self.sizes[ring])[1]], self.sizes[ring], of)

    def lists(self) -> list[list[float]]:
        ends = np.cumsum(self.sizes)
        return [self.points[e - n : e].ravel().tolist() for e, n in zip(ends, self.sizes, strict=True)]

    def arrow(self) -> pa.ListArray:
        """The rings as an Arrow array of flat lists."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * self.sizes)]), pa.int32()), pa.array(self.points.ravel()))


def joined(every: list[Rings], polygons: list[int]) -> Rings:
    """All rings; each one's polygons are numbered behind those of the ones before it, of which there are `polygons` each."""
    shift = np.cumsum([0, *polygons])
    points, sizes, of = [np.zeros((0, 2))], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, r in enumerate(every):
        points.append(r.points)
        sizes.append(r.sizes)
        of.append(r.of + shift[k])
    return Rings(np.concatenate(points), np.concatenate(sizes), np.concatenate(of))


def _runs(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, value) of the runs first[k], first[k] + 1, ... of n[k] values each."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _shares(weights: np.ndarray, most: int):
    """Slices of consecutive items of about `most` weight each; an item alone may weigh more."""
    at, total = 0, np.cumsum(weights)
    while at < len(weights):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def _kept(keep, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """keep((n0, n1)) of each item, asked once for each pair of counts."""
    wide = int(n1.max(initial=0)) + 1
    pairs, at = np.unique(n0 * wide + n1, return_inverse=True)
    return np.array([bool(keep([int(p // wide), int(p % wide)])) for p in pairs], bool)[at]


def overlays(rings: Rings, job: np.ndarray, side: np.ndarray, keep) -> tuple[np.ndarray, Rings]:
    """(job of each part, parts): for every job the region where keep(n) holds; n[s] counts the job's polygons of side s at a point.

    job and side: of each polygon; jobs in order. All jobs are worked on together, in arrays; a job alone gives the same parts.
    """
    after, owner = rings.following(), np.repeat(rings.of, rings.sizes)
    e = np.hstack([rings.points, rings.points[after]])
    e = np.where((e[:, 0] <= e[:, 2])[:, None], e, e[:, [2, 3, 0, 1]])
    sloped = e[:, 0] < e[:, 2]
    e, owner = e[sloped], owner[sloped]
    of = job[owner]
    order = np.argsort(of, kind="stable")
    e, owner, of = e[order], owner[order], of[order]
    x1, y1, x2, slope = e[:, 0], e[:, 1], e[:, 2], (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    # crossings: edges by their left ends, each with those that begin before it ends
    values, jobs = np.concatenate([x1, x2]), np.concatenate([of, of])
    by = np.lexsort((values, jobs))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.concatenate([[False], (np.diff(values[by]) != 0) | (np.diff(jobs[by]) != 0)])[: len(by)])
    begin, end = rank[: len(e)], rank[len(e) :]
    by_left = np.argsort(begin, kind="stable")
    bent = np.zeros(int(of.max(initial=-1)) + 1, bool)
    bent[of[slope != 0]] = True
    later = np.where(bent[of[by_left]], np.searchsorted(begin[by_left], end[by_left]) - np.arange(1, len(e) + 1), 0)
    cuts, cut_of = [x1, x2], [of, of]
    for s in _shares(later, SHARE):
        i, j = _runs(np.arange(s.start + 1, s.stop + 1), later[s])
        i, j = by_left[i + s.start], by_left[j]
        i, j = np.minimum(i, j), np.maximum(i, j)
        lo, hi = np.maximum(x1[i], x1[j]), np.minimum(x2[i], x2[j])
        a, b = (y1[i] + slope[i] * (x - x1[i]) - y1[j] - slope[j] * (x - x1[j]) for x in (lo, hi))
        hit = np.flatnonzero((lo < hi) & (a * b < 0))
        cuts.append(lo[hit] + (hi - lo)[hit] * a[hit] / (a[hit] - b[hit]))
        cut_of.append(of[i[hit]])
    values, jobs = np.concatenate(cuts), np.concatenate(cut_of)
    by = np.lexsort((values, jobs))
    new = np.concatenate([[True], (np.diff(values[by]) != 0) | (np.diff(jobs[by]) != 0)])[: len(by)]
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new) - 1
    at, at_of = values[by][new], jobs[by][new]
    wide = np.append((np.diff(at) >= TINY) & (np.diff(at_of) == 0), False)[: len(at)]
    before = np.concatenate([[0], np.cumsum(wide)])
    left, right, slab_of = at[wide], np.append(at[1:], 0)[: len(at)][wide], at_of[wide]
    first, past = before[place[: len(e)]], before[place[len(e) : 2 * len(e)]]  # slabs that an edge spans
    load = np.cumsum(np.bincount(first, minlength=len(left) + 1) - np.bincount(past, minlength=len(left) + 1))[: len(left)]
    spans = [np.zeros((3, 0), np.int64)]
    for s in _shares(load, SHARE):
        some = np.flatnonzero((first < s.stop) & (past > s.start))
        low, high = np.maximum(first[some], s.start), np.minimum(past[some], s.stop)
        k, slab = _runs(low, high - low)
        k = some[k]
        middle = y1[k] + slope[k] * ((left[slab] + right[slab]) / 2 - x1[k])
        by = np.lexsort((middle, slab))
        k, slab, middle = k[by], slab[by], middle[by]
        spans.append(_spans(k, slab, middle, owner[k], side[owner[k]], keep))
    slab, low, high = np.concatenate(spans, 1)
    # spans between the same edges that follow each other are one part
    by = np.lexsort((slab, high, low))
    slab, low, high = slab[by], low[by], high[by]
    new = np.concatenate([[True], (np.diff(low) != 0) | (np.diff(high) != 0) | (np.diff(slab) != 1)])[: len(by)]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(by))[: len(starts)] - 1
    starts, ends = (v[np.argsort(by[ends])] for v in (starts, ends))  # as they end, from below
    a, b, low, high = left[slab[starts]], right[slab[ends]], low[starts], high[starts]
    height = lambda k, x: y1[k] + slope[k] * (x - x1[k])
    p = np.stack([a, height(low, a), b, height(low, b), b, height(high, b), a, height(high, a)], 1).reshape(-1, 4, 2)
    differs = (p != np.roll(p, 1, 1)).any(2)
    closing = np.where(differs[:, :1], p[:, 0], p[:, 1])[:, None]
    shown = np.hstack([differs, np.ones((len(p), 1), bool)])
    return slab_of[slab[starts]], Rings(np.concatenate([p, closing], 1)[shown], shown.sum(1), np.arange(len(p)))


def _spans(edge, slab, middle, owner, side, keep) -> np.ndarray:
    """(slab, lower edge, upper edge) of the stretches to keep, slab by slab from below. The edges of a slab come in order."""
    by = np.lexsort((owner, slab))
    own = np.concatenate([[True], (np.diff(owner[by]) != 0) | (np.diff(slab[by]) != 0)])[: len(by)]
    turn = np.empty(len(by), np.int64)
    turn[by] = np.arange(len(by)) - np.flatnonzero(own)[np.cumsum(own) - 1]
    step = 1 - 2 * (turn % 2)
    lowest = np.concatenate([[True], np.diff(slab) != 0])[: len(slab)]
    bottom = np.flatnonzero(lowest)[np.cumsum(lowest) - 1]
    count = lambda d: (c := np.cumsum(d)) - (c - d)[bottom]
    now = _kept(keep, count(np.where(side == 0, step, 0)), count(np.where(side == 1, step, 0)))
    was = np.concatenate([[False], now[:-1]])[: len(now)] & ~lowest
    events = np.flatnonzero(now != was)
    ends = np.flatnonzero(~now[events])
    low, high = events[ends - 1], events[ends]
    thick = middle[high] - middle[low] > TINY
    low, high = low[thick], high[thick]
    apart = np.concatenate([[True], (slab[low[1:]] != slab[high[:-1]]) | (middle[low[1:]] - middle[high[:-1]] >= TINY)])[: len(low)]
    last = np.append(apart[1:], True)[: len(low)]
    low, high = low[apart], high[last]
    return np.stack([slab[low], edge[low], edge[high]])


def overlay(shapes, keep) -> list[list[float]]:
    """Rings of the region where keep(n) holds; n[s] counts the polygons of side s at a point. shapes: (side, rings)."""
    shapes = list(shapes)
    return overlays(Rings.of_lists([r for _, r in shapes]), np.zeros(len(shapes), np.int64), np.array([s for s, _ in shapes], np.int64), keep)[1].lists()


def clips(rings: Rings, boxes: np.ndarray) -> tuple[np.ndarray, Rings]:
    """(ring each came from, rings) cut at their boxes (x1, y1, x2, y2 of each ring); those with under 3 points left are dropped."""
    points, sizes = rings.points, rings.sizes
    for axis, bound, sign in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        cut = Rings(points, sizes, rings.of)
        other, at = points[cut.following()], np.repeat(boxes[:, bound], sizes)
        da, db = sign * (points[:, axis] - at), sign * (other[:, axis] - at)
        stays, crosses = da >= 0, da * db < 0
        n = stays.astype(np.int64) + crosses
        place = np.cumsum(n) - n
        made = np.empty((int(n.sum()), 2))
        made[place[stays]] = points[stays]
        c = np.flatnonzero(crosses)
        spot = place[c] + stays[c]
        made[spot, axis] = at[c]
        made[spot, 1 - axis] = points[c, 1 - axis] + (other[c, 1 - axis] - points[c, 1 - axis]) * da[c] / (da[c] - db[c])
        total = np.concatenate([[0], np.cumsum(n)])
        past = np.cumsum(sizes)
        points, sizes = made, total[past] - total[past - sizes]
    whole = sizes >= 3
    return np.flatnonzero(whole), Rings(points[np.repeat(whole, sizes)], sizes[whole], rings.of[whole])


def clip(rings, x1: float, y1: float, x2: float, y2: float) -> list[list[float]]:
    """Rings cut at a box; edges along its border may run twice, which the even-odd rule ignores."""
    every = Rings.of_lists([rings])
    return clips(every, np.tile([float(x1), float(y1), float(x2), float(y2)], (len(every.sizes), 1)))[1].lists()


def _listed(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _numbered(of: np.ndarray) -> np.ndarray:
    """The place of each item among the items of its owner; `of` is in order."""
    first = np.concatenate([[True], np.diff(of) != 0])[: len(of)]
    return np.arange(len(of)) - np.flatnonzero(first)[np.cumsum(first) - 1]


def _batched(df: DataFrame, keys: list[str], inputs: list[str], kernel) -> DataFrame:
    """keys, part_index and rings by kernel(*inputs): Arrow columns of many rows to (row of each part, in order; parts as an array of polygons)."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                at, rings = kernel(*(part.column(c) for c in inputs))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at)) for c in keys), pa.array(_numbered(at), pa.int32()), rings], names=[*keys, "part_index", "rings"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (df.schema[k] for k in keys))
    return df.select(*dict.fromkeys([*keys, *inputs])).mapInArrow(run, f"{schema}, part_index int, rings {RINGS}")


def _overlaid(columns, keep, made) -> tuple[np.ndarray, pa.Array]:
    """A kernel for _batched: the overlay of each row's polygons, of which the k-th column's are side k; `made` as in intersection."""
    every = [Rings.of_column(c) for c in columns]
    n = len(columns[0])
    of, parts = overlays(joined(every, [n] * len(every)), np.tile(np.arange(n), len(every)), np.repeat(np.arange(len(every)), n), keep)
    if made is apart:
        return of, _listed(np.ones(len(of), np.int64), parts.arrow())
    starts = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0])[: len(of)])
    lists = parts.lists()
    polygons = [made(lists[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=False)]
    at = np.repeat(of[starts], [len(p) for p in polygons])
    return at, pa.array([p for some in polygons for p in some], pa.list_(pa.list_(pa.float64())))


def _rowwise(df: DataFrame, keys: list[str], inputs: list[str], kernel) -> DataFrame:
    """keys, part_index and rings of kernel(*inputs), a list of polygons for each row."""
    fields = [df.schema[k] for k in keys]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                made = [kernel(*row) for row in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                at = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
                number = pa.array([i for m in made for i in range(len(m))], pa.int32())
                rings = pa.array([p for m in made for p in m], pa.list_(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in keys), number, rings], names=[*keys, "part_index", "rings"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.select(*dict.fromkeys([*keys, *inputs])).mapInArrow(run, f"{schema}, part_index int, rings {RINGS}")


def with_box(df: DataFrame) -> DataFrame:
    return df.withColumns(G.bounds(F.col("rings")))


def _bare(json: Column) -> Column:
    """The text of a JSON object or array without its brackets."""
    return F.substr(json, F.lit(2), F.length(json) - 2)


#: Keys that pairs have.
IDS = ("_id_a", "_id_b")


def named(df: DataFrame, *more: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """id, names (keys of the properties), properties, quoted (the id as JSON) and the columns `more`. Each row's text is parsed once,
    before it is joined. Properties are JSON text without brackets, a comma behind it, or with `keys` a struct of the values of these."""
    read = [k for k in keys or () if k not in IDS]
    if keys is not None and not read:
        return df.select("id", F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("string").alias("properties"), F.lit(None).cast("string").alias("quoted"), *more)
    parsed = F.coalesce(F.from_json("properties", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    out = df.select("id", parsed.alias("_map"), *more)
    if keys is not None:
        have = F.filter(F.map_keys("_map"), lambda k: k.isin(*read))
        return out.select("id", F.sort_array(have).alias("names"), F.struct(*(F.try_element_at("_map", F.lit(k)).alias(k) for k in read)).alias("properties"), F.lit(None).cast("string").alias("quoted"), *more)
    rest = F.map_filter("_map", lambda k, _: ~k.isin(*IDS))
    text = _bare(F.to_json(rest))
    behind = F.when(text != "", F.concat(text, F.lit(","))).otherwise("")
    return out.select("id", F.map_keys(rest).alias("names"), behind.alias("properties"), _bare(F.to_json(F.array("id"))).alias("quoted"), *more)


def shaped(df: DataFrame, geometry: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Rows by equal `geometry`, box and names of their properties, for `expanded`."""
    return by_shape(named(df, geometry, *BOX, keys=keys), geometry, ("names",))


def expanded(met: DataFrame, *columns: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """id, id_b, properties and `columns` for each pair of `members` and `members_b` of a row, whose names are `names` and `names_b`.

    Properties are JSON, put together of its parts; those of b win over those of a, and _id_a and _id_b are added. With `keys` (the same
    as in `shaped`) they are a struct of the values of these, and no text is made.
    """
    own = F.array_except("names", "names_b")
    each = met.select(*columns, "members_b", own.alias("_own"), F.explode("members").alias("_a"))
    a, b = (lambda c: F.col(f"_a.{c}")), (lambda c: F.col(f"_b.{c}"))
    if keys is not None:
        each = each.select(*columns, "_own", "_a", F.explode("members_b").alias("_b"))
        ids = dict(zip(IDS, (a("id"), b("id")), strict=True))
        value = lambda k: ids[k] if k in ids else F.when(F.array_contains("_own", k), a(f"properties.{k}")).otherwise(b(f"properties.{k}"))
        values = F.struct(*(value(k).cast("string").alias(k) for k in keys)) if keys else F.lit(None)
        return each.select(a("id").alias("id"), b("id").alias("id_b"), values.alias("properties"), *columns)
    kept = F.map_filter(F.from_json(F.concat(F.lit("{"), F.rtrim(a("properties"), F.lit(",")), F.lit("}")), "map<string,string>"), lambda k, _: F.array_contains("_own", k))
    before = F.when(F.size("_own") > 0, F.concat(F.lit("{"), _bare(F.to_json(kept)), F.lit(","))).otherwise("{")
    ids = F.concat(F.lit('"_id_a":'), a("quoted"), F.lit(',"_id_b":'))
    each = each.select(*columns, a("id").alias("id"), before.alias("_before"), ids.alias("_ids"), F.explode("members_b").alias("_b"))
    text = F.concat("_before", b("properties"), "_ids", b("quoted"), F.lit("}"))
    return each.select("id", b("id").alias("id_b"), text.alias("properties"), *columns)


def by_pair(kernel, kind: str):
    """kernel(a, b) of two Arrow columns as a function of two Columns, ROWS rows at a time. It is marked so that Spark doesn't move
    it, as it would then compute it twice."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.concat_arrays([kernel(a.slice(k, ROWS), b.slice(k, ROWS)) for k in range(0, max(len(a), 1), ROWS)])

    return F.arrow_udf(run, kind).asNondeterministic()


def apart(rings: list[list[float]]) -> list[list[list[float]]]:
    """Parts as they are, a row each; `outlines.assemble` makes polygons with holes of them instead."""
    return [[r] for r in rings]


def intersections(a: DataFrame, b: DataFrame, size: float = 1.0, made=apart, value=lambda polygons: polygons, keys: tuple[str, ...] | None = None) -> DataFrame:
    """id, id_b, properties (those of b win; _id_a and _id_b are added) and value(polygons) of each pair that meets.

    a and b: id, rings, box and properties. Pairs that only touch have no row. `made` is what parts become, here and below. Pairs of
    equal polygons are overlaid once, and `value`, a function of Columns, is computed once for them. With `keys` properties are a struct
    of the values of these instead of JSON.
    """

    def common(x: pa.Array, y: pa.Array) -> pa.Array:
        at, rings = _overlaid([x, y], all, made)
        n = np.bincount(at, minlength=len(x))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), rings, mask=pa.array(n == 0))

    met = spatial_join(shaped(a, "rings", keys), shaped(b, "rings", keys), size, spread=True)
    met = met.withColumn("value", value(by_pair(common, f"array<{RINGS}>")("rings", "rings_b"))).where("value is not null")
    return expanded(met, "value", keys=keys)


def intersection(a: DataFrame, b: DataFrame, size: float = 1.0, made=apart) -> DataFrame:
    """Parts of a that meet b: id, id_b, properties, part_index, rings; see `intersections`."""
    return intersections(a, b, size, made).select("id", "id_b", "properties", F.posexplode("value").alias("part_index", "rings"))


def erase(a: DataFrame, b: DataFrame, size: float = 1.0) -> DataFrame:
    """What b leaves of a: id, cx, cy, part_index, rings. Features that meet nothing of b keep their rings (cx, cy null).

    A feature is worked on cell by cell; equal pieces of b in a cell count once.
    """
    own = to_cells(a.select("id", "rings", "minx", "miny", "maxx", "maxy"), size)
    other = to_cells(b.select(F.col("rings").alias("rings_b"), "minx", "miny", "maxx", "maxy"), size)
    other = other.select("cx", "cy", "rings_b", *(F.col(c).alias(f"{c}_b") for c in ("minx", "miny", "maxx", "maxy"))).dropDuplicates(["cx", "cy", "rings_b"])
    meets = F.expr("minx < maxx_b and minx_b < maxx and miny < maxy_b and miny_b < maxy")
    pairs = own.join(other, ["cx", "cy"]).where(meets)
    touched = pairs.select("id").distinct()
    alone = a.select("id", "rings").join(touched, "id", "left_anti")
    cells = own.join(touched, "id", "left_semi").select("id", "cx", "cy", "rings", F.lit(0).alias("side"))
    pieces = cells.union(pairs.select("id", "cx", "cy", F.col("rings_b").alias("rings"), F.lit(1).alias("side")))
    cut = _by_cell(pieces, ["id"], size, lambda n: n[0] > 0 and n[1] == 0)
    return alone.select("id", F.lit(None).cast("int").alias("cx"), F.lit(None).cast("int").alias("cy"), F.lit(0).alias("part_index"), "rings").union(cut)


def _by_cell(pieces: DataFrame, keys: list[str], size: float, keep) -> DataFrame:
    """keys, cx, cy, part_index, rings of the overlay of each cell's pieces(keys, cx, cy, rings, side)."""
    head = [*keys, "cx", "cy"]
    names = [*head, "part_index", "rings"]

    def united(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        job = np.repeat(np.arange(len(starts)), np.diff([*starts, table.num_rows]))
        rings = Rings.of_column(table.column("rings"))
        x, y = (table.column(c).to_numpy()[rings.of].astype(float) for c in ("cx", "cy"))
        _, cut = clips(rings, np.stack([x * size, y * size, (x + 1) * size, (y + 1) * size], 1))
        of, made = overlays(cut, job, table.column("side").to_numpy().astype(np.int64), keep)
        first = pa.array(starts[of])
        columns = [table.column(c).combine_chunks().take(first) for c in head]
        return pa.RecordBatch.from_arrays([*columns, pa.array(_numbered(of), pa.int32()), _listed(np.ones(len(of), np.int64), made.arrow())], names=names)

    def run(batches):
        waiting: list[pa.RecordBatch] = []  # rows since the last group's first one
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting:
                ends = pa.Table.from_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch.slice(0, 1)])
                fresh = len(_starts(ends, head)) == 2
            inner = _starts(pa.Table.from_batches([batch]), head)
            last = int(inner[-1])
            if waiting and (fresh or last):
                table = pa.Table.from_batches([*waiting, batch.slice(0, last)])
                yield from (united(*some) for some in _groups(table, _starts(table, head)))
                waiting = []
            elif last:
                table = pa.Table.from_batches([batch.slice(0, last)])
                yield from (united(*some) for some in _groups(table, inner[:-1]))
            waiting.append(batch.slice(last))
        if waiting:
            table = pa.Table.from_batches(waiting)
            yield from (united(*some) for some in _groups(table, _starts(table, head)))

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in head)
    return pieces.select(*head, "rings", "side").repartition(*head).sortWithinPartitions(*head).mapInArrow(run, f"{schema}, part_index int, rings {RINGS}")


def _starts(table: pa.Table, head: list[str]) -> np.ndarray:
    """Where the rows of another group begin, in a table in order of `head`; null is a value."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in head:
        column = table.column(c).combine_chunks()
        a, b = column[:-1], column[1:]
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.concatenate([[0], np.flatnonzero(new) + 1])[: max(table.num_rows, 0)]


def _groups(table: pa.Table, starts: np.ndarray):
    """(rows, starts in them) of some groups at a time, of about ROWS rows or one group."""
    ends = np.append(starts[1:], table.num_rows)
    for s in _shares(ends - starts, ROWS):
        first = int(starts[s.start])
        yield table.slice(first, int(ends[s.stop - 1]) - first), starts[s] - first


def _uncovered(named: DataFrame) -> DataFrame:
    """key, rings and box of the polygons; of boxes of a key with the same left side only the widest, as it covers the others."""
    box = (F.col("rings") == G.box_rings(*BOX)) & (F.col("minx") <= F.col("maxx")) & (F.col("maxx") - F.col("minx") < float("inf"))
    shape = F.when(~F.coalesce(box, F.lit(False)), F.col("rings")).alias("shape")  # null: the box itself
    each = named.where("rings is not null").select("key", *BOX, shape).groupBy("key", "minx", "miny", "maxy", "shape").agg(F.max("maxx").alias("maxx"))
    return each.select("key", F.coalesce("shape", G.box_rings(*BOX)).alias("rings"), *BOX)


def dissolve(df: DataFrame, key: Column | None = None, size: float = 1.0) -> DataFrame:
    """The union of all polygons of a key (null: empty text; no key: all): key, cx, cy, part_index, rings.

    Copies, and boxes that a wider one with the same left side covers, are dropped before anything is dealt to cells. Cells of a
    key with more than GROUP different polygons are first united in several tasks.
    """
    named = df.withColumn("key", F.lit("_all") if key is None else F.coalesce(key.cast("string"), F.lit("")))
    pieces = to_cells(_uncovered(named), size).select("key", "cx", "cy", "rings").dropDuplicates()
    counts = pieces.groupBy("key", "cx", "cy").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("n"))
    crowded = pieces.join(counts.where("n > 1"), ["key", "cx", "cy"])
    salted = crowded.withColumn("salt", F.pmod(F.xxhash64("rings"), F.col("n")).cast("int")).withColumn("side", F.lit(0))
    united = _by_cell(salted, ["key", "salt"], size, lambda n: n[0] > 0).select("key", "cx", "cy", "rings")
    rest = pieces.join(counts.where("n > 1"), ["key", "cx", "cy"], "left_anti").select("key", "cx", "cy", "rings")
    return _by_cell(rest.union(united).withColumn("side", F.lit(0)), ["key"], size, lambda n: n[0] > 0)


def make_valid(df: DataFrame, made=apart) -> DataFrame:
    """id, part_index, rings without self-intersections."""
    return _batched(df, ["id"], ["rings"], lambda c: _overlaid([c], lambda n: n[0] > 0, made))


def simple_parts(df: DataFrame) -> DataFrame:
    """id, part_index, rings: valid simple parts of polygons (array of rings each), numbered through."""

    def parts(column):
        of = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        at, rings = _overlaid([column.flatten()], lambda n: n[0] > 0, apart)
        return of[at], rings

    return _batched(df, ["id"], ["polygons"], parts)


def subdivide(df: DataFrame, max_points: int = 256) -> DataFrame:
    """id, part_index, rings: halved along the longer side until a part has at most `max_points` points."""
    held = max(max_points, 8)

    def halved(column):
        """All parts with too many points at a time; two halves stand in the place of their whole."""
        rings, row, rank = Rings.of_column(column), np.arange(len(column)), np.arange(len(column))
        total, done = len(row), []  # done: rank, row, rings
        while len(row):
            some = np.flatnonzero(np.bincount(rings.of, minlength=len(row)))
            rings, row, rank = rings.taken(some), row[some], rank[some]
            at, low, high = np.repeat(rings.of, rings.sizes), np.full((len(row), 2), np.inf), np.full((len(row), 2), -np.inf)
            np.minimum.at(low, at, rings.points)
            np.maximum.at(high, at, rings.points)
            cut = (np.bincount(at, minlength=len(row)) > held) & ~((high - low).max(1, initial=0) < TINY)
            done.append([rank[~cut], row[~cut], rings.taken(np.flatnonzero(~cut))])
            copies = np.ones(total, np.int64)
            copies[rank[cut]] = 2
            place, total = np.cumsum(copies) - copies, int(copies.sum())
            for d in done:
                d[0] = place[d[0]]
            both = np.repeat(np.flatnonzero(cut), 2)
            second, x = np.tile([False, True], int(cut.sum())), (high - low)[both, 0] >= (high - low)[both, 1]
            rank, row, low, high = place[rank[both]] + second, row[both], low[both], high[both]
            middle = (low + high) / 2
            for k, of in ((0, x), (1, ~x)):
                low[:, k], high[:, k] = np.where(of & second, middle[:, k], low[:, k]), np.where(of & ~second, middle[:, k], high[:, k])
            rings = rings.taken(both)
            rings = clips(rings, np.hstack([low, high])[rings.of])[1]
        order = np.argsort(np.concatenate([d[0] for d in done])) if done else np.zeros(0, int)
        every = joined([d[2] for d in done], [len(d[1]) for d in done]).taken(order)
        at = np.concatenate([np.zeros(0, int), *(d[1] for d in done)])[order]
        return at, _listed(np.bincount(every.of, minlength=len(at)), every.arrow())

    return _batched(df, ["id"], ["rings"], halved)


def around(points, distance: float, quarter: int = 16) -> list[float]:
    """Sum of a convex ring, counter-clockwise, and the circle: arcs at the corners. One point: a circle; two: a capsule."""
    if len(points) == 1:
        (x, y), n = points[0], 4 * quarter
        return [v for k in (*range(n), 0) for v in (x + distance * math.cos(2 * math.pi * k / n), y + distance * math.sin(2 * math.pi * k / n))]
    out = []
    for k, (x, y) in enumerate(points):
        (px, py), (nx, ny) = points[k - 1], points[(k + 1) % len(points)]
        start, end = math.atan2(px - x, y - py), math.atan2(x - nx, ny - y)
        turn = (end - start) % (2 * math.pi)
        steps = max(1, math.ceil(turn / (math.pi / 2) * quarter - 1e-9))
        out += [v for s in range(steps + 1) for v in (x + distance * math.cos(start + turn * s / steps), y + distance * math.sin(start + turn * s / steps))]
    return [*out, *out[:2]]


def buffer(df: DataFrame, distance: float, quarter: int = 16, made=apart) -> DataFrame:
    """id, part_index, rings grown by `distance` degrees with round corners of `quarter` segments to a right angle.

    A convex polygon stays one part; others are the union of themselves and of their edges' surroundings.
    """
    if distance <= 0:
        raise ValueError("the distance must be positive")

    def grow(rings):
        shells = [[tuple(q) for q in np.asarray(r, float).reshape(-1, 2).tolist()] for r in rings or []]
        shells = [[q for k, q in enumerate(s) if q != s[k - 1]] for s in shells]
        if not any(len(s) > 2 for s in shells):
            return []
        turns = []
        for (ax, ay), (bx, by), (cx, cy) in zip(shells[0], shells[0][1:] + shells[0][:1], shells[0][2:] + shells[0][:2], strict=True):
            ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
            turns.append(math.atan2(ux * vy - uy * vx, ux * vx + uy * vy))
        left = min(turns) >= 0
        if len(shells) == 1 and (left or max(turns) <= 0) and abs(abs(sum(turns)) - 2 * math.pi) < 1e-6:
            return [[around(shells[0] if left else shells[0][::-1], distance, quarter)]]
        capsules = [(0, [around([a, b], distance, quarter)]) for s in shells for a, b in zip(s, s[1:] + s[:1], strict=True)]
        return made(overlay([(0, rings), *capsules], lambda n: n[0] > 0))

    return _rowwise(df, ["id"], ["rings"], grow)


def split_by_type(df: DataFrame) -> DataFrame:
    """id, output (polygons, lines, points) and its parts, from parts(kind, coordinates)."""
    kinds = {"polygons": "Polygon", "lines": "LineString", "points": "Point"}
    of = lambda kind: F.filter("parts", lambda p: p["kind"] == kind)
    each = F.array(*(F.struct(F.lit(out).alias("output"), of(kind).alias("parts")) for out, kind in kinds.items()))
    return df.select("id", F.explode(F.filter(each, lambda o: F.size(o["parts"]) > 0)).alias("o")).select("id", "o.output", "o.parts")


def size_guard(df: DataFrame, limit: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by the length of the polygon's WKB; a limit of 0 or less keeps all."""
    if limit <= 0:
        return df, df.where("false")
    big = F.coalesce(G.wkb_bytes(F.col("rings")) > limit, F.lit(False))
    return df.where(~big), df.where(big)
