"""Polygons with holes out of the parts that overlays leave.

Overlays give parts that tile a region: trapezoids between vertical cuts, cell by cell. Where two parts lie side by side, their
edges run in opposite directions and cancel; what is left is the region's outline. Edges that can have a counterpart lie on
vertical lines or on the borders of cells; they are counted along their line within a cell by a Spark aggregate. The rest is
chained to rings: first within each cell, then within blocks of FAN x FAN cells, of FAN x FAN blocks and so on, where each
step only sees chains that cross a border of the step before, without their points. Rings that go around a hole are given to
the smallest outer ring around them by a spatial join. So no task holds a whole region; a task holds one cell's edges, or one
polygon, which is a row of the result.

Coordinates are taken to a grid of 1e-9 degrees, where all of this is exact in integers. Polygons that meet at a point stay
apart, and a hole may touch its outer ring at points.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from .overlay import dissolve, erase
from .paging import page_features
from .shared import stored
from .spatial import _met

GRID = 1_000_000_000
#: Blocks in a row of the next larger block, and an offset that lets no border of cells near 0 be one of large blocks too.
FAN, OFFSET = 8, int("4" * 9, 8)
RINGS = "array<array<double>>"
ENDS = ("x1", "y1", "x2", "y2", "fx", "fy", "lx", "ly")  # first and last point, second and last but one


def _angle(at: tuple, to: tuple) -> float:
    return math.atan2(to[1] - at[1], to[0] - at[0])


def link(starts: list, ends: list, seconds: list, before: list, is_open: Callable[[tuple], bool]) -> list[tuple[bool, list[int]]]:
    """(closed, items in order) of the chains that items with these ends form; at open points nothing is joined.

    Where several chains meet at a point, one goes on with the first that leaves clockwise from where it came: that keeps the
    inside, on its left, in one corner, so regions that only share the point stay apart.
    """
    leaving, coming = defaultdict(list), defaultdict(list)
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        leaving[a].append(k)
        coming[b].append(k)
    after: dict[int, int] = {}
    for at, out in leaving.items():
        into = coming.get(at, ())
        if not into or is_open(at):
            continue
        if len(out) == len(into) == 1:
            after[into[0]] = out[0]
            continue
        rays = sorted([(-_angle(at, before[k]), 0, k) for k in into] + [(-_angle(at, seconds[k]), 1, k) for k in out])
        used = set()
        for place, (_, kind, k) in enumerate(rays):
            if kind == 0:
                free = next((o for _, leaves, o in rays[place + 1 :] + rays[:place] if leaves and o not in used), None)
                if free is not None:
                    after[k] = free
                    used.add(free)
    chains, seen, inner = [], set(), set(after.values())
    for closed, firsts in ((False, (k for k in range(len(starts)) if k not in inner)), (True, range(len(starts)))):
        for k in firsts:
            if k not in seen:
                chain = []
                while k is not None and k not in seen:
                    seen.add(k)
                    chain.append(k)
                    k = after.get(k)
                chains.append((closed, chain))
    return chains


def loops(points: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """A closed walk as loops that visit no point twice, without points on straight lines and without slivers of the grid's width."""
    out, path, place = [], [], {}
    for p in [*points, points[0]]:
        if p in place:
            first = place[p]
            out.append(path[first:])
            for q in path[first + 1 :]:
                place.pop(q, None)
            del path[first + 1 :]
        else:
            place[p] = len(path)
            path.append(p)
    good = []
    for loop in out:
        kept: list = []
        n = len(loop)
        start = min(range(n), key=loop.__getitem__)  # a corner
        for k in range(n):
            p = loop[(start + k) % n]
            while len(kept) >= 2 and _straight(kept[-2], kept[-1], p):
                kept.pop()
            kept.append(p)
        while len(kept) > 2 and _straight(kept[-2], kept[-1], kept[0]):
            kept.pop()
        if len(kept) > 2:
            around = sum(math.dist(a, b) for a, b in zip(kept, kept[1:] + kept[:1], strict=True))
            if abs(_doubled_area(kept)) > 4 * around:
                good.append(kept)
    return good


def _straight(a: tuple, b: tuple, c: tuple) -> bool:
    cross = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
    return abs(cross) <= 2 * math.dist(a, c) and (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1]) >= 0


def _doubled_area(p: list[tuple]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))


def _flat(loop: list[tuple]) -> list[float]:
    return [v / GRID for p in [*loop, loop[0]] for v in p]


def _holds(loop: list[tuple], x: float, y: float) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(loop, loop[1:] + loop[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            odd = not odd
    return odd


def assemble(rings: list[list[float]]) -> list[list[list[float]]]:
    """Polygons (an outer ring, then its holes) of parts that tile a region, in one step: for the parts of one row."""
    events: dict = defaultdict(lambda: defaultdict(int))
    edges = []
    for ring in rings:
        p = [tuple(q) for q in np.rint(np.asarray(ring, float).reshape(-1, 2) * GRID).astype(np.int64).tolist()]
        for a, b in zip(p, p[1:] + p[:1], strict=True):
            if a[0] == b[0] and a != b:
                sign = 1 if a[1] < b[1] else -1
                events[a[0]][min(a[1], b[1])] += sign
                events[a[0]][max(a[1], b[1])] -= sign
            elif a != b:
                edges.append((a, b))
    for x, line in events.items():
        net, last = 0, None
        for y in sorted(line):
            if net:
                edges += [((x, last), (x, y)) if net > 0 else ((x, y), (x, last))] * abs(net)
            net, last = net + line[y], y
    starts, ends = [e[0] for e in edges], [e[1] for e in edges]
    every = [loop for closed, chain in link(starts, ends, ends, starts, lambda _: False) if closed for loop in loops([starts[k] for k in chain])]
    shells = sorted((loop for loop in every if _doubled_area(loop) > 0), key=lambda s: (_doubled_area(s), min(s)))
    found = [[_flat(s)] for s in shells]
    for hole in (loop for loop in every if _doubled_area(loop) < 0):
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        owner = next((k for k, s in enumerate(shells) if _holds(s, x, y)), None)
        if owner is not None:
            found[owner].append(_flat(hole))
    return sorted([f[0], *sorted(f[1:])] for f in found)


def _whole_grid(c: str):
    return F.round(F.col(f"e.{c}") * GRID).cast("long")


def _outline_edges(parts: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, cx, cy, x1, y1, x2, y2: directed edges of the parts without those that cancel."""
    e = parts.select(*keys, F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), F.explode("rings").alias("ring")).select(*keys, "cx", "cy", F.explode(G.edges(F.col("ring"))).alias("e"))
    e = e.select(*keys, "cx", "cy", *(_whole_grid(c).alias(c) for c in ("x1", "y1", "x2", "y2"))).where("x1 <> x2 or y1 <> y2")
    upright, level = F.col("x1") == F.col("x2"), (F.col("y1") == F.col("y2")) & (F.col("y1") % step == 0)
    pick = lambda a, b: F.when(upright, F.col(a)).otherwise(F.col(b))
    low, high = F.least(pick("y1", "x1"), pick("y2", "x2")), F.greatest(pick("y1", "x1"), pick("y2", "x2"))
    sign = F.when(pick("y1", "x1") < pick("y2", "x2"), 1).otherwise(-1)
    line = [*keys, "upright", "at", "along"]
    on_lines = e.where(upright | level).select(*keys, upright.alias("upright"), pick("x1", "y1").alias("at"), pick("cy", "cx").alias("along"), F.explode(F.array(F.struct(low.alias("place"), sign.alias("d")), F.struct(high.alias("place"), (-sign).alias("d")))).alias("v"))
    events = on_lines.groupBy(*line, F.col("v.place").alias("place")).agg(F.sum("v.d").alias("d")).where("d <> 0")
    along = Window.partitionBy(*line).orderBy("place")
    left = events.withColumns({"net": F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "next": F.lead("place").over(along)}).where("net <> 0")
    left = left.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("net"))))
    first, last = F.when(F.col("net") > 0, F.col("place")).otherwise(F.col("next")), F.when(F.col("net") > 0, F.col("next")).otherwise(F.col("place"))
    cell = F.expr(f"(at - pmod(at, {step}L)) div {step}L")
    u = F.col("upright")
    either = lambda a, b: F.when(u, a).otherwise(b)
    left = left.select(
        *keys, either(cell, F.col("along")).alias("cx"), either(F.col("along"), cell).alias("cy"),
        either(F.col("at"), first).alias("x1"), either(first, F.col("at")).alias("y1"), either(F.col("at"), last).alias("x2"), either(last, F.col("at")).alias("y2"),
    )
    return e.where(~(upright | level)).unionByName(left)


def _chained(items: DataFrame, keys: list[str], group: list[str], step: int, level: int, payload: str) -> DataFrame:
    """Chains of the items of each group: keys, cx, cy, ENDS, closed and `payload`, the items' payloads joined."""
    size = step * FAN**level
    shift = OFFSET * step

    def is_open(p: tuple) -> bool:
        return (p[0] + shift) % size == 0 or (p[1] + shift) % size == 0

    kinds = [*((k, items.schema[k].dataType) for k in (*keys, "cx", "cy")), *((e, T.LongType()) for e in ENDS), ("closed", T.BooleanType()), (payload, T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(*k) for k in kinds])
    arrow = to_arrow_schema(schema)
    columns = [*dict.fromkeys((*keys, "cx", "cy", *group, *ENDS, payload))]
    at = {c: k for k, c in enumerate(columns)}
    of, head = [at[g] for g in group], [at[c] for c in (*keys, "cx", "cy")]
    front, back = [at[e] for e in ("x1", "y1", "fx", "fy")], [at[e] for e in ("x2", "y2", "lx", "ly")]

    def chains(rows: list[tuple]) -> Iterator[tuple]:
        points = [[(r[at[x]], r[at[y]]) for r in rows] for x, y in (("x1", "y1"), ("x2", "y2"), ("fx", "fy"), ("lx", "ly"))]
        for closed, chain in link(*points, is_open):
            first, last = rows[chain[0]], rows[chain[-1]]
            (x1, y1, fx, fy), (x2, y2, lx, ly) = (first[k] for k in front), (last[k] for k in back)
            yield (*(first[k] for k in head), x1, y1, x2, y2, fx, fy, lx, ly, closed, [v for k in chain for v in rows[k][at[payload]]])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(batches):
        now, rows, out = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = [row[k] for k in of]
                if key != now:
                    out += chains(rows)
                    now, rows = key, []
                    if len(out) > 5000:
                        yield batch(out)
                        out = []
                rows.append(row)
        out += chains(rows)
        if out:
            yield batch(out)

    return items.select(*columns).repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def polygons(parts: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys and rings (an outer ring against the clock, then its holes) of the region that the parts of a key tile: a row for each
    polygon.

    parts: keys, cx, cy and rings, as overlays by cells of `size` (a multiple of 1e-9) give them. Null keys are a key. Parts
    without area have no polygon.
    """
    step = round(size * GRID)
    edges = _outline_edges(parts, keys, step).withColumns({"fx": F.col("x2"), "fy": F.col("y2"), "lx": F.col("x1"), "ly": F.col("y1"), "points": F.array("x1", "y1")})
    chains = _chained(edges, keys, [*keys, "cx", "cy"], step, 0, "points")
    chains = stored(chains.withColumn("chain", F.monotonically_increasing_id()), "chains")
    rings = chains.where("closed").select(*keys, "points")
    left = chains.where("not closed").withColumn("chains", F.array("chain"))
    level = 0
    while not left.isEmpty():  # each step is FAN times as wide; past the widest region nothing is open
        level += 1
        if FAN**level > 4 * OFFSET:
            raise RuntimeError("an outline does not close")
        block = {f"b{c}": F.floor((F.col(f"c{c}") + OFFSET) / FAN**level).cast("long") for c in "xy"}
        joined = stored(_chained(left.withColumns(block), keys, [*keys, "bx", "by"], step, level, "chains"), "joined")
        done = joined.where("closed").select(*keys, F.get("chains", 0).alias("ring"), F.posexplode("chains").alias("place", "of"))
        own = chains.select(F.col("chain").alias("of"), F.col("points").alias("piece"))
        made = done.join(own, "of").groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces"))  # one ring
        rings = rings.unionByName(made.select(*keys, F.flatten(F.transform("pieces", lambda p: p["piece"])).alias("points")))
        left = joined.where("not closed").drop("closed")
    return _nested(rings, keys, size)


def _nested(rings: DataFrame, keys: list[str], size: float) -> DataFrame:
    def split(batches):
        for b in batches:
            at, flat, area, mid = [], [], [], []
            for k, points in enumerate(b.column(len(keys)).to_pylist()):
                for loop in loops(list(zip(points[::2], points[1::2], strict=True))):
                    at.append(k)
                    flat.append(_flat(loop))
                    area.append(_doubled_area(loop) / 2 / GRID / GRID)
                    mid.append([(loop[0][i] + loop[1][i]) / 2 / GRID for i in (0, 1)])
            held = [b.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            lists = [pa.array(flat, pa.list_(pa.float64())), pa.array(area, pa.float64()), *(pa.array([m[i] for m in mid], pa.float64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*held, *lists], names=[*keys, "ring", "area", "lon", "lat"])

    kinds = ", ".join(f"`{k}` {rings.schema[k].dataType.simpleString()}" for k in keys)
    every = rings.select(*keys, "points").mapInArrow(split, f"{kinds}, ring array<double>, area double, lon double, lat double")
    every = stored(every.withColumn("loop", F.monotonically_increasing_id()), "loops")
    shells = every.where("area > 0").withColumns(G.bounds(F.array("ring"))).drop("lon", "lat")
    own = shells.select(*(F.col(f"`{k}`").alias(f"{k}_b") for k in keys), F.col("loop").alias("shell"), F.col("ring").alias("around"), F.col("area").alias("size_b"), *(F.col(c).alias(f"{c}_b") for c in ("minx", "miny", "maxx", "maxy")))
    holes = every.where("area < 0").select(*keys, "loop", F.col("ring").alias("hole"), "lon", "lat")
    same = [(k, f"{k}_b") for k in keys]
    met = _met(holes, (F.col("lon"), F.col("lat")) * 2, own, tuple(F.col(f"{c}_b") for c in ("minx", "miny", "maxx", "maxy")), size, same)
    met = met.where(G.holds(F.array("around"), F.col("lon"), F.col("lat"))).groupBy("loop").agg(F.min_by(F.struct("shell", "hole"), F.struct("size_b", "shell")).alias("o"))
    held = met.groupBy(F.col("o.shell").alias("_shell")).agg(F.array_sort(F.collect_list("o.hole")).alias("holes"))  # of one polygon
    out = shells.join(held, F.col("loop") == F.col("_shell"), "left")
    return out.select(*keys, F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(RINGS))).alias("rings"))


def multipolygons(polys: DataFrame, keys: list[str]) -> DataFrame:
    """keys and polygons (array of rings each) of each key: one row a feature, for features that fit in a row."""
    return polys.groupBy(*keys).agg(F.array_sort(F.collect_list("rings")).alias("polygons"))


def dissolved(df: DataFrame, key=None, size: float = 1.0) -> DataFrame:
    """key and rings: the polygons of the union of all polygons of a key (null: empty text; no key: all)."""
    return polygons(dissolve(df, key, size), ["key"], size)


def erased(a: DataFrame, b: DataFrame, size: float = 1.0) -> DataFrame:
    """id and rings: the polygons that b leaves of a; features that meet nothing of b keep their rings."""
    left = erase(a, b, size)
    return left.where("cx is null").select("id", "rings").unionByName(polygons(left.where("cx is not null"), ["id"], size))


def united_parts(df: DataFrame, size: float = 1.0) -> DataFrame:
    """collection_id, id, rings: the polygons of logical features. Features of one part keep it; others are the union of theirs."""
    of = ["collection_id", "id"]
    many = df.groupBy(*of).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    alone = df.where("rings is not null").join(many, of, "left_anti").select(*of, "rings")
    name = F.to_json(F.struct(*of))
    joined = dissolved(df.join(many, of, "left_semi"), name, size)
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in of)
    back = joined.withColumn("k", F.from_json("key", kind)).select(*(F.col(f"k.{c}").alias(c) for c in of), "rings")
    return alone.unionByName(back)


def page_geometry(df: DataFrame, size: float = 1.0, **options) -> DataFrame:
    """A page of logical features (see paging) with `polygons`, the union of each one's parts: only the page's features, 1000 at
    most, are united. Features without a polygon have null there."""
    features = page_features(df, **options)
    ids = F.broadcast(features.select("collection_id", "id"))
    shapes = multipolygons(united_parts(df.join(ids, ["collection_id", "id"], "left_semi"), size), ["collection_id", "id"])
    return features.join(shapes, ["collection_id", "id"], "left").orderBy("place")
