"""Mosaic plans: which scenes cover an area. Areas are independent; each is solved in one task from the scenes that meet it.

Scenes with the same footprint (and day, where days count) gain the same, so only the best of them goes to the task: what a
task holds grows with the different footprints over one area. What a scene can gain is first bounded by its box, and only scenes and
days whose bound can win are measured by the kernel; a footprint is measured once for a hole, however many scenes have it. Large areas should be cut to tiles first (`overlay.subdivide`).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mosaics import best_window, scene_search, swap_options
from .overlay import RINGS, clip, overlay
from .shared import stored
from .spatial import BOX, spatial_join

# The covered part at which a plan is done, the most rounds, the least gain of the hole, and strips of an area.
DONE, ROUNDS, LEAST, STRIPS = 0.995, 500, 0.005, 8
NO_CLOUD_VALUE = 1e9
#: What rounding can add to an area, and pairs of boxes that are compared at a time.
SLACK, SHARE = 1e-9, 1 << 20
PLAN = f"aoi string, kind string, place int, id string, area double, uncovered double, rings {RINGS}"


def ring_area(ring) -> float:
    p = np.asarray(ring, float).reshape(-1, 2)
    q = np.roll(p, -1, 0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2


def _box(ring) -> np.ndarray:
    p = np.asarray(ring, float).reshape(-1, 2)
    return np.concatenate([p.min(0), p.max(0)])


class Hole:
    """What is still to be covered: parts (one ring each) that don't overlap."""

    def __init__(self, parts):
        self.parts = list(parts)
        self.boxes = np.array([_box(p) for p in self.parts]).reshape(-1, 4)
        self.areas = np.array([ring_area(p) for p in self.parts])
        self.area = sum(map(ring_area, self.parts))
        self.gains: dict = {}

    def _near(self, box):
        b = self.boxes
        return (b[:, 0] < box[2]) & (b[:, 2] > box[0]) & (b[:, 1] < box[3]) & (b[:, 3] > box[1])

    def bounds(self, boxes: np.ndarray) -> np.ndarray:
        """For each box what a scene within it gains at most; 0: nothing."""
        out, b = np.zeros(len(boxes)), self.boxes
        for k in range(0, len(boxes), step := max(1, SHARE // max(1, len(b)))):
            c = boxes[k : k + step, None]
            w, h = (np.maximum(np.minimum(c[..., i + 2], b[:, i + 2]) - np.maximum(c[..., i], b[:, i]), 0) for i in (0, 1))
            out[k : k + step] = np.where((w > 0) & (h > 0), np.minimum(w * h, self.areas) + SLACK, 0).sum(axis=1)
        return out

    def gain(self, scene) -> float:
        if (shape := scene["shape"]) not in self.gains:
            near = [(0, [self.parts[k]]) for k in np.flatnonzero(self._near(scene["box"]))]
            self.gains[shape] = sum(map(ring_area, overlay([*near, (1, scene["rings"])], all))) if near else 0.0
        return self.gains[shape]

    def without(self, scene) -> Hole:
        near = self._near(scene["box"])
        met = [(0, [self.parts[k]]) for k in np.flatnonzero(near)]
        left = overlay([*met, (1, scene["rings"])], lambda n: n[0] > 0 and n[1] == 0) if met else []
        return Hole([p for p, m in zip(self.parts, near, strict=True) if not m] + left)

    def within(self, x1, x2) -> Hole:
        y1, y2 = self.boxes[:, 1].min(), self.boxes[:, 3].max()
        return Hole([r for p in self.parts for r in clip([p], x1, y1, x2, y2) if ring_area(r) > 0])


def _boxes(scenes: list[dict]) -> np.ndarray:
    return np.array([s["box"] for s in scenes]).reshape(-1, 4)


def greedy(hole: Hole, scenes: list[dict], total: float) -> tuple[list[tuple[dict, float]], Hole]:
    """Picks (scene, gain) of the largest gain, then gain per area, then order, until `hole` is covered or nothing is worth it.

    A scene's gain only falls as the hole shrinks, so its last gain, or the bound of its box, bounds the next one, and only scenes
    whose bound reaches the best gain found are measured.
    """
    waiting = [(-b, k) for k, b in enumerate(hole.bounds(_boxes(scenes)).tolist()) if b > 0]
    heapq.heapify(waiting)
    picks = []
    while waiting and len(picks) < ROUNDS and hole.area > (1 - DONE) * total:
        best, measured = 0.0, []
        while waiting and -waiting[0][0] >= best - 1e-12:
            k = heapq.heappop(waiting)[1]
            g = hole.gain(scenes[k])
            if g > 0:
                measured.append((g, k))
                best = max(best, g)
        if not measured or (picks and best < hole.area * LEAST):
            break
        equal = [(g, k, g / scenes[k]["area"]) for g, k in measured if g >= best - 1e-12]
        ratio = max(r for _, _, r in equal)
        chosen = min((k for _, k, r in equal if r >= ratio - 1e-15), key=lambda k: scenes[k]["order"])
        picks.append((scenes[chosen], next(g for g, k in measured if k == chosen)))
        for g, k in measured:
            if k != chosen:
                heapq.heappush(waiting, (-g, k))
        hole = hole.without(scenes[chosen])
    return picks, hole


def by_strips(hole: Hole, scenes: list[dict], total: float) -> tuple[list[tuple[dict, float]], Hole]:
    """Strips from west to east; each takes the scenes of the one day that leaves least uncovered, then has least mean cloud,
    then is earliest. What is left is filled from all scenes.

    A day leaves at least what the bounds of its scenes' gains leave; days are tried from the best such rank on, until it is
    worse than the best rank found."""
    west, east = hole.boxes[:, 0].min(), hole.boxes[:, 2].max()
    boxes, picks = _boxes(scenes), []
    for k in range(STRIPS):
        x1, x2 = west + (east - west) * k / STRIPS, west + (east - west) * (k + 1) / STRIPS
        if not hole.parts or not (strip := hole.within(x1, x2)).parts:
            continue
        bounds, days = strip.bounds(boxes).tolist(), {}
        for n in np.flatnonzero((boxes[:, 0] < x2) & (boxes[:, 2] > x1)).tolist():
            days.setdefault(scenes[n]["day"], []).append(n)
        ranks = []
        for day, pool in days.items():
            clouds = [c for n in pool if (c := scenes[n]["cloud"]) is not None]
            least = max(0.0, 1 - sum(bounds[n] for n in pool) / strip.area - SLACK)
            ranks.append((least, sum(clouds) / len(clouds) if clouds else 50.0, day is None, str(day), day))
        best = None
        for *least, day in sorted(ranks, key=lambda r: r[:4]):
            if best is not None and tuple(least) > best[0]:
                break
            found, rest = greedy(strip, [scenes[n] for n in days[day]], strip.area)
            rank = (rest.area / strip.area, *least[1:])
            if best is None or rank < best[0]:
                best = (rank, found)
        for scene, gain in best[1] if best else []:
            picks.append((scene, gain))
            hole = hole.without(scene)
    taken = {s["id"] for s, _ in picks}
    more, hole = greedy(hole, [s for s in scenes if s["id"] not in taken], total) if hole.parts else ([], hole)
    return picks + more, hole


def cover(aois: DataFrame, scenes: DataFrame, mode: str = "greedy", prefer: str = "cloud", size: float = 4.0) -> DataFrame:
    """The plan of each area: kind `pick` (place, id, area gained), `rest` (uncovered parts, the largest first) and one `total`.

    aois: aoi, rings, box. scenes: id, rings, box, cloud, dt. mode: greedy or strips. Ties go to the least cloud (no value: last)
    or, with prefer='newest', to the newest scene, then to the smaller id. An area without scenes has a total and its rest.
    """
    if mode not in ("greedy", "strips") or prefer not in ("cloud", "newest"):
        raise ValueError("mode is greedy or strips, prefer is cloud or newest")
    met = spatial_join(aois.select("aoi", *BOX), scenes.select("id", "rings", "cloud", "dt", *BOX), size)
    rank = F.coalesce("cloud_b", F.lit(NO_CLOUD_VALUE)) if prefer == "cloud" else -F.coalesce(F.unix_timestamp("dt_b"), F.lit(0)).cast("double")
    day = F.to_date("dt_b")
    keys = ["aoi", F.col("rings_b").alias("rings"), *([day.alias("day")] if mode == "strips" else [])]
    best = met.where("rings_b is not null").groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), F.col("id_b").alias("id"), F.col("cloud_b").alias("cloud"), day.alias("first_day"))).alias("s"))
    columns = ["aoi", "s.id", "rings", "s.rank", "s.cloud", F.col("s.first_day").alias("day")]
    own = aois.selectExpr("aoi", "cast(null as string) as id", "rings", "cast(null as double) as rank", "cast(null as double) as cloud", "cast(null as date) as day")
    solve = by_strips if mode == "strips" else greedy

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        area = [r["rings"] for r in rows if r["id"] is None]
        found = [r for r in rows if r["id"] is not None]
        shapes: dict = {}
        for r in found:
            if (shape := tuple(map(tuple, r["rings"]))) not in shapes:
                shell = [v for ring in shape for v in ring]
                shapes[shape] = {"shape": len(shapes), "box": _box(shell), "area": sum(map(ring_area, overlay([(0, r["rings"])], any)))}
            r |= shapes[shape] | {"order": (r["rank"], r["id"])}
        found = sorted((r for r in found if r["area"] > 0), key=lambda r: r["order"])
        hole = Hole(overlay([(0, area[0])], any))
        total = hole.area
        picks, hole = solve(hole, found, total) if hole.parts else ([], hole)
        rest = sorted(hole.parts, key=lambda p: (-ring_area(p), p))
        uncovered = hole.area / total if total else 0.0
        key = rows[0]["aoi"]
        out = [{"aoi": key, "kind": "pick", "place": k + 1, "id": s["id"], "area": g, "uncovered": None, "rings": s["rings"]} for k, (s, g) in enumerate(picks)]
        out += [{"aoi": key, "kind": "rest", "place": k + 1, "id": None, "area": ring_area(p), "uncovered": None, "rings": [p]} for k, p in enumerate(rest)]
        out.append({"aoi": key, "kind": "total", "place": len(picks), "id": None, "area": total, "uncovered": uncovered, "rings": None})
        return pa.Table.from_pylist(out, schema)

    schema = pa.schema([("aoi", pa.string()), ("kind", pa.string()), ("place", pa.int32()), ("id", pa.string()), ("area", pa.float64()), ("uncovered", pa.float64()), ("rings", pa.list_(pa.list_(pa.float64())))])
    # by a given number, else Spark joins areas of few rows to one task, and these rows are long work
    tasks = int(aois.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return best.select(*columns).union(own).repartition(tasks, "aoi").groupBy("aoi").applyInArrow(run, PLAN)


def plan_mosaic(aois: DataFrame, scenes: DataFrame, slices=None, max_cloud: float | None = None, one_week: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(plan, swaps): the scenes that pass the search, of the best seven days if asked, cover the areas; swaps are a page of
    other scenes of the same tile for each picked one. The plan is a table, so it is computed once for both."""
    held = scene_search(scenes, None, slices, max_cloud)
    if one_week:
        days = best_window(held).select(F.explode(F.expr("sequence(date_sub(anchor, 3), date_add(anchor, 3))")).alias("_day"))
        held = held.join(F.broadcast(days), F.to_date("dt") == F.col("_day"), "left_semi")  # seven rows
    plan = stored(cover(aois, held, **options), "plan")
    chosen = scenes.join(plan.where("kind = 'pick'").select("id").distinct(), "id", "left_semi")
    return plan, swap_options(chosen, scenes)


def collection_pairs(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, counts) of items(collection_id, id, href, rings, bounds): href and rings, or the bounds as a box; counts by
    collection of what has no address and of what has no shape."""
    at = lambda i: F.get("bounds", i)
    box = F.when(at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull() & at(3).isNotNull(), F.array(F.array(at(0), at(1), at(2), at(1), at(2), at(3), at(0), at(3), at(0), at(1))))
    shaped = items.withColumn("rings", F.when(F.size("rings") > 0, F.col("rings")).otherwise(box))
    no_href = F.coalesce(F.trim("href"), F.lit("")) == ""
    counts = shaped.groupBy("collection_id").agg(F.count("*").alias("total"), F.count_if(no_href).alias("no_href"), F.count_if(~no_href & F.col("rings").isNull()).alias("no_shape"))
    return shaped.where(~no_href & F.col("rings").isNotNull()).select("collection_id", "id", "href", "rings"), counts
