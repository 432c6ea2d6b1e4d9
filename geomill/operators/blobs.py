"""Areas of pixels that share sides, over rasters of any size.

A raster is cut to square blocks. A task labels the runs of one block; areas of neighbouring blocks that touch at a border
are links, and connected components of these links are the areas of the whole raster.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import stored

BLOCK = 256
NODE = "struct<raster_id: long, y: long, x: long>"
_RUNS = "raster_id long, bx long, by long, y long, x1 long, x2 long, first_y long, first_x long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _RUNS.split(", ")])


def block_of(c: str, block: int) -> Column:
    return F.floor(F.col(c) / F.lit(block)).cast("long")


def block_runs(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(raster_id, bx, by, y, x1, x2): runs of the pixels (raster_id, px, py) in the rows of each block. Repeated pixels count once."""
    held = pixels.where("raster_id is not null and px is not null and py is not null").select("raster_id", "px", "py").distinct()
    held = held.withColumns({"bx": block_of("px", block), "by": block_of("py", block)})
    apart = F.col("px") - F.row_number().over(Window.partitionBy("raster_id", "bx", "by", "py").orderBy("px"))
    return held.withColumn("_run", apart).groupBy("raster_id", "bx", "by", F.col("py").alias("y"), "_run").agg(F.min("px").alias("x1"), F.max("px").alias("x2")).drop("_run")


def joined_runs(rows: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Runs (y, x1, x2) of one block, grouped to areas whose pixels share sides."""
    rows = sorted(rows)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above = 0
    for k, (y, x1, x2) in enumerate(rows):
        while above < k and (rows[above][0] < y - 1 or (rows[above][0] == y - 1 and rows[above][2] < x1)):
            above += 1
        j = above
        while j < k and rows[j][0] == y - 1 and rows[j][1] <= x2:
            parent[root(k)] = root(j)
            j += 1
    out: dict = {}
    for k, r in enumerate(rows):
        out.setdefault(root(k), []).append(r)
    return list(out.values())


def _labelled(key: tuple[int, int, int], rows: list[tuple[int, int, int]]) -> pa.Table:
    out = [(*key, *r, *min(area)[:2]) for area in joined_runs(rows) for r in area]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(_ARROW), schema=_ARROW)


def _key(table: pa.Table) -> tuple[int, int, int]:
    return tuple(table.column(c)[0].as_py() for c in ("raster_id", "bx", "by"))


def label_blocks(runs: DataFrame) -> DataFrame:
    """`runs` with first_y and first_x, the first pixel of their area within the block."""

    def label(table: pa.Table) -> pa.Table:
        return _labelled(_key(table), list(zip(*(table.column(c).to_pylist() for c in ("y", "x1", "x2")), strict=True)))

    return runs.groupBy("raster_id", "bx", "by").applyInArrow(label, _RUNS)


def label_gaps(runs: DataFrame, frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """What `runs` leave free in frames(raster_id, left, top, right, bottom), labelled by block as `label_blocks` does it."""
    each = frames.withColumn("by", F.explode(F.sequence(block_of("top", block), block_of("bottom", block))))
    each = each.withColumn("bx", F.explode(F.sequence(block_of("left", block), block_of("right", block))))
    inside = {"left": F.greatest("left", F.col("bx") * block), "right": F.least("right", (F.col("bx") + 1) * block - 1)}
    inside |= {"top": F.greatest("top", F.col("by") * block), "bottom": F.least("bottom", (F.col("by") + 1) * block - 1)}
    part = each.withColumns(inside).join(runs.select("raster_id", "bx", "by", "y", "x1", "x2"), ["raster_id", "bx", "by"], "left")

    def label(table: pa.Table) -> pa.Table:
        left, right, top, bottom = (table.column(c)[0].as_py() for c in ("left", "right", "top", "bottom"))
        held: dict = {}
        for y, x1, x2 in zip(*(table.column(c).to_pylist() for c in ("y", "x1", "x2")), strict=True):
            if y is not None:
                held.setdefault(y, []).append((x1, x2))
        free = []
        for y in range(top, bottom + 1):
            at = left
            for x1, x2 in sorted(held.get(y, ())):
                if x1 > at:
                    free.append((y, at, x1 - 1))
                at = x2 + 1
            if at <= right:
                free.append((y, at, right))
        return _labelled(_key(table), free)

    return part.groupBy("raster_id", "bx", "by").applyInArrow(label, _RUNS)


def across_blocks(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """(raster_id, y, x1, x2, area): `area` is the first pixel, by row and column, of the whole area that a run belongs to.

    `labelled` should be a stored table. An area of a block touches at most 4 * `block` others, which bounds the links of a node.
    """
    named = labelled.withColumn("node", F.struct("raster_id", F.col("first_y").alias("y"), F.col("first_x").alias("x")).cast(NODE))
    left = named.where((F.col("x2") + 1) % block == 0).select("raster_id", "y", (F.col("x2") + 1).alias("x1"), F.col("node").alias("a"))
    sides = left.join(named.where(F.col("x1") % block == 0).select("raster_id", "y", "x1", F.col("node").alias("b")), ["raster_id", "y", "x1"]).select("a", "b")
    upper = named.where((F.col("y") + 1) % block == 0).select("raster_id", "bx", (F.col("y") + 1).alias("y"), F.col("x1").alias("_u1"), F.col("x2").alias("_u2"), F.col("node").alias("a"))
    lower = named.where(F.col("y") % block == 0).select("raster_id", "bx", "y", "x1", "x2", F.col("node").alias("b"))
    rows = upper.join(lower, ["raster_id", "bx", "y"]).where("_u1 <= x2 and x1 <= _u2").select("a", "b")
    labels = components(sides.union(rows)).withColumnRenamed("node", "_node")
    joined = named.join(labels, F.col("node") == F.col("_node"), "left")
    return joined.select("raster_id", "bx", "by", "y", "x1", "x2", F.coalesce("label", "node").alias("area"))


def largest_area(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(raster_id, bx, by, y, x1, x2): the runs of each raster's largest area; of equal ones the upper, then the left one."""
    runs = stored(across_blocks(stored(label_blocks(block_runs(pixels, block)), "block_areas"), block), "areas")
    sizes = runs.groupBy("raster_id", "area").agg(F.sum(F.expr("x2 - x1 + 1")).alias("n"))
    best = F.max_by("area", F.struct("n", -F.col("area.y"), -F.col("area.x")))
    first = sizes.groupBy("raster_id").agg(best.alias("area")).select("area")
    return stored(runs.join(first, "area", "left_semi").drop("area"), "largest")


def filled_size(area: DataFrame, block: int = BLOCK) -> DataFrame:
    """(raster_id, n_pixels) of one area for each raster with its holes: its frame without what is connected with the frame's border."""
    ends = area.groupBy("raster_id").agg(*(f.alias(c) for f, c in ((F.min("x1") - 1, "left"), (F.min("y") - 1, "top"), (F.max("x2") + 1, "right"), (F.max("y") + 1, "bottom"))))
    frames = stored(ends, "frames")
    free = stored(across_blocks(stored(label_gaps(area, frames, block), "block_gaps"), block), "gaps")
    corner = frames.select(F.struct("raster_id", F.col("top").alias("y"), F.col("left").alias("x")).cast(NODE).alias("area"))
    outside = free.join(corner, "area", "left_semi").groupBy("raster_id").agg(F.sum(F.expr("x2 - x1 + 1")).alias("n"))
    return frames.join(outside, "raster_id").select("raster_id", F.expr("(right - left + 1) * (bottom - top + 1) - n").alias("n_pixels"))


def extreme_corners(area: DataFrame) -> DataFrame:
    """(raster_id, corners): lower left, upper left, upper right and lower right extremes of the pixels' corners; y counts down."""
    p = area.withColumn("x", F.explode(F.array("x1", F.col("x2") + 1))).withColumn("down", F.explode(F.array("y", F.col("y") + 1))).withColumn("up", -F.col("down"))
    point = F.array("x", "down")
    at = lambda most, *key: most(F.struct(*(F.expr(k).alias(f"k{i}") for i, k in enumerate(key)), point.alias("p")))["p"]
    found = (at(F.min, "x + up", "x", "up"), at(F.max, "up - x", "-x", "up"), at(F.max, "x + up", "x", "up"), at(F.max, "x - up", "x", "-up"))
    return p.groupBy("raster_id").agg(F.array(*found).alias("corners"))
