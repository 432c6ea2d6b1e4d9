"""Vector tiles as tables: addresses, assignment, clipping and limits per tile."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .filters import bbox_filter, properties_map
from .numbering import number_rows
from .overlay import Rings, _batched, _listed, clips

BUFFER = 256 / 4096
#: Of a tile: what lies this close below a tile's edge counts as on it.
EPSILON = 5e-10


def tile_boxes(tiles: DataFrame) -> DataFrame:
    """tiles(z, x, y) with their WGS84 box and web-mercator box."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    out = tiles.withColumns({"west": S.tile_west(x, z), "east": S.tile_west(x + 1, z), "north": S.tile_north(y, z), "south": S.tile_north(y + 1, z)})
    return out.withColumns({"mx1": S.mercator_x(F.col("west")), "mx2": S.mercator_x(F.col("east")), "my1": S.mercator_y(F.col("south")), "my2": S.mercator_y(F.col("north"))})


def tiles_for(df: DataFrame, zoom: int) -> DataFrame:
    """One row per tile that covers a box at a zoom, with its quadkey."""
    z = F.lit(zoom)
    xs = F.sequence(S.tile_x(F.col("minx"), z), S.tile_x(F.col("maxx"), z))
    ys = F.sequence(S.tile_y(F.col("maxy"), z), S.tile_y(F.col("miny"), z))
    out = df.withColumn("z", z).withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))
    return out.withColumn("quadkey", S.quadkey(F.col("z"), F.col("x"), F.col("y")))


def assign_tiles(df: DataFrame, zmin: int, zmax: int, buffer: float = BUFFER) -> DataFrame:
    """One row per feature and tile whose buffered box meets the feature's box, for all zooms of the pyramid; a feature without a box has none.

    The tile range is computed in fractional tile coordinates, where the buffer is a constant, so no join is needed. The
    place of a box on the whole map is computed once for all zooms, and the tiles of a zoom are dealt out at once by their
    number in its range."""

    def down(c: str):
        held = F.radians(F.least(F.greatest(F.col(c), F.lit(-S.LAT_LIMIT)), F.lit(S.LAT_LIMIT)))
        return (1 - F.ln(F.tan(held) + 1 / F.cos(held)) / F.pi()) / 2

    placed = {"_w": (F.col("minx") + 180) / 360, "_e": (F.col("maxx") + 180) / 360, "_n": down("maxy"), "_s": down("miny")}
    boxed = df.where("minx is not null and miny is not null and maxx is not null and maxy is not null")
    out = boxed.withColumns(placed).withColumn("z", F.explode_outer(F.sequence(F.lit(zmin), F.lit(zmax))))
    n = F.pow(F.lit(2.0), F.col("z"))
    low = lambda c: F.greatest(F.floor(F.col(c) * n - F.lit(buffer) + F.lit(EPSILON)), F.lit(0))
    high = lambda c: F.least(F.floor(F.col(c) * n + F.lit(buffer) + F.lit(EPSILON)), n.cast("long") - 1)
    out = out.withColumns({"_x": low("_w"), "_x2": high("_e"), "_y": low("_n"), "_y2": high("_s")}).where("_x <= _x2 and _y <= _y2")
    out = out.withColumn("_k", F.explode_outer(F.expr("sequence(0L, (_x2 - _x + 1) * (_y2 - _y + 1) - 1)")))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), "z", F.expr("_x + _k % (_x2 - _x + 1)").alias("x"), F.expr("_y + _k div (_x2 - _x + 1)").alias("y"))


def cap_tiles(assigned: DataFrame, cap: int) -> DataFrame:
    """At most `cap` features in a tile, the largest first; a feature of the tile builder's drop rule."""
    w = Window.partitionBy("z", "x", "y").orderBy(F.col("area").desc(), F.col("id"))
    return assigned.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def stale(collections: DataFrame, built: DataFrame, force: bool = False) -> DataFrame:
    """Collections to build again: never built, changed since, or forced."""
    out = collections.join(built, "collection_id", "left")
    return out if force else out.where("features_updated_at is null or last_updated > features_updated_at")


def tile_box(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    n = 2.0**z
    lat = lambda row: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def tile_features(df: DataFrame, z: int, x: int, y: int, box=None, paged: tuple[int, int] | None = None, cap: int = 50_000) -> DataFrame:
    """Features that meet a tile and, if given, a user's box. With paged=(limit, offset): those of that page by id that meet the
    tile; otherwise at most `cap` by id, the size limit of a tile."""
    for b in (box, None if paged else tile_box(z, x, y)):
        df = df if b is None else bbox_filter(df, b)
    if paged is None:
        return df.orderBy("id", "part_index").limit(cap)
    return bbox_filter(df.orderBy("id", "part_index").offset(paged[1]).limit(paged[0]), tile_box(z, x, y))


def quantized(points: DataFrame, zoom: int, extent: int = 4096) -> DataFrame:
    """Points (lon, lat) with their tile and integer place in it, counted from its upper left corner."""
    n, z = 2.0**zoom, F.lit(zoom)
    held = F.radians(F.least(F.greatest("lat", F.lit(-S.LAT_LIMIT)), F.lit(S.LAT_LIMIT)))
    out = points.withColumns({"z": z, "x": S.tile_x(F.col("lon"), z), "y": S.tile_y(F.col("lat"), z)})
    fx, fy = (F.col("lon") + 180) / 360 * n, (1 - F.ln(F.tan(held) + 1 / F.cos(held)) / F.pi()) / 2 * n
    return out.withColumns({"qx": F.floor((fx - F.col("x")) * extent + 0.5).cast("int"), "qy": F.floor((fy - F.col("y")) * extent + 0.5).cast("int")})


def tile_polygons(df: DataFrame, zmin: int, zmax: int, extent: int = 4096, buffer: float = BUFFER) -> DataFrame:
    """id, z, x, y, part_index, rings: polygons in tile units, cut at the buffered tile; what has no area there is left out."""
    low, high = -buffer * extent, (1 + buffer) * extent

    def cut(rings: pa.Array, *tile: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """All rows together, in arrays."""
        r = Rings.of_column(rings)
        z, x, y = (c.to_numpy(zero_copy_only=False)[np.repeat(r.of, r.sizes)] for c in tile)
        n = 2.0**z
        held = np.radians(np.clip(r.points[:, 1], -S.LAT_LIMIT, S.LAT_LIMIT))
        across, down = (r.points[:, 0] + 180) / 360 * n, (1 - np.log(np.tan(held) + 1 / np.cos(held)) / np.pi) / 2 * n
        placed = Rings(np.column_stack([(across - x) * extent, (down - y) * extent]), r.sizes, r.of)
        inside = clips(placed, np.tile([low, low, high, high], (len(r.sizes), 1)))[1]
        whole = Rings(np.floor(np.round(inside.points, 6) + 0.5), inside.sizes, inside.of)
        if not len(whole.sizes):
            return np.zeros(0, np.int64), _listed(np.zeros(0, np.int64), whole.arrow())
        first = np.cumsum(whole.sizes) - whole.sizes
        span = np.maximum.reduceat(whole.points, first) - np.minimum.reduceat(whole.points, first)
        at = np.unique(whole.of[span.prod(1) > 0])
        kept = whole.taken(at)
        return at, _listed(np.bincount(kept.of, minlength=len(at)), kept.arrow())

    return _batched(assign_tiles(df, zmin, zmax, buffer), ["id", "z", "x", "y"], ["rings", "z", "x", "y"], cut)


def member_tiles(df: DataFrame, members: list[str], zmin: int, zmax: int) -> DataFrame:
    """z, x, y, member_ord, collection_id, id, part_index, properties: the features of all members as one layer for each tile."""
    held = df.where(F.col("collection_id").isin(members)).withColumn("member_ord", F.array_position(F.array(*(F.lit(m) for m in members)), F.col("collection_id")).cast("int") - 1)
    return assign_tiles(held, zmin, zmax).select("z", "x", "y", "member_ord", "collection_id", "id", "part_index", "properties")


def merge_members(members: list[DataFrame], zmin: int, zmax: int) -> DataFrame:
    """Features per tile over all members, as (member, id) lists' sizes: z, x, y, n, members."""
    every = None
    for k, m in enumerate(members):
        tagged = m.select("id", "minx", "miny", "maxx", "maxy", F.lit(k).alias("member"))
        every = tagged if every is None else every.unionByName(tagged)
    return assign_tiles(every, zmin, zmax).groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.countDistinct("member").alias("members"))


def _empty(df: DataFrame, box: tuple[str, ...]):
    """Whether a feature has no geometry; where no column of `box` is carried, none is known to."""
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in box if c in df.columns), F.lit(False))


def export_rows(df: DataFrame, box: tuple[str, ...] = ("minx", "miny", "maxx", "maxy")) -> DataFrame:
    """Logical features with a number in id order, from 1, for the static tile build; a property `id` moves to the first free
    name of id_source, id_source_1, ... Features without geometry (a null in `box`) are left out; `export_counts` counts them.

    Numbers come from ranges of ids and their counts, so ids that begin alike, as time-ordered ones do, don't share a task.
    """
    drawn = df.where(~_empty(df, box))
    numbered = number_rows(drawn, ["id", "collection_id"], first=1)
    props = properties_map()
    keys = F.map_keys(props)
    names = F.transform(F.sequence(F.lit(0), F.size(keys)), lambda k: F.when(k == 0, F.lit("id_source")).otherwise(F.concat(F.lit("id_source_"), k.cast("string"))))
    free = F.get(F.filter(names, lambda n: ~F.array_contains(keys, n)), 0)
    return numbered.withColumn("properties", F.to_json(F.transform_keys(props, lambda k, _: F.when(k == "id", free).otherwise(k))))


def export_counts(df: DataFrame, box: tuple[str, ...] = ("minx", "miny", "maxx", "maxy")) -> DataFrame:
    """exported and skipped features."""
    empty = _empty(df, box)
    return df.agg(F.count_if(~empty).alias("exported"), F.count_if(empty).alias("skipped"))
