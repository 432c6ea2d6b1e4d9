"""Queries with space: joins, zonal statistics, tiles, scenes, pixels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import filters as fl
from ..operators import mosaics as mo
from ..operators import paging as pg
from ..operators import spatial as sp
from ..operators import tiles as tl
from ..sources import fixtures as fx
from ..sources.fixtures import with_views as wv

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


MEET = "a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy"
IN = "lon BETWEEN b.minx AND b.maxx AND lat BETWEEN b.miny AND b.maxy"
AREA = "(least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny))"


def side(s, d, status):
    return fx.parcels(s, d).where(F.col("collection_id") == f"parcels_{status}").select("collection_id", "id", *sp.BOX)


@query("j1_spatial_join", wv(f"SELECT a.id AS id, b.id AS id_b FROM parcels a JOIN parcels b ON a.status = 'P' AND b.status = 'O' AND {MEET}", "parcels"))
def _(s, d):
    return sp.spatial_join(side(s, d, "P"), side(s, d, "O")).select("id", "id_b")


@query("j2_spatial_anti", wv(f"SELECT a.id FROM parcels a WHERE a.status = 'P' AND NOT EXISTS (SELECT 1 FROM parcels b WHERE b.status = 'F' AND {MEET})", "parcels"))
def _(s, d):
    return sp.semi(side(s, d, "P"), side(s, d, "F"), anti=True).select("id")


@query("j2_spatial_semi", wv(f"SELECT a.id FROM parcels a WHERE a.status = 'P' AND EXISTS (SELECT 1 FROM parcels b WHERE b.status = 'F' AND {MEET})", "parcels"))
def _(s, d):
    return sp.semi(side(s, d, "P"), side(s, d, "F")).select("id")


@query("j3_point_in_polygon", wv(f"SELECT p.id, b.id AS id_b FROM points p JOIN parcels b ON {IN}", "points", "parcels"))
def _(s, d):
    return sp.points_in(fx.points(s, d), fx.parcels(s, d)).select("id", "id_b")


@query("f16_contains_point", wv("SELECT min(id) AS id FROM parcels WHERE minx <= 0.5 AND maxx >= 0.5 AND miny <= 3 AND maxy >= 3", "parcels"))
def _(s, d):
    return fl.bbox_filter(fx.parcels(s, d), (0.5, 3, 0.5, 3)).agg(F.min("id").alias("id"))


@query("j4_feature_vs_layers", wv("SELECT collection_id AS layer, id FROM parcels WHERE collection_id IN ('parcels_O', 'parcels_F') AND minx <= 12 AND maxx >= -12 AND miny <= 12 AND maxy >= -12", "parcels"))
def _(s, d):
    layers = fx.parcels(s, d).where(F.col("collection_id").isin("parcels_O", "parcels_F"))
    return fl.bbox_filter(layers, (-12, -12, 12, 12)).select(F.col("collection_id").alias("layer"), "id")


@query("g2_intersection", wv(f"SELECT a.id AS id, b.id AS id_b, {AREA} AS area FROM parcels a JOIN parcels b ON a.status = 'P' AND b.status = 'O' AND {MEET} WHERE least(a.maxx, b.maxx) > greatest(a.minx, b.minx) AND least(a.maxy, b.maxy) > greatest(a.miny, b.miny)", "parcels"))
def _(s, d):
    return sp.clip(sp.spatial_join(side(s, d, "P"), side(s, d, "O"))).select("id", "id_b", "area")


@query("g6_buffer_boxes", wv("SELECT id, minx - 0.25 AS minx, miny - 0.25 AS miny, maxx + 0.25 AS maxx, maxy + 0.25 AS maxy FROM parcels", "parcels"))
def _(s, d):
    return fx.parcels(s, d).select("id", *((F.col(c) + F.lit(-0.25 if c.startswith("min") else 0.25)).alias(c) for c in sp.BOX))


@query("g7_explode", wv("SELECT id AS _parent_id, part_index AS _part_index, minx, maxx FROM parts", "parts"))
def _(s, d):
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("part_index", "minx", "maxx"))), lambda p: F.struct(p["minx"].alias("minx"), p["maxx"].alias("maxx")))
    whole = fx.parts(s, d).groupBy("collection_id", "id").agg(boxes.alias("parts"))
    return whole.select(F.col("id").alias("_parent_id"), F.posexplode("parts").alias("_part_index", "b")).select("_parent_id", "_part_index", "b.minx", "b.maxx")


@query("g14_clip_to_box", wv("SELECT id, greatest(minx, -30) AS minx, least(maxx, 30) AS maxx FROM parcels WHERE minx <= 30 AND maxx >= -30 AND miny <= 30 AND maxy >= -30", "parcels"))
def _(s, d):
    hit = fl.bbox_filter(fx.parcels(s, d), (-30, -30, 30, 30))
    return hit.select("id", F.greatest("minx", F.lit(-30.0)).alias("minx"), F.least("maxx", F.lit(30.0)).alias("maxx"))


@query("g16_area_center", wv("SELECT id, (maxx - minx) * (maxy - miny) AS area, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy FROM parcels", "parcels"))
def _(s, d):
    e = ("id", "(maxx - minx) * (maxy - miny) as area", "(minx + maxx) / 2 as cx", "(miny + maxy) / 2 as cy")
    return fx.parcels(s, d).selectExpr(*e)


@query(
    "a6_zonal_statistics",
    wv(
        f"""SELECT b.id AS zone, band, count(*) FILTER (NOT masked) AS valid_pixels, count(*) FILTER (masked) AS masked_pixels,
 round(count(*) FILTER (NOT masked) * 100.0 / count(*), 6) AS valid_percent, min(value) FILTER (NOT masked) AS min, max(value) FILTER (NOT masked) AS max,
 round(avg(value) FILTER (NOT masked), 6) AS mean, sum(value) FILTER (NOT masked) AS sum, round(stddev_pop(value) FILTER (NOT masked), 6) AS std,
 quantile_cont(value, 0.5) FILTER (NOT masked) AS median, round(quantile_cont(value, 0.02) FILTER (NOT masked), 6) AS percentile_2,
 round(quantile_cont(value, 0.98) FILTER (NOT masked), 6) AS percentile_98 FROM pixels JOIN zones b ON {IN} GROUP BY 1, 2""",
        "pixels",
        "zones",
    ),
)
def _(s, d):
    return sp.zonal_statistics(fx.zones(s, d), fx.pixels(s, d))


@query(
    "a6_zonal_categories",
    wv(
        f"""WITH n AS (SELECT b.id AS zone, band, value, count(*) AS n FROM pixels JOIN zones b ON {IN} WHERE NOT masked GROUP BY 1, 2, 3)
SELECT DISTINCT zone, band, count(*) OVER w AS "unique", first_value(value) OVER (PARTITION BY zone, band ORDER BY n DESC, value) AS majority,
 first_value(value) OVER (PARTITION BY zone, band ORDER BY n, value) AS minority FROM n WINDOW w AS (PARTITION BY zone, band)""",
        "pixels",
        "zones",
    ),
)
def _(s, d):
    return sp.zonal_categories(fx.zones(s, d), fx.pixels(s, d))


@query(
    "a6_zonal_histogram",
    wv(
        f"""WITH v AS (SELECT b.id AS zone, band, value FROM pixels JOIN zones b ON {IN} WHERE NOT masked),
 w AS (SELECT *, min(value) OVER (PARTITION BY zone, band) AS low, max(value) OVER (PARTITION BY zone, band) AS high FROM v)
SELECT zone, band, CASE WHEN high > low THEN least(CAST(floor((value - low) / (high - low) * 10) AS BIGINT), 9) ELSE 0 END AS bin, count(*) AS n FROM w GROUP BY 1, 2, 3""",
        "pixels",
        "zones",
    ),
)
def _(s, d):
    return sp.zonal_histogram(fx.zones(s, d), fx.pixels(s, d))


@query(
    "a13_rescale_suggestion",
    wv(
        """WITH b AS (SELECT raster_id, band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM pixels WHERE NOT masked GROUP BY 1, 2)
SELECT raster_id, CAST(CAST(round(min(lo)) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(max(hi)) AS BIGINT) AS VARCHAR) AS rescale FROM b GROUP BY 1 HAVING max(hi) > min(lo)""",
        "pixels",
    ),
)
def _(s, d):
    return mo.rescale_suggestion(fx.pixels(s, d))


@query(
    "m10_sample_points",
    wv(
        """SELECT p.id, raster_id, band, value FROM points p LEFT JOIN (SELECT * FROM pixels WHERE NOT masked) x
 ON floor(p.lon / 0.125) = floor(x.lon / 0.125) AND floor(p.lat / 0.125) = floor(x.lat / 0.125)""",
        "points",
        "pixels",
    ),
)
def _(s, d):
    return mo.sample_points(fx.points(s, d), fx.pixels(s, d))


@query("j8_classify", wv("SELECT raster_id, band, value, CASE value WHEN 1 THEN 'water' WHEN 2 THEN 'forest' WHEN 3 THEN 'urban' END AS name, value = 50 AS is_nodata FROM pixels", "pixels"))
def _(s, d):
    classes = F.broadcast(s.createDataFrame([("1", "water"), ("2", "forest"), ("3", "urban")], "value_key string, name string"))
    return mo.classify(fx.pixels(s, d).select("raster_id", "band", "value"), classes, 50.0).select("raster_id", "band", "value", "name", "is_nodata")


@query("j8_legend", wv("SELECT raster_id, band, value, CASE value WHEN 1 THEN 'water' WHEN 2 THEN '2' WHEN 3 THEN 'urban' WHEN 4 THEN '4' WHEN 50 THEN '50' END AS name, CASE value WHEN 1 THEN '#00f' WHEN 2 THEN '#0f0' WHEN 3 THEN '' WHEN 4 THEN '#123' WHEN 50 THEN '#fff' END AS color FROM pixels", "pixels"))
def _(s, d):
    """Classes first (of two for a value the first), then the colour map."""
    classes = s.createDataFrame([(0, "1.0", "water", "00f"), (1, "2", None, "#0f0"), (2, "3", "urban", None), (3, "1", "later", "#f00"), (4, None, "none", "#000")], "place int, value string, name string, color string")
    colors = s.createDataFrame([("1", "#aaa"), ("4", "123"), ("50.0", "#fff"), ("x", "#bbb")], "value string, color string")
    return mo.classify(fx.pixels(s, d).select("raster_id", "band", "value"), F.broadcast(mo.legend(classes, colors)), 50.0).select("raster_id", "band", "value", "name", "color")


@query("f17_scene_search", wv("SELECT catalog, id FROM scenes WHERE minx <= 40 AND maxx >= -40 AND miny <= 40 AND maxy >= -40 AND cloud <= 30 AND CAST(dt AS DATE) BETWEEN DATE '1995-06-01' AND DATE '1995-08-31'", "scenes"))
def _(s, d):
    slices = S.season_slices(dt.date(1995, 3, 1), dt.date(1995, 12, 31), ["summer"])
    return mo.scene_search(fx.scenes(s, d), (-40, -40, 40, 40), slices, 30.0).select("catalog", "id")


@query("p8_u3_federate_scenes", wv("SELECT catalog, id, collection FROM scenes", "scenes"))
def _(s, d):
    scenes = fx.scenes(s, d)
    again = scenes.where("cloud < 50").withColumn("collection", F.lit("later"))
    return mo.federate(scenes, again).select("catalog", "id", "collection")


WINDOWS = """WITH s AS (SELECT cloud, CAST(dt AS DATE) AS day FROM scenes), c AS (SELECT d.anchor, count(*) AS n, round(avg(cloud), 6) AS cloud
 FROM (SELECT DISTINCT day AS anchor FROM s) d JOIN s ON s.day BETWEEN d.anchor - 3 AND d.anchor + 3 GROUP BY 1)"""


@query("j9_date_windows", wv(f"{WINDOWS} SELECT anchor, n, cloud FROM c", "scenes"))
def _(s, d):
    return mo.window_costs(fx.scenes(s, d))


@query("a12_best_window", wv(f"{WINDOWS} SELECT anchor, cloud, n FROM c ORDER BY cloud, n DESC, anchor LIMIT 1", "scenes"))
def _(s, d):
    return mo.best_window(fx.scenes(s, d))


@query(
    "j7_m5_swap_options",
    wv(
        """WITH sel AS (SELECT * FROM scenes WHERE cloud >= 98), m AS (SELECT x.id, s.id AS id_s, x.cloud FROM sel s JOIN scenes x ON x.mgrs = s.mgrs AND x.id <> s.id
 AND x.minx < s.maxx AND s.minx < x.maxx AND x.miny < s.maxy AND s.miny < x.maxy)
SELECT id, id_s, place, total FROM (SELECT id, id_s, row_number() OVER (PARTITION BY id_s ORDER BY cloud NULLS LAST, id) AS place, count(*) OVER (PARTITION BY id_s) AS total FROM m) WHERE place <= 5""",
        "scenes",
    ),
)
def _(s, d):
    scenes = fx.scenes(s, d)
    return mo.swap_options(scenes.where("cloud >= 98"), scenes).select("id", "id_s", "place", "total")


TX = "least(greatest(CAST(floor(({} + 180) / 360 * 64) AS BIGINT), 0), 63)"
TY = "least(greatest(CAST(floor((1 - ln(tan(radians(least(greatest({0}, -85), 85))) + 1 / cos(radians(least(greatest({0}, -85), 85)))) / pi()) / 2 * 64) AS BIGINT), 0), 63)"
QK = " || ".join(f"CAST((x >> {i}) % 2 + 2 * ((y >> {i}) % 2) AS VARCHAR)" for i in range(5, -1, -1))


@query("t2_tiles_for", wv(f"WITH r AS (SELECT id, unnest(range({TX.format('minx')}, {TX.format('maxx')} + 1)) AS x, {TY.format('maxy')} AS y1, {TY.format('miny')} AS y2 FROM parcels), t AS (SELECT id, x, unnest(range(y1, y2 + 1)) AS y FROM r) SELECT id, x, y, {QK} AS quadkey FROM t", "parcels"))
def _(s, d):
    return tl.tiles_for(fx.parcels(s, d), 6).select("id", "x", "y", "quadkey")


@query("t1_tile_boxes", "SELECT s_suppkey, round(x / 64.0 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 64.0)))), 6) AS north, round(radians(x / 64.0 * 360 - 180) * 6378137.0, 3) AS mx1 FROM (SELECT s_suppkey, s_suppkey % 64 AS x, s_suppkey * 7 % 64 AS y FROM supplier)")
def _(s, d):
    tiles = fx.table(s, d, "supplier").select("s_suppkey", F.lit(6).alias("z"), (F.col("s_suppkey") % 64).alias("x"), (F.col("s_suppkey") * 7 % 64).alias("y"))
    return tl.tile_boxes(tiles).select("s_suppkey", F.round("west", 6).alias("west"), F.round("north", 6).alias("north"), F.round("mx1", 3).alias("mx1"))


def _assign_sql() -> str:
    lat = "(1 - ln(tan(radians(least(greatest({0}, -85), 85))) + 1 / cos(radians(least(greatest({0}, -85), 85)))) / pi()) / 2 * n"
    lo, hi = "CAST(greatest(floor(round({} - 0.0625, 9)), 0) AS BIGINT)", "CAST(least(floor(round({} + 0.0625, 9)), n - 1) AS BIGINT)"
    x = [f.format(f"({c} + 180) / 360 * n") for f, c in ((lo, "minx"), (hi, "maxx"))]
    y = [f.format(lat.format(c)) for f, c in ((lo, "maxy"), (hi, "miny"))]
    return wv(
        f"""WITH z AS (SELECT *, power(2, z) AS n FROM parcels, (SELECT unnest(range(0, 7)) AS z)), r AS (SELECT id, z, unnest(range({x[0]}, {x[1]} + 1)) AS x, {y[0]} AS y1, {y[1]} AS y2 FROM z)
SELECT z, count(*) AS n, count(DISTINCT x * 100000 + y) AS tiles FROM (SELECT z, x, unnest(range(y1, y2 + 1)) AS y FROM r) GROUP BY 1""",
        "parcels",
    )


@query("t3_tile_pyramid", _assign_sql())
def _(s, d):
    tiles = tl.assign_tiles(fx.parcels(s, d).select("id", *sp.BOX), 0, 6)
    return tiles.groupBy("z", "x", "y").agg(F.count("*").alias("n")).groupBy("z").agg(F.sum("n").alias("n"), F.count("*").alias("tiles"))


def _cap_sql() -> str:
    head = _assign_sql().replace("range(0, 7)", "range(2, 3)").replace("SELECT id, z, unnest", "SELECT id, (maxx - minx) * (maxy - miny) AS area, z, unnest")
    place = "row_number() OVER (PARTITION BY z, x, y ORDER BY area DESC, id) AS place"
    return head[: head.index("SELECT z, count(*)")] + f"SELECT z, x, y, id FROM (SELECT *, {place} FROM (SELECT id, area, z, x, unnest(range(y1, y2 + 1)) AS y FROM r)) WHERE place <= 20"


@query("t8_cap_tiles", _cap_sql())
def _(s, d):
    sized = fx.parcels(s, d).selectExpr("id", *sp.BOX, "(maxx - minx) * (maxy - miny) as area")
    return tl.cap_tiles(tl.assign_tiles(sized, 2, 2), 20).select("z", "x", "y", "id")


@query("t9_stale_tiles", wv("SELECT collection_id FROM (SELECT collection_id, max(updated_at) AS u FROM parcels GROUP BY 1) WHERE collection_id <> 'parcels_F' OR u > TIMESTAMP '1999-01-01'", "parcels"))
def _(s, d):
    c = fx.parcels(s, d).groupBy("collection_id").agg(F.max("updated_at").alias("last_updated"))
    built = s.createDataFrame([("parcels_F", dt.datetime(1999, 1, 1))], "collection_id string, features_updated_at timestamp")
    return tl.stale(c, built).select("collection_id")


def _index_sql() -> str:
    x, y = (t.replace("64", "32").replace("63", "31") for t in (TX, TY))
    key = QK.split(" || ", 1)[1]  # five digits
    tiles = f"""r AS (SELECT cloud, id, href, unnest(range({x.format('(minx - 1e-5)')}, {x.format('(maxx + 1e-5)')} + 1)) AS x, {y.format('(maxy + 1e-5)')} AS y1, {y.format('(miny - 1e-5)')} AS y2 FROM scenes),
 t AS (SELECT cloud, id, href, x, unnest(range(y1, y2 + 1)) AS y FROM r)"""
    return wv(f"WITH {tiles} SELECT {key} AS quadkey, CAST(count(*) AS INT) AS n, first(href ORDER BY cloud, id) AS first FROM t GROUP BY 1", "scenes")


@query("m8_mosaic_index", _index_sql())
def _(s, d):
    return mo.mosaic_index(fx.scenes(s, d), 5).select("quadkey", F.size("assets").alias("n"), F.get("assets", 0).alias("first"))


@query("m6_gap_boxes", wv("SELECT id, cx - h AS sx1, cy + h AS sy2 FROM (SELECT id, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy, least(greatest(sqrt((maxx - minx) * (maxy - miny)) * 0.32, 0.0025), 0.11) AS h, row_number() OVER (PARTITION BY collection_id ORDER BY (maxx - minx) * (maxy - miny) DESC, id) AS k FROM parcels) WHERE k <= 16", "parcels"))
def _(s, d):
    gaps = fx.parcels(s, d).selectExpr("collection_id as aoi", "id", *sp.BOX, "(maxx - minx) * (maxy - miny) as area")
    return mo.coverage_gaps(gaps).select("id", "sx1", "sy2")


@query("x4_mgrs_tile", wv("SELECT id, substr(mgrs, 2) AS tile, substr(mgrs, 2) AS short, CASE WHEN cloud < 50 THEN '01ABC' ELSE substr(mgrs, 2) END AS own FROM scenes", "scenes"))
def _(s, d):
    scenes = fx.scenes(s, d)
    short = F.concat(F.lit("s2b_"), F.substring("mgrs", 2, 5), F.lit("_20250101_0"))
    given = F.when(F.col("cloud") < 50, F.lit(" granule_01abc L2A"))
    return scenes.select("id", S.mgrs_tile(F.col("id")).alias("tile"), S.mgrs_tile(short).alias("short"), S.mgrs_tile(F.col("id"), F.lit("none"), given).alias("own"))


@query("x2_x3_scalars", "SELECT p_partkey, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0) ELSE printf('%.2f MB', b / 1048576.0) END AS size, replace(replace(p_type, '%', '\\%'), '_', '\\_') AS escaped FROM (SELECT p_partkey, p_type, p_size * p_size * 700 AS b FROM part)")
def _(s, d):
    b = F.col("p_size") * F.col("p_size") * 700
    return fx.table(s, d, "part").select("p_partkey", S.format_bytes(b).alias("size"), S.like_escape(F.col("p_type")).alias("escaped"))
