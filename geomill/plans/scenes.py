"""Queries over readers, loading, scene items, mosaic plans and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..functions import scenes as sc
from ..operators import cover as cv
from ..operators import filters as fl
from ..operators import mosaics as mo
from ..operators import overlay as ov
from ..operators import paging as pg
from ..operators import previews as pv
from ..operators import spatial as sp
from ..operators import snapshots as sn
from ..operators import tables as tb
from ..operators import tiles as tl
from ..sources import fixtures as fx
from ..sources import readers as rd
from ..sources.fixtures import with_views as wv
from ..streaming import metrics as st
from . import places
from .features import staged

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


POINTS = wv("SELECT id, lon AS minx, lat AS maxy, event_type AS type FROM points", "points")


def _features(s, d):
    """Points as GeoJSON features, one text each."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    props = F.struct(fl.prop("event_type").alias("event_type"))
    return fx.points(s, d).select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), "id", point.alias("geometry"), props.alias("properties"))).alias("value"))


@query("s2_read_geojson", POINTS)
def _(s, d):
    """Points are written as FeatureCollections of about 1000 features, one file each, and read back."""
    each = _features(s, d)
    held = each.withColumn("k", F.floor(F.col("id").cast("long") / 1000)).groupBy("k").agg(F.array_join(F.collect_list("value"), ",").alias("f"))
    path = rd.shared_path(s, "geojson")
    held.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    good, _ = rd.read_geojson(s, path, "points")
    return good.select("id", "minx", "maxy", fl.prop("event_type").alias("type"))


@query("s3_read_kml", POINTS)
def _(s, d):
    """Points are written as placemarks and read back."""
    place = F.struct(F.concat_ws(",", "lon", "lat", F.lit("0")).alias("coordinates"))
    path = rd.shared_path(s, "kml")
    marks = fx.points(s, d).select(F.col("id").alias("_id"), fl.prop("event_type").alias("name"), place.alias("Point"))
    marks.write.format("xml").option("rootTag", "kml").option("rowTag", "Placemark").save(path)
    return rd.read_kml(s, path, "points").select("id", "minx", "maxy", fl.prop("name").alias("type"))


@query("s6_list_files", None)
def _(s, d):
    return rd.list_files(s, d).select("path", "length", "modified")


def _items(s, d):
    """Scene items as JSON; every second one has a geometry of two polygons, the smaller one first, the others only a bbox."""
    q = fx.scenes(s, d).withColumn("k", F.regexp_extract("href", r"(\d+)\.tif", 1).cast("long"))
    ring = lambda f: f"array(array(minx, miny), array(minx + (maxx - minx) * {f}, miny), array(minx + (maxx - minx) * {f}, maxy), array(minx, maxy), array(minx, miny))"
    shape = F.expr(f"if(k % 2 = 0, named_struct('type', 'MultiPolygon', 'coordinates', array(array({ring('0.25D')}), array({ring('0.5D')}))), null)")
    names = F.expr("map_filter(map('visual', if(k % 3 = 0, named_struct('href', concat('https://x/', k, '/v'), 'type', '', 'roles', array('visual')), null), 'data', named_struct('href', concat('https://x/', k, '.tif'), 'type', 'image/tiff', 'roles', array('data')), 'shown', if(k % 5 = 0, named_struct('href', concat('https://x/', k, '/t'), 'type', '', 'roles', array('Thumbnail')), null)), (n, a) -> a is not null)")
    props = F.expr("if(k % 4 = 0, map('cloud', cast(cloud as string), 'datetime', 'none', 'start_datetime', date_format(dt, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")), map('eo:cloud_cover', cast(cloud as string), 'datetime', date_format(dt, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")))")
    item = F.struct("id", "collection", shape.alias("geometry"), F.array("minx", "miny", "maxx", "maxy").alias("bbox"), props.alias("properties"), names.alias("assets"))
    return q.select("catalog", F.to_json(item).alias("value"))


@query("s7_read_scenes", wv("""SELECT CASE WHEN catalog < '3' THEN 'first' ELSE 'second' END AS catalog, id, collection, cloud, dt,
 CASE WHEN o_orderkey % 3 = 0 THEN 'https://x/' || o_orderkey || '/v' ELSE 'https://x/' || o_orderkey || '.tif' END AS href,
 CASE WHEN o_orderkey % 5 = 0 THEN 'https://x/' || o_orderkey || '/t' END AS thumbnail,
 (maxx - minx) * (maxy - miny) * CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE ELSE 1 END AS area
 FROM (SELECT *, CAST(regexp_extract(href, '(\\d+)\\.tif', 1) AS BIGINT) AS o_orderkey FROM scenes)""", "scenes"))  # fmt: skip
def _(s, d):
    """Scene items are written by two catalogs and read back: footprint, date, cloud cover and addresses by their fallbacks."""
    items, paths = _items(s, d), {"first": rd.shared_path(s, "items"), "second": rd.shared_path(s, "items")}
    items.where("catalog < '3'").select("value").write.text(paths["first"])
    items.where("catalog >= '3'").select("value").write.text(paths["second"])
    found = rd.read_scenes(s, paths)
    return found.select("catalog", "id", "collection", "cloud", "dt", "href", "thumbnail", G.planar_area(F.col("rings")).alias("area"))


@query("b1_bulk_append", wv("SELECT collection_id, count(DISTINCT id) AS feature_count, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, max(CASE WHEN o_orderkey % 7 = 0 THEN updated_at + INTERVAL 1 DAY ELSE updated_at END) AS last_updated FROM parcels GROUP BY 1", "parcels"))
def _(s, d):
    return tb.bulk_append(staged(s, d), rd.shared_path(s, "features"))


@query("b7_simple_parts", wv("SELECT id, 3 AS n_parts, (maxx - minx) * (maxy - miny) * 1.5::DOUBLE AS area FROM parcels", "parcels"))
def _(s, d):
    tie, box = "array(array(minx, miny, maxx, maxy, maxx, miny, minx, maxy))", "array(array(minx, miny, maxx, miny, maxx, maxy, minx, maxy))"
    parts = ov.simple_parts(fx.parcels(s, d).withColumn("polygons", F.expr(f"array({tie}, {box})")))
    return parts.groupBy("id").agg(F.count("*").cast("int").alias("n_parts"), F.round(F.sum(G.planar_area(F.col("rings"))), 9).alias("area"))


@query("r6_ingest_stream", POINTS)
def _(s, d):
    """GeoJSON lines arrive in a folder, each twice, and are read as a stream that keeps one."""
    folder, path = rd.shared_path(s, "arrivals"), rd.shared_path(s, "ingested")
    lines = _features(s, d).select("value")
    lines.unionAll(lines).write.text(folder)
    st.run_to_table(st.ingest_stream(s, folder, "points"), path, rd.shared_path(s, "ingest-log"))
    return s.read.parquet(path).select("id", "minx", "maxy", fl.prop("event_type").alias("type"))


@query("p5_page_summary", wv("WITH pg AS (SELECT collection_id, id FROM parts WHERE status = 'O' GROUP BY 1, 2 ORDER BY id, collection_id LIMIT 200 OFFSET 100) SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, (SELECT count(DISTINCT id) FROM parts WHERE status = 'O') AS number_matched FROM parts JOIN pg USING (collection_id, id)", "parts"))
def _(s, d):
    return pg.page_summary(fl.property_filter(fx.parts(s, d), status="O"), limit=200, offset=100)


@query("p8_last_wins", wv("SELECT catalog, collection, id, cloud < 50 AS again FROM scenes", "scenes"))
def _(s, d):
    scenes = fx.scenes(s, d)
    return mo.dedupe_scenes([scenes, scenes.where("cloud < 50")], last=True).select("catalog", "collection", "id", (F.col("ord") == 1).alias("again"))


@query("x1_safe_keys", "SELECT p_partkey, left(regexp_replace(p_name || ' #' || p_type, '[^A-Za-z0-9_.:-]', '', 'g'), 200) AS name FROM part")
def _(s, d):
    return fx.table(s, d, "part").select("p_partkey", S.safe_json_key(F.concat("p_name", F.lit(" #"), "p_type")).alias("name"))


_RANGES = "o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS b FROM orders)"


def _slices(s, d, seasons=None):
    """Slices of ranges of up to 399 days; the bounds are given in reverse order."""
    a, b = F.to_date("o_orderdate"), F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 400 as int))")
    return fx.table(s, d, "orders").select("o_orderkey", F.explode(sc.date_slices(b, a, seasons)).alias("x")).select("o_orderkey", "x.first_day", "x.last_day")


@query("x5_month_slices", f"WITH {_RANGES}, m AS (SELECT *, CAST(unnest(range(date_trunc('month', a), b + 1, INTERVAL 1 MONTH)) AS DATE) AS m FROM o WHERE b - a > 31) SELECT o_orderkey, greatest(m, a) AS first_day, least(last_day(m), b) AS last_day FROM m UNION ALL SELECT o_orderkey, a, b FROM o WHERE b - a <= 31")
def _(s, d):
    return _slices(s, d)


@query("x5_season_slices", f"WITH {_RANGES}, y AS (SELECT *, unnest(range(year(a), year(b) + 1)) AS y FROM o), t AS (SELECT *, make_date(y, 6, 1) AS s1, make_date(y, 8, 31) AS s2 FROM y UNION ALL SELECT *, make_date(y, 12, 1), make_date(y, 12, 31) FROM y UNION ALL SELECT *, make_date(y + 1, 1, 1), make_date(y + 1, 2, 28) FROM y), m AS (SELECT o_orderkey, greatest(s1, a) AS first_day, least(s2, b) AS last_day FROM t WHERE s1 <= b AND s2 >= a) SELECT * FROM m UNION ALL SELECT o_orderkey, a, b FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM m)")
def _(s, d):
    return _slices(s, d, ["summer", "winter"])


def _tile_sql() -> str:
    head = places._assign_sql().replace("range(0, 7)", "range(5, 6)").replace("SELECT id, z, unnest", "SELECT id, minx, miny, maxx, maxy, n, z, unnest")
    across = lambda c: f"floor(round((({c} + 180) / 360 * n - x) * 4096, 6) + 0.5)"
    down = lambda c: f"floor(round(((1 - ln(tan(radians(least(greatest({c}, -85), 85))) + 1 / cos(radians(least(greatest({c}, -85), 85)))) / pi()) / 2 * n - y) * 4096, 6) + 0.5)"
    box = f"greatest({across('minx')}, -256) AS x1, least({across('maxx')}, 4352) AS x2, greatest({down('maxy')}, -256) AS y1, least({down('miny')}, 4352) AS y2"
    return head[: head.index("SELECT z, count(*)")] + f"SELECT id, x, y, x1, y1, x2, y2 FROM (SELECT id, x, y, {box} FROM (SELECT * EXCLUDE (y1, y2), unnest(range(y1, y2 + 1)) AS y FROM r)) WHERE x2 > x1 AND y2 > y1"


@query("t5_tile_polygons", _tile_sql())
def _(s, d):
    boxes = fx.parcels(s, d).withColumn("rings", G.box_rings(*sp.BOX)).select("id", "rings", *sp.BOX)
    cut = ov.with_box(tl.tile_polygons(boxes, 5, 5))
    return cut.select("id", "x", "y", F.col("minx").alias("x1"), F.col("miny").alias("y1"), F.col("maxx").alias("x2"), F.col("maxy").alias("y2"))


@query("m1_scene_footprint", wv("SELECT id, minx, miny, CASE WHEN k % 2 = 0 THEN (minx + maxx) / 2 ELSE maxx END AS maxx, maxy FROM (SELECT *, CAST(regexp_extract(href, '(\\d+)\\.tif', 1) AS BIGINT) AS k FROM scenes)", "scenes"))
def _(s, d):
    f = _items(s, d).select(F.from_json("value", rd.ITEM).alias("f"))
    rings = sc.footprint(F.col("f.geometry.type"), F.col("f.geometry.coordinates"), F.col("f.bbox"))
    return ov.with_box(f.select("f.id", rings.alias("rings"))).select("id", *sp.BOX)


def areas(s, d):
    """The middle of each zone, 12 by 8 degrees."""
    mid = {"minx": "minx + 30", "miny": "miny + 13", "maxx": "minx + 42", "maxy": "miny + 21"}
    return fx.zones(s, d).selectExpr("id as aoi", *(f"{e} as {c}" for c, e in mid.items())).withColumn("rings", G.box_rings(*sp.BOX))


def footprints(s, d):
    return fx.scenes(s, d).withColumn("rings", G.box_rings(*sp.BOX))


@query("m2_greedy_cover", None)
def _(s, d):
    """SQL has no loop over areas; tests compare with greedy picks on a grid of squares."""
    return cv.cover(areas(s, d), footprints(s, d)).select("aoi", "kind", "place", "id", F.round("area", 9).alias("area"), F.round("uncovered", 9).alias("uncovered"))


@query("m3_same_pass_strips", None)
def _(s, d):
    return cv.cover(areas(s, d), footprints(s, d), mode="strips").select("aoi", "kind", "place", "id", F.round("area", 9).alias("area"), F.round("uncovered", 9).alias("uncovered"))


@query("m4_plan_mosaic", None)
def _(s, d):
    """Picked scenes of a search, with the number of scenes that could take each one's place."""
    plan, swaps = cv.plan_mosaic(areas(s, d), footprints(s, d), max_cloud=60.0, prefer="newest")
    picks = plan.where("kind = 'pick'").select("aoi", "place", "id")
    return picks.join(swaps.select(F.col("id_s").alias("id"), "total").distinct(), "id", "left").select("aoi", "place", "id", F.coalesce("total", F.lit(0)).alias("others"))


@query("m9_collection_pairs", "SELECT CAST(l_suppkey AS VARCHAR) AS collection_id, count(*) AS total, count(*) FILTER (l_orderkey % 7 = 0) AS no_href, count(*) FILTER (l_orderkey % 7 <> 0 AND l_linenumber = 3) AS no_shape FROM lineitem GROUP BY 1")
def _(s, d):
    box = "array(array(0D, 0D, 1D, 0D, 1D, 1D, 0D, 1D))"
    items = fx.table(s, d, "lineitem").selectExpr(
        "cast(l_suppkey as string) as collection_id", "concat(l_orderkey, '-', l_linenumber) as id", "if(l_orderkey % 7 = 0, null, concat('/cog/', l_orderkey)) as href",
        f"if(l_linenumber < 3, {box}, null) as rings", "if(l_linenumber = 3, null, array(0D, 0D, 2D, 2D)) as bounds",
    )
    return cv.collection_pairs(items)[1]


@query("m11_data_footprint", None)
def _(s, d):
    """Tests compare blobs and holes with a flood fill."""
    grey = {c: F.expr(f"cast((l_quantity * {k} + l_partkey) % 256 as int)") for k, c in ((5, "red"), (5, "green"), (6, "blue"))}
    pixels = fx.table(s, d, "lineitem").select(F.expr("l_suppkey % 4 as raster_id"), F.expr("l_orderkey % 48 as px"), F.expr("l_partkey % 40 as py"), *(v.alias(c) for c, v in grey.items()))
    return pv.data_footprint(pixels)


@query("m11_block_footprint", None)
def _(s, d):
    """A raster for each 25 suppliers, so rasters grow in number with the data, in blocks smaller than a raster."""
    grey = F.expr("cast((l_quantity * 5 + l_partkey) % 256 as int)")
    pixels = fx.table(s, d, "lineitem").select(F.expr("l_suppkey div 25 as raster_id"), F.expr("l_orderkey % 48 as px"), F.expr("l_partkey % 40 as py"), *(grey.alias(c) for c in ("red", "green", "blue")))
    return pv.data_footprint(pixels, 16)


@query(
    "s5_snapshot_table",
    wv(
        """SELECT 'now' AS version, collection_id, count(*) AS n, count(DISTINCT id) AS ids FROM (
 SELECT id, collection_id FROM parcels WHERE status <> 'P' AND NOT (status = 'F' AND job IS NOT DISTINCT FROM 'job1') UNION ALL SELECT id, collection_id FROM parcels WHERE status = 'P' AND rank < 10 UNION ALL SELECT 'more-' || id, collection_id FROM parcels WHERE status = 'O' AND rank = 7) GROUP BY ALL
UNION ALL SELECT 'first', collection_id, count(*), count(DISTINCT id) FROM parcels GROUP BY ALL""",
        "parcels",
    ),
)
def _(s, d):
    """A load, the rollback of a job in one collection, a replacement of another and an append, then the newest and the first version."""
    p, path = fx.parcels(s, d), rd.shared_path(s, "snapshots")
    sn.append(p, path)
    sn.rewrite(s, path, "parcels_F", lambda rows: tb.rollback_job(rows, "job1"))
    rank = F.get_json_object("properties", "$.rank").cast("int")
    sn.replace(p.where((F.col("collection_id") == "parcels_P") & (rank < 10)), path)
    sn.append(p.where((F.col("collection_id") == "parcels_O") & (rank == 7)).withColumn("id", F.concat(F.lit("more-"), "id")), path)
    sizes = lambda df, name: df.groupBy("collection_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).select(F.lit(name).alias("version"), "collection_id", "n", "ids")
    return sizes(sn.read(s, path), "now").union(sizes(sn.read(s, path, 1), "first"))
