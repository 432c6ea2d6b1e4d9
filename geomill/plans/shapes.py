"""Queries over general polygons and what is derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rings as R
from ..operators import lines as ln
from ..operators import measures as ms
from ..operators import mosaics as mo
from ..operators import outlines as ol
from ..operators import overlay as ov
from ..operators import spatial as sp
from ..operators import tables as tb
from ..sources import fixtures as fx
from ..sources import readers as rd
from ..sources.fixtures import with_views as wv
from ..sources.readers import shared_path

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def boxes(s, d, status=None):
    p = fx.parcels(s, d).withColumn("rings", G.box_rings(*sp.BOX))
    return p if status is None else p.where(F.col("collection_id") == f"parcels_{status}")


def lots(s, d, scale=1):
    """Parcels, `scale` times as long and high, without the triangle at their upper right corner between the middles of two sides."""
    mx, my = "(minx + maxx) / 2", "(miny + maxy) / 2"
    grown = {f"max{c}": F.expr(f"min{c} + (max{c} - min{c}) * {scale}") for c in "xy"}
    return fx.parcels(s, d).withColumns(grown).withColumn("rings", F.expr(f"array(array(minx, miny, maxx, miny, maxx, {my}, {mx}, maxy, minx, maxy, minx, miny))"))


def area_by(parts, *keys):
    return parts.groupBy(*keys).agg(F.round(F.sum(R.area("rings")), 6).alias("area"))


# Parcels as sets of squares of 1/8 degree, on which they lie exactly.
SQUARES = """SELECT id, status, gx, unnest(range(CAST(miny * 8 AS BIGINT), CAST(maxy * 8 AS BIGINT))) AS gy FROM
 (SELECT id, status, miny, maxy, unnest(range(CAST(minx * 8 AS BIGINT), CAST(maxx * 8 AS BIGINT))) AS gx FROM parcels)"""


@query("g1_dissolve_by_status", wv(f"SELECT status AS key, count(DISTINCT gx * 100000 + gy) / 64.0::DOUBLE AS area FROM ({SQUARES}) GROUP BY 1", "parcels"))
def _(s, d):
    status = F.get_json_object("properties", "$.status")
    return area_by(ov.dissolve(boxes(s, d), status, 4.0), "key")


@query("g1_dissolve_all", wv(f"SELECT '_all' AS key, count(DISTINCT gx * 100000 + gy) / 64.0::DOUBLE AS area FROM ({SQUARES})", "parcels"))
def _(s, d):
    return area_by(ov.dissolve(boxes(s, d), None, 2.0), "key")


def _rings_of(squares: str, *keys: str) -> str:
    """keys, n_points and area of the region of `squares`(keys, gx, gy): a ring has a corner where one or three of the four squares
    around a point are there, and two rings have one, or one ring two, where two opposite ones are."""
    k = ", ".join(keys)
    corners = " UNION ALL ".join(f"SELECT {k}, gx + {x} AS px, gy + {y} AS py, {bit} AS bit FROM s" for x, y, bit in ((0, 0, 1), (1, 0, 2), (1, 1, 4), (0, 1, 8)))
    return f"""s AS (SELECT DISTINCT {k}, gx, gy FROM ({squares})), quads AS (SELECT {k}, px, py, sum(bit) AS bits FROM ({corners}) GROUP BY ALL),
 rings AS (SELECT {k}, sum(CASE WHEN bits IN (5, 10) THEN 2 WHEN bit_count(bits::BIGINT) IN (1, 3) THEN 1 ELSE 0 END)::BIGINT AS n_points FROM quads GROUP BY ALL),
 areas AS (SELECT {k}, count(*) / 64.0::DOUBLE AS area FROM s GROUP BY ALL)"""


#: Regions of squares that share sides, counted over runs of squares: a run takes the least number of a run it reaches.
_REGIONS = """runs AS (SELECT key, gy, min(gx) AS x1, max(gx) AS x2, row_number() OVER () AS n FROM (SELECT *, gx - row_number() OVER (PARTITION BY key, gy ORDER BY gx) AS g FROM s) GROUP BY key, gy, g),
 near AS (SELECT a.n AS a, b.n AS b FROM runs a JOIN runs b ON a.key = b.key AND abs(a.gy - b.gy) = 1 AND a.x1 <= b.x2 AND b.x1 <= a.x2),
 reach AS (SELECT n, n AS label FROM runs UNION SELECT near.b, reach.label FROM reach JOIN near ON near.a = reach.n),
 counted AS (SELECT key, count(*) AS n_polygons FROM (SELECT key, n FROM runs JOIN reach USING (n) GROUP BY key, n HAVING min(label) = n) GROUP BY key)"""


def outlined(polys, *keys):
    """keys, the number of polygons and of their corners, and the area."""
    points = G.n_points(F.col("rings")) - F.size("rings")
    return polys.groupBy(*keys).agg(F.count("*").alias("n_polygons"), F.sum(points).cast("long").alias("n_points"), F.round(F.sum(R.area("rings")), 6).alias("area"))


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("g1_polygons_by_status", _recursive(wv(f"WITH {_rings_of(f'SELECT status AS key, gx, gy FROM ({SQUARES})', 'key')}, {_REGIONS} SELECT key, n_polygons, n_points, area FROM rings JOIN areas USING (key) JOIN counted USING (key)", "parcels")))
def _(s, d):
    """The union as polygons with holes, over cells of 4 degrees."""
    return outlined(ol.dissolved(boxes(s, d), F.get_json_object("properties", "$.status"), 4.0), "key")


@query("g1_polygons_all", _recursive(wv(f"WITH {_rings_of(f'SELECT 1 AS key, gx, gy FROM ({SQUARES})', 'key')}, {_REGIONS} SELECT '_all' AS key, n_polygons, n_points, area FROM rings JOIN areas USING (key) JOIN counted USING (key)", "parcels")))
def _(s, d):
    return outlined(ol.dissolved(boxes(s, d), None, 2.0), "key")


@query("g2_polygons", wv("SELECT a.id, b.id AS id_b, 1 AS n_polygons, 4 AS n_points, (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS area FROM parcels a JOIN parcels b ON a.status = 'P' AND b.status = 'O' AND a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy", "parcels"))
def _(s, d):
    out = ov.intersections(boxes(s, d, "P"), boxes(s, d, "O"), made=ol.assemble, value=R.outline, keys=())
    return out.select("id", "id_b", "value.n_polygons", "value.n_points", F.round("value.area", 6).alias("area"))


@query("a1_united_parts", wv("SELECT collection_id, id, 1 AS n_polygons, 4 AS n_points, (maxx - minx) * (maxy - miny) AS area FROM parcels", "parcels"))
def _(s, d):
    """Logical features whose parts are united: the two halves of a cut parcel are one box again."""
    return outlined(ol.united_parts(halves(s, d), 4.0), "collection_id", "id")


def halves(s, d):
    """Parts of parcels with rings; every fifth parcel is two halves, of which the second reaches into the first."""
    reach = F.when(F.col("part_index") == 1, F.col("minx") - (F.col("maxx") - F.col("minx")) / 2).otherwise(F.col("minx"))
    return fx.parts(s, d).withColumn("minx", reach).withColumn("rings", G.box_rings(*sp.BOX))


@query("p1_page_geometry", wv("SELECT row_number() OVER (ORDER BY created_at DESC, id) AS place, id, 1 AS n_polygons, minx, miny, maxx, maxy, (maxx - minx) * (maxy - miny) AS area FROM parcels ORDER BY created_at DESC, id LIMIT 200", "parcels"))
def _(s, d):
    paged = ol.page_geometry(halves(s, d), sortby="created_at", descending=True, limit=200)
    area = F.aggregate("polygons", F.lit(0.0), lambda n, rings: n + G.planar_area(rings))
    return paged.select("place", "id", F.size("polygons").alias("n_polygons"), *sp.BOX, F.round(area, 6).alias("area"))


@query("g2_polygon_intersection", None)
def _(s, d):
    """Large lots with large lots: SQL has no polygon clip; tests compare the kernel with sampled points."""
    every = lots(s, d, 4)
    f, o = (every.where(F.col("collection_id") == f"parcels_{k}") for k in "FO")
    area = lambda polygons: F.round(R.total_area(polygons), 9)
    return ov.intersections(f, o, 4.0, value=area).withColumnRenamed("value", "area")


@query("g3_feature_layers", wv("SELECT id, collection_id AS _layer, (least(maxx, 12) - greatest(minx, -12)) * (least(maxy, 12) - greatest(miny, -12)) AS area FROM parcels WHERE status IN ('O', 'F') AND minx < 12 AND maxx > -12 AND miny < 12 AND maxy > -12", "parcels"))
def _(s, d):
    layers = boxes(s, d).where(F.col("collection_id").isin("parcels_O", "parcels_F") & F.expr("minx < 12 and maxx > -12 and miny < 12 and maxy > -12"))
    parts = ov._rowwise(layers, ["id", "collection_id"], ["rings"], lambda r: [[x] for x in ov.overlay([(0, r), (1, [[-12, -12, 12, -12, 12, 12, -12, 12]])], all)])
    return area_by(parts, "id", F.col("collection_id").alias("_layer"))


LEFT = f"WITH q AS ({SQUARES}), f AS (SELECT DISTINCT gx, gy FROM q WHERE status IN ('F', 'O'))"


@query("g4_erase", wv(f"{LEFT} SELECT id, count(*) / 64.0::DOUBLE AS area FROM q WHERE status = 'P' AND NOT EXISTS (SELECT 1 FROM f WHERE f.gx = q.gx AND f.gy = q.gy) GROUP BY 1", "parcels"))
def _(s, d):
    others = boxes(s, d).where("collection_id <> 'parcels_P'")
    return area_by(ov.erase(boxes(s, d, "P"), others), "id")


_LEFT_OVER = "SELECT id, gx, gy FROM q WHERE status = 'P' AND NOT EXISTS (SELECT 1 FROM f WHERE f.gx = q.gx AND f.gy = q.gy)"


@query("g4_erase_polygons", wv(f"{LEFT}, {_rings_of(_LEFT_OVER, 'id')} SELECT id, n_points, area FROM rings JOIN areas USING (id)", "parcels"))
def _(s, d):
    """What the others leave of each parcel, as polygons over cells of half a degree, so that most are put together across cells."""
    return outlined(ol.erased(boxes(s, d, "P"), boxes(s, d).where("collection_id <> 'parcels_P'"), 0.5), "id").drop("n_polygons")


_FREE = "SELECT 1 AS id, w.gx, w.gy FROM (SELECT x.gx, y.gy FROM (SELECT unnest(range(-96, 96)) AS gx) x, (SELECT unnest(range(-96, 96)) AS gy) y) w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.gx = w.gx AND f.gy = w.gy)"


@query("g5_erase_polygons", wv(f"{LEFT}, {_rings_of(_FREE, 'id')} SELECT 'box' AS id, n_points, area FROM rings JOIN areas USING (id)", "parcels"))
def _(s, d):
    box = s.createDataFrame([("box", -12.0, -12.0, 12.0, 12.0)], "id string, minx double, miny double, maxx double, maxy double").withColumn("rings", G.box_rings(*sp.BOX))
    return outlined(ol.erased(box, boxes(s, d).where("collection_id <> 'parcels_P'"), 2.0), "id").drop("n_polygons")


@query("g5_erase_feature", wv(f"{LEFT} SELECT 'box' AS id, 24 * 24 - count(*) / 64.0::DOUBLE AS area FROM f WHERE gx >= -96 AND gx < 96 AND gy >= -96 AND gy < 96", "parcels"))
def _(s, d):
    box = s.createDataFrame([("box", -12.0, -12.0, 12.0, 12.0)], "id string, minx double, miny double, maxx double, maxy double").withColumn("rings", G.box_rings(*sp.BOX))
    return area_by(ov.erase(box, boxes(s, d).where("collection_id <> 'parcels_P'"), 4.0), "id")


@query("g6_buffer", wv("SELECT id, round((maxx - minx) * (maxy - miny) + 2 * (maxx - minx + maxy - miny) * 0.25 + 0.0625 * 32 * sin(2 * pi() / 64), 6) AS area, maxx + 0.25 AS maxx FROM parcels", "parcels"))
def _(s, d):
    grown = ov.with_box(ov.buffer(boxes(s, d), 0.25))
    return grown.groupBy("id").agg(F.round(F.sum(R.area("rings")), 6).alias("area"), F.round(F.max("maxx"), 6).alias("maxx"))


@query("g8_make_valid", wv("SELECT id, 2 AS n_parts, (maxx - minx) * (maxy - miny) / 2 AS area FROM parcels", "parcels"))
def _(s, d):
    ties = fx.parcels(s, d).withColumn("rings", F.expr("array(array(minx, miny, maxx, maxy, maxx, miny, minx, maxy))"))
    return ov.make_valid(ties).groupBy("id").agg(F.count("*").cast("int").alias("n_parts"), F.round(F.sum(R.area("rings")), 9).alias("area"))


_E = "0.0818191908426215"
_QL = f"((1 - {_E} * {_E}) * (sin(radians({{0}})) / (1 - {_E} * {_E} * power(sin(radians({{0}})), 2)) - ln((1 - {_E} * sin(radians({{0}}))) / (1 + {_E} * sin(radians({{0}})))) / (2 * {_E})))"


@query("g9_measure_area", wv(f"SELECT id, round(radians(maxx - minx) * ({_QL.format('maxy')} - {_QL.format('miny')}) * 6378137.0 * 6378137.0 / 2 / 1000000.0, 3) AS km2 FROM parcels", "parcels"))
def _(s, d):
    return boxes(s, d).select("id", F.round(G.ellipsoid_area(F.col("rings"), "km2"), 3).alias("km2"))


@query("g9_measure_perimeter", None)
def _(s, d):
    return lots(s, d).select("id", F.round(R.perimeter("rings", "km"), 3).alias("km"))


def _geodesic_sql(edges: str, steps: int = 8) -> str:
    """edges(id, x1, y1, x2, y2) with `m`, the same iteration as text: each step is a layer of columns."""
    f = "(1 / 298.257223563)"
    sphere = """sqrt(power(c2 * sin({0}), 2) + power(c1 * s2 - s1 * c2 * cos({0}), 2)) AS ss{1}, s1 * s2 + c1 * c2 * cos({0}) AS cs{1}, atan2(ss{1}, cs{1}) AS arc{1},
 coalesce(c1 * c2 * sin({0}) / nullif(ss{1}, 0), 0) AS a{1}, 1 - a{1} * a{1} AS q{1}, coalesce(cs{1} - 2 * s1 * s2 / nullif(q{1}, 0), 0) AS m{1}"""
    sql = f"SELECT *, atan(tan(radians(y1)) * (1 - {f})) AS u1, atan(tan(radians(y2)) * (1 - {f})) AS u2, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, radians(x2 - x1) AS l, l AS lam0 FROM ({edges})"
    for k in range(steps):
        grow = f"{f} / 16 * q{k} * (4 + {f} * (4 - 3 * q{k})) AS g{k}, l + (1 - g{k}) * {f} * a{k} * (arc{k} + g{k} * ss{k} * (m{k} + g{k} * cs{k} * (2 * m{k} * m{k} - 1))) AS lam{k + 1}"
        sql = f"SELECT *, {sphere.format(f'lam{k}', k)}, {grow} FROM ({sql})"
    n = steps
    sql = f"SELECT *, {sphere.format(f'lam{n}', n)}, q{n} * (1 / power(1 - {f}, 2) - 1) AS u FROM ({sql})"
    big, small = "1 + u * (1 / 4.0::DOUBLE + u * (-3 / 64.0::DOUBLE + u * (5 / 256.0::DOUBLE - u * 175 / 16384.0::DOUBLE)))", "u * (1 / 4.0::DOUBLE + u * (-1 / 8.0::DOUBLE + u * (37 / 512.0::DOUBLE - u * 47 / 1024.0::DOUBLE)))"
    d = f"b * ss{n} * (m{n} + b / 4 * (cs{n} * (2 * m{n} * m{n} - 1) - b / 6 * m{n} * (4 * ss{n} * ss{n} - 3) * (4 * m{n} * m{n} - 3)))"
    return f"SELECT *, {small} AS b, 6378137.0::DOUBLE * (1 - {f}) * ({big}) * (arc{n} - {d}) AS m FROM ({sql})"


_BORDER = " UNION ALL ".join(f"SELECT id, {e} FROM parcels" for e in ("minx AS x1, miny AS y1, maxx AS x2, miny AS y2", "maxx, miny, maxx, maxy", "maxx, maxy, minx, maxy", "minx, maxy, minx, miny"))


@query("g9_measure_written", wv(f"SELECT id, round(sum(m) / 1000, 6) AS km, true AS number FROM ({_geodesic_sql(_BORDER)}) GROUP BY 1", "parcels"))
def _(s, d):
    """The perimeter of logical features of one or two parts, as a JSON number in the properties of their first part."""
    out = ms.measure(halves(s, d), "perimeter", "km", "km", 4.0).where("part_index = 0")
    written = F.variant_get(F.parse_json("properties"), F.lit("$.km"), "double")
    return out.select("id", F.round(written, 6).alias("km"), F.col("properties").rlike('"km":[0-9.]+[,}]').alias("number"))


_CUT_CORNER = "SELECT *, (minx + maxx) / 2 AS mx, (miny + maxy) / 2 AS my FROM parcels"
_LOT_BORDER = " UNION ALL ".join(f"SELECT id, {e} FROM ({_CUT_CORNER})" for e in ("minx AS x1, miny AS y1, maxx AS x2, miny AS y2", "maxx, miny, maxx, my", "maxx, my, mx, maxy", "mx, maxy, minx, maxy", "minx, maxy, minx, miny"))
SQL["g9_measure_perimeter"] = wv(f"SELECT id, round(sum(m) / 1000, 3) AS km FROM ({_geodesic_sql(_LOT_BORDER)}) GROUP BY 1", "parcels")

_DIAGONAL = "SELECT CAST(event_id AS VARCHAR) AS id, lon AS x1, lat AS y1, lon + CAST(event_id % 97 AS DOUBLE) / 8 AS x2, lat + CAST(event_id % 31 AS DOUBLE) / 16 - 1 AS y2 FROM points"


@query("g9_line_lengths", wv(f"SELECT id, round(m, 4) AS m FROM ({_geodesic_sql(_DIAGONAL)}) WHERE x1 <> x2 OR y1 <> y2", "points"))
def _(s, d):
    n = F.col("id").cast("long")
    ends = F.array(F.col("lon"), F.col("lat"), F.col("lon") + (n % 97) / F.lit(8.0), F.col("lat") + (n % 31) / F.lit(16.0) - 1)
    lines = fx.points(s, d).select("id", ends.alias("line")).where("line[0] <> line[2] or line[1] <> line[3]")
    return lines.select("id", F.round(R.line_length("line"), 4).alias("m"))


def arches(s, d):
    """Parcels with a notch from above: the left arm is a quarter wide, the right one half; the bar below is a quarter high."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    x = lambda k: F.col("minx") + w * k
    y = lambda k: F.col("miny") + h * k
    corners = ((0, 0), (1, 0), (1, 1), (0.5, 1), (0.5, 0.25), (0.25, 0.25), (0.25, 1), (0, 1))
    return fx.parcels(s, d).withColumn("rings", F.array(F.array(*(f(k) for a, b in corners for f, k in ((x, a), (y, b))))))


@query("g16_interior_point", wv("SELECT id, minx + (maxx - minx) * 0.75 AS x, miny + (maxy - miny) * 0.625 AS y, true AS inside FROM parcels", "parcels"))
def _(s, d):
    p = G.interior_point(F.col("rings"))
    return arches(s, d).withColumn("p", p).select("id", "p.x", "p.y", R.holds("rings", "p.x", "p.y").alias("inside"))


_AREAS = "SELECT 'parcels_F' AS aoi, -180.0::DOUBLE AS ax1, -90.0::DOUBLE AS ay1, 180.0::DOUBLE AS ax2, 90.0::DOUBLE AS ay2 UNION ALL SELECT 'parcels_O', -60.0::DOUBLE, -40.0::DOUBLE, 60.0::DOUBLE, 40.0::DOUBLE UNION ALL SELECT 'parcels_P', 0.001::DOUBLE, 0.001::DOUBLE, 0.002::DOUBLE, 0.002::DOUBLE"


@query(
    "m6_search_boxes",
    wv(
        f"""WITH a AS ({_AREAS}), g AS (SELECT collection_id AS aoi, id, minx, miny, maxx, maxy, (maxx - minx) * (maxy - miny) * 13 / 16 AS area FROM parcels),
t AS (SELECT *, minx + (maxx - minx) * 0.75 AS px, miny + (maxy - miny) * 0.625 AS py, least(greatest(sqrt(area) * 0.32, 0.0025), 0.11) AS h, row_number() OVER (PARTITION BY aoi ORDER BY area DESC, id) AS place FROM g),
b AS (SELECT aoi, place, px - h AS x1, py - h AS y1, px + h AS x2, py + h AS y2 FROM t WHERE place <= 16),
w AS (SELECT aoi, 0 AS place, min(minx) AS lx, min(miny) AS ly, max(maxx) AS hx, max(maxy) AS hy, greatest((hx - lx) * 0.03, (hy - ly) * 0.03, 0.008) AS pad FROM g GROUP BY aoi),
c AS (SELECT aoi, place, greatest(x1, ax1, -180) AS x1, greatest(y1, ay1, -85) AS y1, least(x2, ax2, 180) AS x2, least(y2, ay2, 85) AS y2 FROM b JOIN a USING (aoi)),
k AS (SELECT * FROM c WHERE x1 < x2 - 1e-9 AND y1 < y2 - 1e-9),
u AS (SELECT aoi, place, greatest(lx - pad, ax1, -180) AS x1, greatest(ly - pad, ay1, -85) AS y1, least(hx + pad, ax2, 180) AS x2, least(hy + pad, ay2, 85) AS y2 FROM w JOIN a USING (aoi) WHERE aoi NOT IN (SELECT aoi FROM k))
SELECT aoi, CAST(min(place) AS INTEGER) AS place, round(x1, 9) AS x1, round(y1, 9) AS y1, round(x2, 9) AS x2, round(y2, 9) AS y2 FROM (SELECT * FROM k UNION ALL SELECT * FROM u) GROUP BY ALL""",
        "parcels",
    ),
)
def _(s, d):
    gaps = arches(s, d).select(F.col("collection_id").alias("aoi"), "id", "rings", ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) * 13 / 16).alias("area"))
    areas = s.createDataFrame([("parcels_F", -180.0, -90.0, 180.0, 90.0), ("parcels_O", -60.0, -40.0, 60.0, 40.0), ("parcels_P", 0.001, 0.001, 0.002, 0.002)], "aoi string, minx double, miny double, maxx double, maxy double")
    return mo.search_boxes(gaps, areas).select("aoi", "place", *(F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")))


def crossings(s, d):
    """For each F parcel a line through it, from a degree to its left to a degree to its right and then up, on a level no border is on."""
    y, x1, x2 = F.col("miny") + 0.0625, F.col("minx") - 0.9375, F.col("maxx") + 0.9375
    p = fx.parcels(s, d).where("collection_id = 'parcels_F'")
    return ln.with_line_box(p.select("id", "properties", F.array(x1, y, x2, y, x2, y + 1).alias("line")))


_SEGMENTS = "t AS (SELECT id, minx - 0.9375 AS x1, maxx + 0.9375 AS x2, miny + 0.0625 AS y FROM parcels WHERE status = 'F')"
_STRETCHES = """c AS (SELECT t.id, b.id AS id_b, greatest(least(x2, b.maxx) - greatest(x1, b.minx), 0) * CAST(y > b.miny AND y < b.maxy AS INT) AS across,
 greatest(least(y + 1, b.maxy) - greatest(y, b.miny), 0) * CAST(x2 > b.minx AND x2 < b.maxx AS INT) AS up FROM t JOIN parcels b ON b.status = 'O' AND x1 <= b.maxx AND x2 >= b.minx AND y <= b.maxy AND y + 1 >= b.miny)"""


@query("g2_lines", wv(f"WITH {_SEGMENTS}, {_STRETCHES} SELECT id, id_b, across + up AS length, id AS a, id_b AS b FROM c WHERE across + up > 0", "parcels"))
def _(s, d):
    """Lines in polygons: what is inside, by pair, with the ids in the properties."""
    length = lambda lines: F.round(R.planar_length(lines), 9)
    out = ln.intersect_lines(crossings(s, d), boxes(s, d, "O"), value=length, name="length", keys=("_id_a", "_id_b"))
    return out.select("id", "id_b", "length", F.col("properties._id_a").alias("a"), F.col("properties._id_b").alias("b"))


@query("g2_points", wv("SELECT p.id, b.id AS id_b, b.status AS status FROM points p JOIN parcels b ON b.status <> 'P' AND lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy", "points", "parcels"))
def _(s, d):
    out = ln.intersect_points(fx.points(s, d), boxes(s, d).where("collection_id <> 'parcels_P'"), keys=("status",))
    return out.select("id", "id_b", "properties.status")


@query("g6_buffer_lines", wv("SELECT id, 1 AS n_polygons, round((maxx - minx + 1.875) * 0.5 + 0.0625 * 32 * sin(2 * pi() / 64), 6) AS area, round(maxx + 0.9375 + 0.25, 6) AS maxx FROM parcels WHERE status = 'F' UNION ALL SELECT 'p' || id, 1, round(0.0625 * 32 * sin(2 * pi() / 64), 6), round(lon + 0.25, 6) FROM points", "parcels", "points"))
def _(s, d):
    """Straight lines and points with a margin of a quarter degree."""
    straight = crossings(s, d).select("id", F.slice("line", 1, 4).alias("line"))
    dots = fx.points(s, d).select(F.concat(F.lit("p"), "id").alias("id"), F.array("lon", "lat").alias("line"))
    grown = ov.with_box(ln.buffer_lines(straight.unionByName(dots), 0.25))
    return grown.groupBy("id").agg(F.count("*").alias("n_polygons"), F.round(F.sum(R.area("rings")), 6).alias("area"), F.round(F.max("maxx"), 6).alias("maxx"))


_PARTS_SQL = """SELECT o_orderkey || '_' || (k - 1) AS id, CAST(o_orderkey AS VARCHAR) AS _parent_id, k - 1 AS _part_index, kinds[k] AS kind FROM (
 SELECT o_orderkey, kinds, unnest(range(1, len(kinds) + 1)) AS k FROM (SELECT o_orderkey, ['Point'] || CASE WHEN o_orderkey % 2 = 0 THEN ['LineString'] ELSE [] END || CASE WHEN o_orderkey % 3 = 0 THEN ['Polygon', 'Polygon'] ELSE [] END AS kinds FROM orders))"""


@query("g7_explode_parts", _PARTS_SQL)
def _(s, d):
    return ln.explode_parts(collections(s, d)).select("id", "_parent_id", "_part_index", "kind")


@query("g10_subdivide", wv("SELECT id, round(power(maxx - minx, 2) * 32 * sin(2 * pi() / 64), 6) AS area, true AS small FROM parcels", "parcels"))
def _(s, d):
    angle = lambda i: i * F.pi() / 32
    r = F.col("maxx") - F.col("minx")
    ring = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array(F.col("minx") + r * F.cos(angle(i)), F.col("miny") + r * F.sin(angle(i)))))
    cut = ov.subdivide(fx.parcels(s, d).withColumn("rings", F.array(ring)), 24)
    rings = F.col("rings")
    return cut.groupBy("id").agg(F.round(F.sum(R.area(rings)), 6).alias("area"), (F.max(G.n_points(rings)) <= 24).alias("small"))


def collections(s, d):
    """Geometry collections of points, on every second order a line and on every third two polygons."""
    part = lambda kind: f"named_struct('kind', '{kind}', 'coordinates', cast(o_orderkey as string))"
    more = f"concat(array({part('Point')}), if(o_orderkey % 2 = 0, array({part('LineString')}), array()), if(o_orderkey % 3 = 0, array({part('Polygon')}, {part('Polygon')}), array()))"
    return fx.table(s, d, "orders").selectExpr("cast(o_orderkey as string) as id", f"{more} as parts")


_OF = "SELECT CAST(o_orderkey AS VARCHAR) AS id, "


@query("g11_split_by_type", f"{_OF}'points' AS output, 1 AS n FROM orders UNION ALL {_OF}'lines', 1 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL {_OF}'polygons', 2 FROM orders WHERE o_orderkey % 3 = 0")
def _(s, d):
    return ov.split_by_type(collections(s, d)).select("id", "output", F.size("parts").alias("n"))


@query("g12_homogenize", f"{_OF}'Point' AS kind, 'points' AS output FROM orders UNION ALL {_OF}'LineString', 'lines' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL {_OF}'MultiPolygon', 'polygons' FROM orders WHERE o_orderkey % 3 = 0")
def _(s, d):
    return ov.split_by_type(collections(s, d)).select("id", G.homogenize(F.col("parts")).alias("kind"), "output")


@query("g13_size_guard", wv("SELECT id, 13 + 16 * 6 AS wkb FROM parcels WHERE o_orderkey % 2 = 1 UNION ALL SELECT id, 13 + 16 * 5 FROM parcels WHERE o_orderkey % 2 = 0", "parcels"))
def _(s, d):
    odd = F.col("id").cast("long") % 2 == 1
    mixed = lots(s, d).withColumn("rings", F.when(odd, F.col("rings")).otherwise(G.box_rings(*sp.BOX)))
    kept, _ = ov.size_guard(mixed, 13 + 16 * 6)
    return kept.select("id", G.wkb_bytes(F.col("rings")).alias("wkb"))


@query(
    "j3_points_in_polygons",
    wv(
        """SELECT p.id, b.id AS id_b FROM points p JOIN parcels b ON lon BETWEEN b.minx AND b.maxx AND lat BETWEEN b.miny AND b.maxy
 AND (lon - (minx + maxx) / 2) * (maxy - miny) / 2 + (lat - (miny + maxy) / 2) * (maxx - minx) / 2 <= (maxx - minx) * (maxy - miny) / 4""",
        "points",
        "parcels",
    ),
)
def _(s, d):
    return sp.points_in_polygons(fx.points(s, d).select("id", "lon", "lat"), lots(s, d)).select("id", "id_b")


_BELOW = "(p.lon - z.minx) * (z.maxy - z.miny) + (p.lat - z.miny) * (z.maxx - z.minx) <= (z.maxx - z.minx) * (z.maxy - z.miny)"
_IN_TRIANGLE = f"FROM pixels p JOIN zones z ON p.lon BETWEEN z.minx AND z.maxx AND p.lat BETWEEN z.miny AND z.maxy AND {_BELOW}"


def triangles(s, d):
    """The lower left halves of the zones."""
    corners = F.array("minx", "miny", "maxx", "miny", "minx", "maxy", "minx", "miny")
    return fx.zones(s, d).withColumn("rings", F.array(corners))


@query(
    "a6_zonal_polygons",
    wv(
        f"""SELECT z.id AS zone, band, count(*) FILTER (NOT masked) AS valid_pixels, count(*) FILTER (masked) AS masked_pixels,
 round(count(*) FILTER (NOT masked) * 100.0 / count(*), 6) AS valid_percent, min(value) FILTER (NOT masked) AS min, max(value) FILTER (NOT masked) AS max,
 round(avg(value) FILTER (NOT masked), 6) AS mean, sum(value) FILTER (NOT masked) AS sum, round(stddev_pop(value) FILTER (NOT masked), 6) AS std,
 quantile_cont(value, 0.5) FILTER (NOT masked) AS median, round(quantile_cont(value, 0.02) FILTER (NOT masked), 6) AS percentile_2,
 round(quantile_cont(value, 0.98) FILTER (NOT masked), 6) AS percentile_98 {_IN_TRIANGLE} GROUP BY 1, 2""",
        "pixels",
        "zones",
    ),
)
def _(s, d):
    return sp.zonal_statistics(triangles(s, d), fx.pixels(s, d))


@query("a6_zonal_unique_values", wv(f"SELECT z.id AS zone, band, value, count(*) AS n {_IN_TRIANGLE} WHERE NOT masked GROUP BY 1, 2, 3", "pixels", "zones"))
def _(s, d):
    return sp.zonal_values(triangles(s, d), fx.pixels(s, d))


_FRAMES = "SELECT id, 2 AS n_rings, round((maxx - minx) * (maxy - miny) * 3 / 4, 6) AS area, round(minx + (maxx - minx) / 4, 6) AS hole_x FROM parcels"


def frames(s, d):
    """Parcels with a hole of half their width and height in the middle."""
    w, h = (F.col("maxx") - F.col("minx")) / 4, (F.col("maxy") - F.col("miny")) / 4
    x1, y1, x2, y2 = F.col("minx") + w, F.col("miny") + h, F.col("maxx") - w, F.col("maxy") - h
    hole = F.array(x1, y1, x1, y2, x2, y2, x2, y1, x1, y1)
    return fx.parcels(s, d).withColumn("rings", F.concat(G.box_rings(*sp.BOX), F.array(hole)))


def framed(read):
    rings = F.col("rings")
    return read.select("id", F.size(rings).alias("n_rings"), F.round(R.area(rings), 6).alias("area"), F.round(F.get(F.get(rings, 1), 0), 6).alias("hole_x"))


@query("s1_s4_polygons", wv(_FRAMES, "parcels"))
def _(s, d):
    """Polygons with holes are written as GeoJSON lines and read back as rings."""
    path = shared_path(s, "polygons")
    tb.write_geojsonl(frames(s, d).select("id", F.lit(0).alias("part_index"), "rings", F.lit("{}").alias("properties")), path)
    return framed(tb.read_geojsonl(s, path, "parcels")[0])


@query("s3_kml_polygons", wv(_FRAMES, "parcels"))
def _(s, d):
    """The same polygons as placemarks, those of odd ids within a MultiGeometry."""
    path, ring = shared_path(s, "placemarks"), F.col("rings")
    text = lambda r: F.struct(F.array_join(F.transform(F.sequence(F.lit(1), F.size(r), F.lit(2)), lambda i: F.concat_ws(",", *(F.element_at(r, i + k).cast("string") for k in (0, 1)))), " ").alias("coordinates"))
    border = lambda k: F.struct(text(F.get(ring, k)).alias("LinearRing"))
    area, odd = F.struct(border(0).alias("outerBoundaryIs"), F.array(border(1)).alias("innerBoundaryIs")), F.col("id").cast("long") % 2 == 1
    marks = frames(s, d).select(F.col("id").alias("_id"), F.when(~odd, area).alias("Polygon"), F.when(odd, F.struct(F.array(area).alias("Polygon"))).alias("MultiGeometry"))
    marks.write.format("xml").option("rootTag", "kml").option("rowTag", "Placemark").save(path)
    return framed(rd.read_kml(s, path, "parcels"))
