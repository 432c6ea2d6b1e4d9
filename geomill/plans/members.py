"""Queries on single features, composite members, tiles of features and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import composite as cp
from ..operators import filters as fl
from ..operators import paging as pg
from ..operators import tables as tb
from ..operators import tiles as tl
from ..sources import fixtures as fx
from ..sources.fixtures import with_views as wv
from ..sources.readers import shared_path
from . import places

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("s1_s4_geojsonl", wv("SELECT id, lon AS minx, lat AS maxy, event_type AS type FROM points", "points"))
def _(s, d):
    """Points are written as GeoJSON lines to the shared folder and read back."""
    path = shared_path(s, "geojsonl")
    out = fx.points(s, d).withColumn("kind", F.lit("Point")).withColumn("coordinates", F.concat(F.lit("["), "lon", F.lit(","), "lat", F.lit("]")))
    tb.write_geojsonl(out, path)
    good, _ = tb.read_geojsonl(s, path, "points")
    return good.select("id", "minx", "maxy", fl.prop("event_type").alias("type"))


@query("f11_ids_filter", wv("SELECT id FROM parcels WHERE id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)", "parcels"))
def _(s, d):
    ids = fx.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    return fx.parcels(s, d).join(ids, "id", "left_semi").select("id")


_ID = "(SELECT min(id) FROM parts WHERE o_orderkey % 5 = 0)"


@query("a14_get_feature", wv(f"SELECT id, min(minx) AS minx, max(maxx) AS maxx, count(*) AS n_parts FROM parts WHERE id = {_ID} GROUP BY 1", "parts"))
def _(s, d):
    p = fx.parts(s, d)
    wanted = p.where("cast(id as bigint) % 5 = 0").agg(F.min("id").alias("id"))
    return pg.logical(p.join(wanted, "id", "left_semi")).select("id", "minx", "maxx", "n_parts")


@query("u2_composite_get", wv("SELECT id, min(CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS member FROM parcels GROUP BY 1", "parcels"))
def _(s, d):
    """Each id with the first member, in the order F, O, P, that has it."""
    order = F.array_position(F.array(*(F.lit(f"parcels_{m}") for m in "FOP")), F.col("collection_id")) - 1
    return pg.newest(fx.parcels(s, d).withColumn("member", order.cast("int")), ["id"], F.col("member")).select("id", "member")


@query("x8_composite_id", wv("SELECT collection_id AS member, id || ':' || rank AS feature FROM parcels", "parcels"))
def _(s, d):
    whole = fx.parcels(s, d).select(S.composite_id(F.col("collection_id"), F.concat("id", F.lit(":"), fl.prop("rank"))).alias("c"))
    pieces = F.split("c", ":", 2)
    return whole.select(pieces[0].alias("member"), pieces[1].alias("feature"))


@query("t4_tile_features", wv("SELECT id FROM parcels WHERE minx <= 45 AND maxx >= 0 AND miny <= 40.979898069620134 AND maxy >= 0 AND miny <= 30 ORDER BY id LIMIT 50000", "parcels"))
def _(s, d):
    return tl.tile_features(fx.parcels(s, d), 3, 4, 3, box=(-180, -90, 180, 30)).select("id")


@query("t4_tile_page", wv("SELECT id FROM (SELECT * FROM parcels ORDER BY id LIMIT 1000 OFFSET 100) WHERE minx <= 45 AND maxx >= 0 AND miny <= 40.979898069620134 AND maxy >= 0", "parcels"))
def _(s, d):
    return tl.tile_features(fx.parcels(s, d), 3, 4, 3, paged=(1000, 100)).select("id")


_LAT = "(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 64"
_LON = "(lon + 180) / 360 * 64"
_AT = "least(greatest(CAST(floor({0}) AS INT), 0), 63)"


@query("t5_tile_geometry", wv(f"SELECT id, x, y, CAST(floor((fx - x) * 4096 + 0.5) AS INT) AS qx, CAST(floor((fy - y) * 4096 + 0.5) AS INT) AS qy FROM (SELECT id, {_LON} AS fx, {_LAT} AS fy, {_AT.format(_LON)} AS x, {_AT.format(_LAT)} AS y FROM points)", "points"))
def _(s, d):
    return tl.quantized(fx.points(s, d), 6).select("id", "x", "y", "qx", "qy")


def _merged_sql() -> str:
    head = places._assign_sql().replace("range(0, 7)", "range(4, 5)").replace("SELECT id, z, unnest", "SELECT id, status, z, unnest")
    return head[: head.index("SELECT z, count(*)")] + "SELECT z, x, y, count(*) AS n, count(DISTINCT status) AS members FROM (SELECT status, z, x, unnest(range(y1, y2 + 1)) AS y FROM r) GROUP BY 1, 2, 3"


@query("t6_merge_members", _merged_sql())
def _(s, d):
    p = fx.parcels(s, d)
    return tl.merge_members([p.where(F.col("collection_id") == f"parcels_{m}") for m in "OFP"], 4, 4)


def _layers_sql() -> str:
    sql = _merged_sql()
    return sql[: sql.index("SELECT z, x, y, count(*)")] + "SELECT z, x, y, id, CASE status WHEN 'P' THEN 0 ELSE 1 END AS member_ord FROM (SELECT id, status, z, x, unnest(range(y1, y2 + 1)) AS y FROM r) WHERE status IN ('P', 'O')"


@query("t6_member_tiles", _layers_sql())
def _(s, d):
    """The features themselves, of two members in their order, for each tile of a zoom."""
    return tl.member_tiles(fx.parcels(s, d), ["parcels_P", "parcels_O"], 4, 4).select("z", "x", "y", "id", "member_ord")


@query("t7_tile_export", wv("SELECT id, row_number() OVER (ORDER BY id, collection_id) AS number FROM (SELECT DISTINCT id, collection_id FROM parts)", "parts"))
def _(s, d):
    return tl.export_rows(pg.logical(fx.parts(s, d))).select("id", "number")


@query("t7_tile_export_skips", wv("SELECT count(*) FILTER (o_orderkey % 7 <> 0) AS exported, count(*) FILTER (o_orderkey % 7 = 0) AS skipped, count(*) FILTER (o_orderkey % 7 <> 0) AS last, 1 AS first FROM parcels", "parcels"))
def _(s, d):
    """Time-ordered ids, which all begin alike; every seventh feature has no geometry."""
    df = fx.parcels(s, d).withColumn("minx", F.when(F.col("id").cast("long") % 7 != 0, F.col("minx"))).withColumn("id", F.concat(F.lit("018f-"), F.lpad("id", 12, "0")))
    numbers = tl.export_rows(df).agg(F.max("number").alias("last"), F.min("number").cast("int").alias("first"))
    return tl.export_counts(df).join(numbers, F.lit(True))


_COMPOSITE = ["parcels_F", "parcels_P"]
_MEMBERS = "SELECT *, CASE status WHEN 'F' THEN 0 ELSE 1 END AS member_ord FROM parcels WHERE status IN ('F', 'P')"


@query(
    "u1_composite_page",
    wv(
        f"""SELECT collection_id || ':' || id AS id, member_ord, minx, maxx, collection_id AS member, id AS feature, priority, CAST(NULL AS VARCHAR) AS status
 FROM ({_MEMBERS}) ORDER BY priority DESC, member_ord, id LIMIT 400 OFFSET 100""",
        "parcels",
    ),
)
def _(s, d):
    """Sorted over all members by a property; parts are grouped, and properties say where a feature comes from."""
    page = cp.composite_items(fx.parts(s, d), _COMPOSITE, "priority", True, 400, 100, ["priority"])
    return page.select("id", "member_ord", "minx", "maxx", fl.prop("_member_collection_id").alias("member"), fl.prop("_member_feature_id").alias("feature"), fl.prop("priority").alias("priority"), fl.prop("status").alias("status"))


@query("u1_composite_matched", wv(f"SELECT count(*) AS number_matched FROM ({_MEMBERS})", "parcels"))
def _(s, d):
    return cp.number_matched(fx.parts(s, d), _COMPOSITE)


@query(
    "u2_composite_lookup",
    wv(
        """SELECT item, collection_id, id FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN id WHEN 1 THEN 'parcels_F:' || id WHEN 2 THEN 'parcels_O:' || id ELSE collection_id || ':' || id END AS item,
 collection_id, id, o_orderkey % 4 AS k, status FROM parcels) WHERE status IN ('F', 'P') AND (k IN (0, 3) OR k = 1 AND status = 'F')""",
        "parcels",
    ),
)
def _(s, d):
    n = F.col("id").cast("long") % 4
    item = F.when(n == 0, F.col("id")).when(n == 1, F.concat(F.lit("parcels_F:"), "id")).when(n == 2, F.concat(F.lit("parcels_O:"), "id")).otherwise(F.concat("collection_id", F.lit(":"), "id"))
    return cp.composite_get(fx.parts(s, d), _COMPOSITE, fx.parcels(s, d).select(item.alias("item")))


@query("a11_dynamic_revision", wv("SELECT left(sha256('parcels_P:' || (SELECT strftime(max(updated_at), '%Y-%m-%dT%H:%M:%S') FROM parcels WHERE status = 'P') || '+00:00' || chr(10) || 'absent:' || chr(10) || 'parcels_F:' || (SELECT strftime(max(updated_at), '%Y-%m-%dT%H:%M:%S') FROM parcels WHERE status = 'F') || '+00:00'), 16) AS revision", "parcels"))
def _(s, d):
    last = fx.parcels(s, d).groupBy("collection_id").agg(F.max("updated_at").alias("last_updated"))
    return cp.dynamic_revision(last, ["parcels_P", "absent", "parcels_F"])
