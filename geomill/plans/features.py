"""Queries over feature tables: filters, paging, aggregates, set operations, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cg
from ..operators import digests as dg
from ..operators import filters as fl
from ..operators import paging as pg
from ..operators import tables as tb
from ..operators.search import doc_search
from ..sources import fixtures as fx
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


IDS = ("id", "collection_id")


@query("f2_structured_filter", wv("SELECT id, collection_id FROM parcels WHERE status <> 'P' AND priority LIKE '1-%' AND rank >= 25", "parcels"))
def _(s, d):
    return fl.structured_filter(fx.parcels(s, d), "status:ne:P\npriority:like:1-%\nrank:gte:25\nbad:nop:1").select(*IDS)


@query("f3_numeric_rule", wv("SELECT id, rank < 7 AS low, status > 'O' AS later FROM parcels", "parcels"))
def _(s, d):
    return fx.parcels(s, d).select("id", fl.condition("rank", "lt", "7").alias("low"), fl.condition("status", "gt", "O").alias("later"))


@query("f4_property_filter", wv("SELECT id FROM parcels WHERE priority LIKE '%-NOT%' AND status = 'O'", "parcels"))
def _(s, d):
    return fl.property_filter(fx.parcels(s, d), priority="*-NOT*", status="O").select("id")


@query("f5_fulltext", wv("SELECT id FROM parcels WHERE lower(priority) LIKE '%urgent%'", "parcels"))
def _(s, d):
    return fl.fulltext(fx.parcels(s, d), "Urgent").select("id")


@query(
    "f6_exact_search",
    wv(
        """WITH hit AS (SELECT priority AS token, 2 AS tier, id, collection_id FROM parcels WHERE priority IN ('1-URGENT', 'absent-token'))
SELECT * FROM hit UNION ALL SELECT 'SPECIFIED' AS token, 3 AS tier, id, collection_id FROM parcels WHERE contains(lower(priority), 'specified')""",
        "parcels",
    ),
)
def _(s, d):
    tokens = s.createDataFrame([("1-URGENT",), ("SPECIFIED",), ("absent-token",), ("x y",)], "token string")
    return fl.exact_search(fx.parcels(s, d), tokens, ["priority"])


_LONG_WORDS = "[A-Za-z0-9]{9,20}"


@query(
    "f6_exact_index",
    f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_LONG_WORDS}')) AS token FROM benchmark)
SELECT token, 3 AS tier, CAST(doc_id AS VARCHAR) AS id, lang AS collection_id FROM t JOIN documents ON contains(lower(text), lower(token))""",
)
def _(s, d):
    """All long words of the benchmark in the texts of documents, by a written index."""
    docs = fx.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("collection_id"), F.to_json(F.struct("text")).alias("properties"))
    tokens = fx.table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_LONG_WORDS), F.lit(0))).alias("token"))
    return fl.exact_search(docs, tokens, ["code"], index=fl.build_text_index(docs, shared_path(s, "text-index")))


@query("f7_structured_eq_ids", wv("SELECT DISTINCT id FROM parts WHERE status = 'F' AND rank = 3", "parts"))
def _(s, d):
    return fl.structured_filter(fx.parts(s, d), [("status", "eq", "F"), ("rank", "eq", "3")]).select("id").distinct()


@query("f8_datetime_filter", wv("SELECT id FROM parcels WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 12:00:00'", "parcels"))
def _(s, d):
    return fl.datetime_filter(fx.parcels(s, d), "1996-01-01T00:00:00Z/1996-12-31T12:00:00Z").select("id")


@query("f8_unreadable_end", wv("SELECT count(*) AS n FROM parcels", "parcels"))
def _(s, d):
    return fl.datetime_filter(fx.parcels(s, d), "1996-01-01T00:00:00Z/some day").agg(F.count("*").alias("n"))


@query("f9_bbox_filter", wv("SELECT id FROM parcels WHERE minx <= 20 AND maxx >= -20 AND miny <= 30 AND maxy >= -10", "parcels"))
def _(s, d):
    return fl.bbox_filter(fx.parcels(s, d), (-20, -10, 20, 30)).select("id")


@query("f10_select_properties", wv("SELECT id, '{\"status\":\"' || status || '\"}' AS properties FROM parcels", "parcels"))
def _(s, d):
    return fl.select_properties(fx.parcels(s, d), ["status"]).select("id", "properties")


@query("f12_shadow_visible", wv("SELECT id FROM parcels WHERE job IS NULL OR job NOT IN ('job1')", "parcels"))
def _(s, d):
    return fl.shadow_visible(fx.parcels(s, d), ["job1"]).select("id")


@query("f13_queryables", "SELECT unnest(['priority', 'rank', 'status']) AS name FROM (SELECT 1 FROM orders LIMIT 1)")
def _(s, d):
    return fl.queryables(fx.parcels(s, d))


COLLECTIONS = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, CASE c_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'logged' ELSE 'private' END AS visibility,
 CAST(c_nationkey AS VARCHAR) AS owner FROM customer"""


def collections(s, d):
    v = "case c_custkey % 3 when 0 then 'public' when 1 then 'logged' else 'private' end"
    return fx.table(s, d, "customer").selectExpr("cast(c_custkey as string) as id", "c_name as title", f"{v} as visibility", "cast(c_nationkey as string) as owner")


def shares(s, d):
    return fx.table(s, d, "supplier").selectExpr("cast(s_suppkey as string) as resource_id", "cast(s_nationkey as string) as username")


@query("f14_collections_list", f"SELECT id, title FROM ({COLLECTIONS}) WHERE visibility = 'public' AND (contains(lower(id), '00') OR contains(lower(title), '00')) ORDER BY title, id LIMIT 50")
def _(s, d):
    hit = F.contains(F.lower("id"), F.lit("00")) | F.contains(F.lower("title"), F.lit("00"))
    return collections(s, d).where("visibility = 'public'").where(hit).orderBy("title", "id").limit(50).select("id", "title")


EXTENTS = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, c_mktsegment AS description, CASE c_nationkey % 2 WHEN 0 THEN 'vector' ELSE 'raster' END AS collection_type,
 CASE c_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'logged' ELSE 'private' END AS visibility, CAST(c_custkey % 360 - 180 AS DOUBLE) AS minx, CAST(c_custkey % 360 - 175 AS DOUBLE) AS maxx,
 CAST(c_custkey % 170 - 85 AS DOUBLE) AS miny, CAST(c_custkey % 170 - 80 AS DOUBLE) AS maxy FROM customer"""
CHOSEN = """visibility = 'public' AND collection_type = 'vector' AND (contains(lower(id), 'i') OR contains(lower(title), 'i') OR contains(lower(description), 'i'))
 AND minx <= 60 AND maxx >= -120 AND miny <= 60 AND maxy >= -60 AND id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)"""


def chosen(s, d):
    tiled = fx.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return s.sql(EXTENTS.replace("VARCHAR", "STRING").replace("FROM customer", "FROM {customer}"), customer=fx.table(s, d, "customer")).where("visibility = 'public'"), dict(q=" I ", box=(-120.0, -60.0, 60.0, 60.0), kind="vector", tiled=tiled)


@query("f14_collections_page", f"SELECT id, title, description FROM ({EXTENTS}) WHERE {CHOSEN} ORDER BY description DESC NULLS FIRST, id LIMIT 20 OFFSET 3")
def _(s, d):
    found, filters = chosen(s, d)
    return cg.collections_list(found, "description", descending=True, limit=20, offset=3, **filters).select("id", "title", "description")


@query("f14_collections_count", f"SELECT collection_type, count(*) AS n FROM ({EXTENTS}) WHERE {CHOSEN} GROUP BY 1")
def _(s, d):
    found, filters = chosen(s, d)
    return cg.collections_matching(found, **filters).groupBy("collection_type").agg(F.count("*").alias("n"))


@query("f15_visible_to", f"SELECT id FROM ({COLLECTIONS}) c WHERE visibility IN ('public', 'logged') OR owner = '7' OR EXISTS (SELECT 1 FROM supplier WHERE CAST(s_suppkey AS VARCHAR) = c.id AND s_nationkey = 7)")
def _(s, d):
    return fl.visible_to(collections(s, d), shares(s, d), "7").select("id")


@query("p1_page", wv("SELECT collection_id, id, min(priority) AS sort_key FROM parts GROUP BY 1, 2 ORDER BY sort_key DESC NULLS FIRST, id, collection_id LIMIT 100 OFFSET 50", "parts"))
def _(s, d):
    return pg.page(fx.parts(s, d), "priority", descending=True, limit=100, offset=50)


@query(
    "p1_page_features",
    wv(
        """WITH k AS (SELECT collection_id, id, min(priority) AS sort_key FROM parts GROUP BY 1, 2),
 p AS (SELECT collection_id, id, row_number() OVER (ORDER BY sort_key DESC NULLS FIRST, id, collection_id) - 50 AS place FROM k)
SELECT place, collection_id, id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS n_parts
FROM parts JOIN p USING (collection_id, id) WHERE place BETWEEN 1 AND 100 GROUP BY 1, 2, 3""",
        "parts",
    ),
)
def _(s, d):
    found = pg.page_features(fx.parts(s, d), "priority", descending=True, limit=100, offset=50)
    return found.select("place", "collection_id", "id", "minx", "miny", "maxx", "maxy", "n_parts")


@query("p2_number_matched", wv("SELECT collection_id, count(DISTINCT id) AS number_matched FROM parts WHERE rank >= 10 GROUP BY 1", "parts"))
def _(s, d):
    return fl.structured_filter(fx.parts(s, d), "rank:gte:10").groupBy("collection_id").agg(F.countDistinct("id").alias("number_matched"))


@query("p4_keyset_page", wv("SELECT id, part_index FROM parts WHERE (id, part_index) > ('25', 0) ORDER BY id, part_index LIMIT 500", "parts"))
def _(s, d):
    return pg.keyset_page(fx.parts(s, d), "25", 0, 500).select("id", "part_index")


@query("p5_bbox_only", wv("SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS number_matched FROM parcels WHERE status = 'P'", "parcels"))
def _(s, d):
    box = (F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    return fl.property_filter(fx.parcels(s, d), status="P").agg(*box, F.countDistinct("id").alias("number_matched"))


@query("p6_distinct_on", wv("SELECT id, part_index FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (job IS NULL) DESC, part_index) AS n FROM parts) WHERE n = 1", "parts"))
def _(s, d):
    return pg.newest(fx.parts(s, d), ["id"], F.col("bulk_import_job_id").isNull().desc(), F.col("part_index")).select("id", "part_index")


def staged(s, d):
    p = fx.parcels(s, d)
    again = p.where(F.col("id").cast("long") % 7 == 0).withColumn("updated_at", F.expr("updated_at + interval 1 day"))
    return p.unionByName(again)


@query("p7_dedupe_staging", wv("SELECT id, collection_id, CASE WHEN o_orderkey % 7 = 0 THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS updated_at FROM parcels", "parcels"))
def _(s, d):
    return tb.dedupe_staging(staged(s, d)).select("id", "collection_id", "updated_at")


@query("a1_logical_features", wv("SELECT id, collection_id, count(*) AS n_parts, sum((maxx - minx) * (maxy - miny)) AS area, min(minx) AS minx, max(maxx) AS maxx FROM parts GROUP BY 1, 2", "parts"))
def _(s, d):
    return pg.logical(fx.parts(s, d)).select("id", "collection_id", "n_parts", "area", "minx", "maxx")


@query("a2_logical_bboxes", wv("SELECT id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM parts GROUP BY collection_id, id", "parts"))
def _(s, d):
    return pg.logical(fx.parts(s, d)).select("id", "minx", "miny", "maxx", "maxy")


@query("a3_collection_extent", wv("SELECT collection_id, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM points GROUP BY 1", "points"))
def _(s, d):
    return fx.points(s, d).groupBy("collection_id").agg(F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"))


@query("a4_a5_counts_updates", wv("SELECT collection_id, count(DISTINCT id) AS feature_count, max(updated_at) AS last_updated FROM parts GROUP BY 1", "parts"))
def _(s, d):
    return fx.parts(s, d).groupBy("collection_id").agg(F.countDistinct("id").alias("feature_count"), F.max("updated_at").alias("last_updated"))


@query("a10_mosaic_version", wv("SELECT collection_id, sha256(collection_id || ':' || string_agg(id, ',' ORDER BY id)) AS version FROM parcels GROUP BY 1", "parcels"))
def _(s, d):
    return dg.mosaic_versions(fx.parts(s, d))


@query("a10_version_matches", wv("SELECT collection_id, k, k < 2 AS matches FROM (SELECT DISTINCT collection_id FROM parcels), (SELECT unnest(range(4)) AS k)", "parcels"))
def _(s, d):
    """The whole version and 16 characters of it match; 15 characters and none do not."""
    given = F.array(F.col("version"), F.left("version", F.lit(16)), F.left("version", F.lit(15)), F.lit(None))
    out = dg.mosaic_versions(fx.parcels(s, d)).select("collection_id", "version", F.posexplode(given).alias("k", "given"))
    return out.select("collection_id", F.col("k").cast("long").alias("k"), dg.version_matches(F.col("given"), F.col("version")).alias("matches"))


@query("a11_composite_revision", "SELECT n_regionkey, substr(sha256(string_agg(n_name, '|' ORDER BY n_nationkey)), 1, 16) AS revision FROM nation GROUP BY 1")
def _(s, d):
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "|")
    return fx.table(s, d, "nation").groupBy("n_regionkey").agg(F.left(F.sha2(names, 256), F.lit(16)).alias("revision"))


@query("u1_composite_items", wv("SELECT * FROM (SELECT 0 AS member_ord, collection_id || ':' || id AS id, priority FROM parcels WHERE status = 'O' UNION ALL SELECT 1, collection_id || ':' || id, priority FROM parcels WHERE status = 'F') ORDER BY member_ord, id LIMIT 300", "parcels"))
def _(s, d):
    p = fx.parcels(s, d).select("collection_id", F.concat("collection_id", F.lit(":"), "id").alias("id"), fl.prop("priority").alias("priority"))
    members = [p.where(F.col("collection_id") == f"parcels_{m}").withColumn("member_ord", F.lit(k)).drop("collection_id") for k, m in enumerate("OF")]
    return members[0].unionByName(members[1]).orderBy("member_ord", "id").limit(300)


@query("u4_collections_grouped", "SELECT o_orderpriority AS catalog, string_agg(DISTINCT 'c' || (o_orderkey % 4), ',' ORDER BY 'c' || (o_orderkey % 4)) AS collections FROM orders GROUP BY 1")
def _(s, d):
    return fx.scenes(s, d).groupBy("catalog").agg(F.array_join(F.array_sort(F.collect_set("collection")), ",").alias("collections"))


@query("b2_bulk_replace", wv("SELECT id, collection_id, updated_at FROM parcels WHERE status <> 'P' UNION ALL SELECT id, collection_id, updated_at + INTERVAL 1 DAY FROM parcels WHERE status = 'P'", "parcels"))
def _(s, d):
    p = fx.parcels(s, d)
    stage = p.where("collection_id = 'parcels_P'").withColumn("updated_at", F.expr("updated_at + interval 1 day"))
    return tb.bulk_replace(p, stage.unionByName(stage)).select("id", "collection_id", "updated_at")


@query("b3_replace_filtered", wv("SELECT id, job FROM parcels WHERE NOT (status = 'O' AND rank < 25) UNION ALL SELECT id, 'new' FROM parcels WHERE status = 'P'", "parcels"))
def _(s, d):
    p = fx.parcels(s, d)
    stage = p.where("collection_id = 'parcels_P'").withColumn("bulk_import_job_id", F.lit("new"))
    return tb.replace_filtered(p, stage, [("status", "eq", "O"), ("rank", "lt", "25")]).select("id", F.col("bulk_import_job_id").alias("job"))


@query("b4_shadow_finalize", wv("SELECT id, CASE WHEN status <> 'O' THEN job END AS job FROM parcels WHERE status <> 'O' OR job = 'job1'", "parcels"))
def _(s, d):
    return tb.shadow_finalize(fx.parcels(s, d), "parcels_O", "job1").select("id", F.col("bulk_import_job_id").alias("job"))


@query("b5_rollback_job", wv("SELECT id FROM parcels WHERE job IS DISTINCT FROM 'job2'", "parcels"))
def _(s, d):
    return tb.rollback_job(fx.parcels(s, d), "job2").select("id")


@query("b6_delete_by_filters", wv("SELECT id FROM parcels WHERE NOT (rank >= 40)", "parcels"))
def _(s, d):
    return tb.delete_by_filters(fx.parcels(s, d), [("rank", "gte", "40")]).select("id")


@query(
    "b8_upsert",
    wv(
        """SELECT id, CASE WHEN o_orderkey % 4 <> 3 THEN status END AS status, CASE o_orderkey % 4 WHEN 1 THEN 'new' WHEN 3 THEN 'set' ELSE priority END AS priority,
 CASE WHEN o_orderkey % 4 = 3 THEN 1.5 ELSE minx END AS minx FROM parcels WHERE o_orderkey % 4 <> 2
 UNION ALL SELECT 's' || s_suppkey, 'N', 'made', 0.5 FROM supplier""",
        "parcels",
    ),
)
def _(s, d):
    """Patches, deletes, replacements with a geometry, and creations; earlier changes of the same features don't count."""
    p = fx.parcels(s, d)
    kind = F.expr("case cast(id as bigint) % 4 when 1 then 'patch' when 2 then 'delete' when 3 then 'replace' end").alias("op")
    text = F.when(F.col("op") == "replace", '{"priority":"set"}').otherwise('{"priority":"new","id":"x"}').alias("patch")
    place = F.when(F.col("op") == "replace", F.lit(1.5)).alias("minx")
    last = p.select("collection_id", "id", kind).where("op is not null").select("collection_id", "id", "op", text, place, F.lit(2).alias("seq"))
    before = last.where("op = 'patch'").select("collection_id", "id", F.lit("delete").alias("op"), "patch", F.lit(9.0).alias("minx"), F.lit(1).alias("seq"))
    made = fx.table(s, d, "supplier").select(
        F.lit("made").alias("collection_id"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("create").alias("op"),
        F.lit('{"status":"N","priority":"made"}').alias("patch"), F.lit(0.5).alias("minx"), F.lit(2).alias("seq"),
    )
    return tb.upsert(p, last.union(before).union(made)).select("id", fl.prop("status").alias("status"), fl.prop("priority").alias("priority"), "minx")


FILES = "SELECT p_partkey, p_name AS path, p_size * 1024 AS length, p_brand AS kind, TIMESTAMP '2024-01-01' + (p_partkey % 500) * INTERVAL 1 HOUR AS modified, CASE WHEN p_partkey % 9 = 0 THEN 'gone' ELSE p_type END AS owner FROM part"


def files(s, d):
    return fx.table(s, d, "part").selectExpr(
        "p_partkey", "p_name as path", "cast(p_size * 1024 as bigint) as length", "p_brand as kind",
        "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(p_partkey % 500 as int)) as modified", "case when p_partkey % 9 = 0 then 'gone' else p_type end as owner",
    )


@query("a9_storage_usage", f"SELECT kind, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS n_files FROM ({FILES}) GROUP BY ROLLUP (kind)")
def _(s, d):
    return tb.storage_usage(files(s, d))


@query(
    "a9_usage_by_owner",
    f"""WITH f AS (SELECT owner, length, ['db', 'tiles', 'raster', 'log'][p_partkey % 4 + 1] AS k FROM ({FILES})),
 p AS (SELECT owner, CASE owner WHEN 'gone' THEN 'orphan' ELSE 'collection' END AS owner_kind, CAST(coalesce(sum(length) FILTER (k = 'db'), 0) AS BIGINT) AS db_bytes,
 CAST(coalesce(sum(length) FILTER (k = 'tiles'), 0) AS BIGINT) AS tiles_bytes, CAST(coalesce(sum(length) FILTER (k = 'raster'), 0) AS BIGINT) AS raster_bytes,
 CAST(coalesce(sum(length) FILTER (k = 'log'), 0) AS BIGINT) AS other_bytes, CAST(sum(length) AS BIGINT) AS total_bytes FROM f GROUP BY 1)
SELECT * FROM p UNION ALL SELECT NULL, 'total', CAST(sum(db_bytes) AS BIGINT), CAST(sum(tiles_bytes) AS BIGINT), CAST(sum(raster_bytes) AS BIGINT), CAST(sum(other_bytes) AS BIGINT), CAST(sum(total_bytes) AS BIGINT) FROM p""",
)
def _(s, d):
    kinds = F.element_at(F.array(*map(F.lit, ("db", "tiles", "raster", "log"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    owners = fx.table(s, d, "part").select(F.col("p_type").alias("owner"), F.lit("collection").alias("kind")).distinct()
    return cg.usage_by_owner(files(s, d).withColumn("kind", kinds), owners).drop("total_size")


@query("b9_j6_orphan_files", f"SELECT p_partkey, path FROM ({FILES}) WHERE owner = 'gone' AND modified <= (SELECT max(modified) FROM ({FILES})) - INTERVAL 24 HOUR")
def _(s, d):
    owners = fx.table(s, d, "part").select(F.col("p_type").alias("owner"))
    return tb.orphan_files(files(s, d), owners).select("p_partkey", "path")


@query("j5_owner_left_joins", "SELECT c_custkey, n_name, s.s_suppkey IS NOT NULL AS has_tiles FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier s ON s.s_suppkey = c_custkey")
def _(s, d):
    c, n, t = fx.table(s, d, "customer"), fx.table(s, d, "nation"), fx.table(s, d, "supplier")
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(t, t.s_suppkey == c.c_custkey, "left")
    return out.select("c_custkey", "n_name", F.col("s_suppkey").isNotNull().alias("has_tiles"))


def _search_sql(*tokens: str) -> str:
    head, body = "lower(coalesce(split_part(text, chr(10), 1), ''))", "lower(coalesce(text, ''))"
    n = lambda c, t: f"((length({c}) - length(replace({c}, '{t}', ''))) / {len(t)})"
    terms = [
        f"CASE WHEN contains({head}, '{t}') THEN 18 + 6 * {n(head, t)} ELSE 0 END + CASE WHEN contains({body}, '{t}') THEN 4 * least({n(body, t)}, 20) + 2 * power({min(len(t), 12)}, 0.3) ELSE 0 END"
        for t in tokens
    ]
    return f"SELECT doc_id, round({' + '.join(terms)}, 6) AS score, substr(text, 1, 220) AS snippet FROM documents WHERE {' + '.join(terms)} > 0 ORDER BY score DESC, doc_id LIMIT 8"


@query("x11_doc_search", _search_sql("edition", "auch", "than"))
def _(s, d):
    return doc_search(fx.table(s, d, "documents"), ["edition", "auch", "than"])


@query("b8_upsert_types", wv("SELECT id, '{\"n\":' || (rank + 1) || ',\"l\":[1,\"x\"]}' AS properties FROM parcels", "parcels"))
def _(s, d):
    """Numbers and lists stay what they are through a patch."""
    p = fx.parcels(s, d)
    rank = F.get_json_object("properties", "$.rank").cast("int")
    p = p.withColumn("properties", F.format_string('{"n":0,"l":[1,"x"]}'))
    change = fx.parcels(s, d).select("collection_id", "id", F.lit("patch").alias("op"), F.format_string('{"n":%d}', rank + 1).alias("patch"))
    flat = F.expr("from_json(properties, 'map<string,variant>')")
    return tb.upsert(p, change).select("id", F.to_json(F.map_from_arrays(F.array(F.lit("n"), F.lit("l")), F.array(flat["n"], flat["l"]))).alias("properties"))
