"""Feature, scene, pixel and request tables derived from the driver's tables.

Coordinates are multiples of 1/8 degree, so areas are exact in double. A feature row is one part of a logical feature:
id, collection_id, part_index, box (minx, miny, maxx, maxy), properties (JSON text), bulk_import_job_id, created_at, updated_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("points_"), "event_type").alias("collection_id"),
        F.lit(0).alias("part_index"),
        F.expr("cast((user_id * 37 + event_id * 11) % 2880 as double) / 8 - 180").alias("lon"),
        F.expr("cast((event_id * 13) % 1360 as double) / 8 - 85").alias("lat"),
        F.to_json(F.struct("event_type", F.col("user_id").alias("user"), F.get_json_object("props", "$.k").alias("k"))).alias("properties"),
        F.col("ts").alias("created_at"),
    )


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = "cast((o_orderkey * 97) % 2784 as double) / 8 - 180", "cast((o_orderkey * 61) % 1296 as double) / 8 - 85"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("parcels_"), "o_orderstatus").alias("collection_id"),
        F.lit(0).alias("part_index"),
        F.expr(x).alias("minx"),
        F.expr(y).alias("miny"),
        F.expr(f"{x} + cast(o_custkey % 8 + 1 as double) / 8").alias("maxx"),
        F.expr(f"{y} + cast(o_orderkey % 6 + 1 as double) / 8").alias("maxy"),
        F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.expr("cast(o_custkey % 50 as int)").alias("rank"))).alias("properties"),
        F.expr("case when o_orderkey % 11 = 0 then concat('job', o_orderkey % 3) end").alias("bulk_import_job_id"),
        F.col("o_orderdate").alias("created_at"),
        F.expr("o_orderdate + interval 1 hour").alias("updated_at"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels as parts: every fifth one is cut into two halves."""
    halves = F.when(F.col("id").cast("long") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cut = parcels(spark, sf_dir).withColumn("halves", halves).select("*", F.explode("halves").alias("half"))
    middle = (F.col("minx") + F.col("maxx")) / 2
    two = F.size("halves") == 2
    return cut.withColumns(
        {
            "part_index": F.col("half"),
            "minx": F.when(two & (F.col("half") == 1), middle).otherwise(F.col("minx")),
            "maxx": F.when(two & (F.col("half") == 0), middle).otherwise(F.col("maxx")),
        }
    ).drop("halves", "half")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.expr("cast(n_nationkey % 5 * 72 as double) - 180").alias("minx"),
        F.expr("cast(n_nationkey div 5 * 34 as double) - 85").alias("miny"),
        F.expr("cast(n_nationkey % 5 * 72 as double) - 108").alias("maxx"),
        F.expr("cast(n_nationkey div 5 * 34 as double) - 51").alias("maxy"),
        F.col("n_regionkey").cast("string").alias("zone_group"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("raster_id"),
        F.col("l_linenumber").alias("band"),
        F.expr("cast((l_orderkey * 41 + l_partkey * 7) % 2880 as double) / 8 - 180 + 0.0625D").alias("lon"),
        F.expr("cast((l_partkey * 19) % 1360 as double) / 8 - 85 + 0.0625D").alias("lat"),
        F.col("l_quantity").cast("double").alias("value"),
        (F.col("l_returnflag") == "N").alias("masked"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = parcels(spark, sf_dir).alias("p").join(table(spark, sf_dir, "orders").alias("o"), F.expr("p.id = cast(o.o_orderkey as string)"))
    return base.select(
        F.col("o_orderpriority").alias("catalog"),
        F.expr("concat('S2A_T', 10 + o_orderkey % 50, 'KNS_', date_format(o_orderdate, 'yyyyMMdd'), '_', o_orderkey)").alias("id"),
        F.expr("concat('c', o_orderkey % 4)").alias("collection"),
        F.expr("concat('T', 10 + o_orderkey % 50, 'KNS')").alias("mgrs"),
        F.col("o_orderdate").alias("dt"),
        F.expr("cast(floor(o_totalprice) % 100 as double)").alias("cloud"),
        "minx",
        "miny",
        (F.col("minx") + (F.col("maxx") - F.col("minx")) * 8).alias("maxx"),
        (F.col("miny") + (F.col("maxy") - F.col("miny")) * 8).alias("maxy"),
        F.expr("concat('s3://scenes/', o_orderkey, '.tif')").alias("href"),
    )


def as_requests(events: DataFrame) -> DataFrame:
    """The columns of request events that metrics read, of a table or stream of events."""
    return events.selectExpr(
        "cast(ts as timestamp) as created_at", "concat('/', event_type) as route_template", "cast(floor(value * 10) as int) as latency_ms",
        "case event_id % 20 when 0 then 500 when 1 then 404 when 2 then 301 else 200 end as status_code",
    )


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("/"), "event_type").alias("route_template"),
        F.expr("case event_id % 4 when 0 then 'POST' else 'GET' end").alias("method"),
        F.expr("cast(floor(value * 10) as int)").alias("latency_ms"),
        F.expr("case event_id % 20 when 0 then 500 when 1 then 404 when 2 then 301 else 200 end").alias("status_code"),
    )


#: The same tables as SQL views, for checks in another engine.
SQL = {
    "points": """SELECT CAST(event_id AS VARCHAR) AS id, 'points_' || event_type AS collection_id,
 CAST((user_id * 37 + event_id * 11) % 2880 AS DOUBLE) / 8 - 180 AS lon, CAST((event_id * 13) % 1360 AS DOUBLE) / 8 - 85 AS lat,
 event_type, user_id, ts AS created_at, event_id FROM events""",
    "parcels": """SELECT *, minx + CAST(o_custkey % 8 + 1 AS DOUBLE) / 8 AS maxx, miny + CAST(o_orderkey % 6 + 1 AS DOUBLE) / 8 AS maxy FROM (
 SELECT CAST(o_orderkey AS VARCHAR) AS id, 'parcels_' || o_orderstatus AS collection_id, CAST((o_orderkey * 97) % 2784 AS DOUBLE) / 8 - 180 AS minx,
 CAST((o_orderkey * 61) % 1296 AS DOUBLE) / 8 - 85 AS miny, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_custkey % 50 AS INT) AS rank,
 CASE WHEN o_orderkey % 11 = 0 THEN 'job' || (o_orderkey % 3) END AS job, o_orderdate AS created_at, o_orderdate + INTERVAL 1 HOUR AS updated_at, o_orderkey, o_custkey FROM orders)""",
    "parts": """SELECT id, collection_id, h AS part_index, CASE WHEN h = 1 THEN (minx + maxx) / 2 ELSE minx END AS minx, miny,
 CASE WHEN h = 0 AND o_orderkey % 5 = 0 THEN (minx + maxx) / 2 ELSE maxx END AS maxx, maxy, status, priority, rank, job, created_at, updated_at, o_orderkey
 FROM parcels, (SELECT unnest([0, 1]) AS h) WHERE h = 0 OR o_orderkey % 5 = 0""",
    "zones": """SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey % 5 * 72 AS DOUBLE) - 180 AS minx, CAST(n_nationkey // 5 * 34 AS DOUBLE) - 85 AS miny,
 CAST(n_nationkey % 5 * 72 AS DOUBLE) - 108 AS maxx, CAST(n_nationkey // 5 * 34 AS DOUBLE) - 51 AS maxy, CAST(n_regionkey AS VARCHAR) AS zone_group FROM nation""",
    "pixels": """SELECT l_suppkey AS raster_id, l_linenumber AS band, CAST((l_orderkey * 41 + l_partkey * 7) % 2880 AS DOUBLE) / 8 - 180 + 0.0625::DOUBLE AS lon,
 CAST((l_partkey * 19) % 1360 AS DOUBLE) / 8 - 85 + 0.0625::DOUBLE AS lat, CAST(l_quantity AS DOUBLE) AS value, l_returnflag = 'N' AS masked FROM lineitem""",
    "scenes": """SELECT o_orderpriority AS catalog, 'S2A_T' || (10 + p.o_orderkey % 50) || 'KNS_' || strftime(o_orderdate, '%Y%m%d') || '_' || p.o_orderkey AS id,
 'c' || (p.o_orderkey % 4) AS collection, 'T' || (10 + p.o_orderkey % 50) || 'KNS' AS mgrs, o_orderdate AS dt, CAST(floor(o_totalprice) % 100 AS DOUBLE) AS cloud,
 minx, miny, minx + (maxx - minx) * 8 AS maxx, miny + (maxy - miny) * 8 AS maxy, 's3://scenes/' || p.o_orderkey || '.tif' AS href FROM parcels p JOIN orders o ON o.o_orderkey = p.o_orderkey""",
    "request_events": """SELECT event_id AS id, ts AS created_at, '/' || event_type AS route_template, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
 CAST(floor(value * 10) AS INT) AS latency_ms, CASE event_id % 20 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN 301 ELSE 200 END AS status_code FROM events""",
}
_NEEDS = {"parts": ("parcels",), "scenes": ("parcels",)}


def with_views(sql: str, *names: str) -> str:
    """`sql` with the named derived tables in front."""
    every = list(dict.fromkeys(n for name in names for n in (*_NEEDS.get(name, ()), name)))
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in every)
    return f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"
