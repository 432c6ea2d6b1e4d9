"""Readers of feature collections, placemarks, scene items and file listings."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scenes as sc
from ..operators.shared import shared_path
from ..operators.tables import parse_features

ASSETS = "map<string,struct<href:string,type:string,roles:array<string>>>"
ITEM = f"id string, collection string, geometry struct<type:string,coordinates:string>, bbox array<double>, properties map<string,string>, assets {ASSETS}"


def read_geojson(spark: SparkSession, path: str, collection_id: str, job: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of files that each hold one FeatureCollection or one Feature. A file is read by one task, as JSON
    documents don't split; large data belong into GeoJSON lines."""
    files = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    held = F.from_json("value", "features array<string>")["features"]
    return parse_features(files.select(F.explode(F.coalesce(held, F.array("value"))).alias("value")), collection_id, job)


def read_kml(spark: SparkSession, path: str, collection_id: str) -> DataFrame:
    """Points, lines and polygons of placemarks: id, collection_id, part_index, kind, properties, coordinates (flat x, y; of a
    polygon the outer ring), rings (of polygons), box.

    An id falls back to a hash of the placemark. The parts of a MultiGeometry become parts; one within another is not read.
    """
    ring = "struct<LinearRing:struct<coordinates:string>>"
    place, area = "struct<coordinates:string>", f"struct<outerBoundaryIs:{ring},innerBoundaryIs:array<{ring}>>"
    many = f"struct<Point:array<{place}>,LineString:array<{place}>,Polygon:array<{area}>>"
    schema = f"_id string, name string, description string, Point {place}, LineString {place}, Polygon {area}, MultiGeometry {many}"
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)

    def part(kind: str, g):
        if kind != "Polygon":
            return F.struct(F.lit(kind).alias("kind"), F.array(g["coordinates"]).alias("texts"))
        holes = F.transform(g["innerBoundaryIs"], lambda h: h["LinearRing"]["coordinates"])
        rings = F.concat(F.array(g["outerBoundaryIs"]["LinearRing"]["coordinates"]), F.coalesce(holes, F.array().cast("array<string>")))
        return F.struct(F.lit(kind).alias("kind"), rings.alias("texts"))

    kinds, none = ("Point", "LineString", "Polygon"), F.array().cast("array<struct<kind:string,texts:array<string>>>")
    inner = [F.coalesce(F.transform(F.col(f"MultiGeometry.{k}"), partial(part, k)), none) for k in kinds]
    each = F.filter(F.concat(F.array(*(part(k, F.col(k)) for k in kinds)), *inner), lambda g: F.get(g["texts"], 0).isNotNull())
    flat = lambda text: F.flatten(F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.transform(F.slice(F.split(p, ","), 1, 2), lambda v: v.try_cast("double"))))
    props = F.to_json(F.struct("name", "description"))
    rows = marks.select(F.coalesce("_id", F.sha2(F.to_json(F.struct("*")), 256)).alias("id"), F.lit(collection_id).alias("collection_id"), props.alias("properties"), F.posexplode(each).alias("part_index", "g"))
    rows = rows.select("id", "collection_id", "part_index", "g.kind", "properties", flat(F.get("g.texts", 0)).alias("coordinates"), F.when(F.col("g.kind") == "Polygon", F.transform("g.texts", flat)).alias("rings"))
    side = lambda odd: F.filter("coordinates", lambda _, i: i % 2 == odd)
    box = {"minx": F.array_min(side(0)), "miny": F.array_min(side(1)), "maxx": F.array_max(side(0)), "maxy": F.array_max(side(1))}
    return rows.withColumns(box)


def read_scenes(spark: SparkSession, catalogs: dict[str, str]) -> DataFrame:
    """Scenes of several catalogs, {name: path} of JSON lines: an item or an item collection in each line.

    catalog, collection, id, rings, box, dt, cloud, href, thumbnail, assets, properties. Lines without an item are left out.
    """
    every = None
    for name, path in catalogs.items():
        lines = spark.read.text(path).select(F.from_json("value", f"{ITEM}, features array<struct<{_as_struct()}>>").alias("f"))
        own = F.struct(*(F.col(f"f.{c}").alias(c) for c in ("id", "collection", "geometry", "bbox", "properties", "assets")))
        items = lines.select(F.explode(F.coalesce("f.features", F.array(own))).alias("i")).where("i.id is not null").select(F.lit(name).alias("catalog"), "i.*")
        every = items if every is None else every.unionByName(items)
    at = lambda i: F.get("bbox", i)
    rings = sc.footprint(F.col("geometry.type"), F.col("geometry.coordinates"), F.col("bbox"))
    out = every.withColumns({"rings": rings, "dt": sc.item_datetime(F.col("properties")), "cloud": sc.cloud_cover(F.col("properties"))})
    out = out.withColumns({"href": sc.primary_href(F.col("assets")), "thumbnail": sc.thumbnail_href(F.col("assets")), "collection": F.coalesce("collection", F.try_element_at("properties", F.lit("collection")))})
    box = {c: at(k) for k, c in enumerate(("minx", "miny", "maxx", "maxy"))}
    return out.withColumns(box).drop("geometry", "bbox")


def _as_struct() -> str:
    return ITEM.replace(" string", ":string").replace(" struct", ":struct").replace(" array", ":array").replace(" map", ":map")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length and modified of all files below a folder; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))
