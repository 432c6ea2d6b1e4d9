"""Loading and table maintenance on feature tables partitioned by collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import coordinates_of, rings_of
from .filters import OPS, condition, properties_map
from .paging import newest

KEY = ["collection_id", "id", "part_index"]


def write_features(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by collection; `replace` swaps only the collections that df has, and an empty df changes nothing. A task writes a range
    of ids, so a collection has as many files as its rows fill."""
    if mode == "replace" and df.isEmpty():
        return
    writer = df.repartitionByRange("collection_id", "id").sortWithinPartitions("collection_id", "id", "part_index").write.partitionBy("collection_id")
    if mode == "replace":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def bulk_append(stage: DataFrame, path: str) -> DataFrame:
    """Appends the newest row of each staged part, then gives count, box and last update of the collections it touched."""
    spark, names = stage.sparkSession, stage.select("collection_id").distinct()
    write_features(dedupe_staging(stage), path)
    touched = spark.read.parquet(path).join(names, "collection_id", "left_semi")
    ends = [F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")]
    # rows are shuffled before ids are told apart, so a task holds the ids of a shuffle partition and not of a split of the table
    features = touched.repartition("collection_id", "id").groupBy("collection_id", "id").agg(*ends, F.max("updated_at").alias("last_updated"))
    return features.groupBy("collection_id").agg(F.count("id").alias("feature_count"), *ends, F.max("last_updated").alias("last_updated"))


def dedupe_staging(stage: DataFrame) -> DataFrame:
    """The newest row of each part; ties by the properties' text."""
    return newest(stage, KEY, F.col("updated_at").desc_nulls_last(), F.col("properties"))


def bulk_replace(current: DataFrame, stage: DataFrame) -> DataFrame:
    """Current rows, with the collections that the stage has swapped for the stage's rows."""
    names = stage.select("collection_id").distinct()
    return current.join(names, "collection_id", "left_anti").unionByName(dedupe_staging(stage))


def _all(filters: list[tuple[str, str, str]]):
    valid = [f for f in filters if f[0] and f[1] in OPS]
    if not valid:
        raise ValueError("at least one valid filter is needed")
    out = F.lit(True)
    for f in valid:
        out = out & condition(*f)
    return F.coalesce(out, F.lit(False))


def delete_by_filters(current: DataFrame, filters: list[tuple[str, str, str]]) -> DataFrame:
    return current.where(~_all(filters))


def replace_filtered(current: DataFrame, stage: DataFrame, filters: list[tuple[str, str, str]]) -> DataFrame:
    return delete_by_filters(current, filters).unionByName(dedupe_staging(stage))


def shadow_finalize(current: DataFrame, collection_id: str, job: str) -> DataFrame:
    """Only the job's rows stay in the collection, and lose their tag."""
    own = F.col("collection_id") == collection_id
    kept = current.where(~own | F.col("bulk_import_job_id").eqNullSafe(job))
    return kept.withColumn("bulk_import_job_id", F.when(own, F.lit(None).cast("string")).otherwise(F.col("bulk_import_job_id")))


def drop_collection(spark: SparkSession, path: str, collection_id: str) -> int:
    """Removes a collection's folder from a table that `write_features` wrote; gives the number of features that went."""
    own = spark.read.parquet(path).where(F.col("collection_id") == collection_id)
    gone, file = own.select("id").distinct().count(), own.select("_metadata.file_path").first()
    if file is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file[0])).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def rollback_job(current: DataFrame, job: str) -> DataFrame:
    return current.where(~F.col("bulk_import_job_id").eqNullSafe(job))


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(collection_id, id, op, patch JSON and, if wanted, seq and columns of `current` that describe a geometry).

    create and replace set the properties, and add the feature where there is none; patch merges them (the change wins, a
    key `id` is ignored); delete drops the feature. Of several changes of one feature the one with the largest seq counts.
    A geometry that a change gives replaces all parts by one; without one the parts stay. Features without a change stay.
    """
    shape = [c for c in changes.columns if c in current.columns and c not in (*KEY, "properties")]
    order = [F.col("seq").desc_nulls_last()] if "seq" in changes.columns else []
    c = newest(changes, ["collection_id", "id"], *order, F.col("op"), F.col("patch"))
    given = F.lit(False)
    for name in shape:
        given = given | F.col(name).isNotNull()
    c = c.select("collection_id", "id", "op", "patch", given.alias("reshaped"), *(F.col(x).alias(f"new_{x}") for x in shape))
    patch = F.map_filter(F.from_json("patch", "map<string,variant>"), lambda k, _: k != "id")  # values keep their types
    old = F.map_filter(F.from_json("properties", "map<string,variant>"), lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    sets = F.col("op").isin("create", "replace")
    merged = F.when(F.col("op") == "patch", F.to_json(F.map_concat(old, patch))).when(sets, F.to_json(patch)).otherwise(F.col("properties"))
    met = current.join(c, ["collection_id", "id"], "left").where("op is null or op <> 'delete'")
    met = met.where(~F.coalesce("reshaped", F.lit(False)) | (F.col("part_index") == 0))
    kept = met.select(*(merged.alias(x) if x == "properties" else F.when(F.col("reshaped"), F.col(f"new_{x}")).otherwise(F.col(x)).alias(x) if x in shape else F.col(x) for x in current.columns))
    added = c.where(sets).join(current.select("collection_id", "id"), ["collection_id", "id"], "left_anti")
    fresh = {"collection_id": F.col("collection_id"), "id": F.col("id"), "part_index": F.lit(0), "properties": F.to_json(patch)} | {x: F.col(f"new_{x}") for x in shape}
    return kept.unionByName(added.select(*(fresh.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in current.schema)))


def read_geojsonl(spark: SparkSession, path: str, collection_id: str, job: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of GeoJSON lines, as `parse_features` gives them."""
    return parse_features(spark.read.text(path), collection_id, job)


def parse_features(texts: DataFrame, collection_id: str, job: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of texts(value) of one feature each, batch or stream. Blank texts are skipped; bad JSON and missing
    geometry are rejects.

    Multi geometries become parts. A part keeps its coordinates as JSON text and its box; a polygon has its rings as well.
    """
    lines = texts.where(F.trim("value") != "")
    schema = "type string, id string, geometry struct<type:string,coordinates:string>, properties map<string,string>"
    parsed = lines.withColumn("f", F.from_json("value", schema))
    good = F.col("f.geometry.type").isNotNull() & F.col("f.geometry.coordinates").isNotNull()
    kind, coords = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    many = F.from_json(coords, "array<string>")
    pieces = F.when(kind.startswith("Multi"), many).otherwise(F.array(coords))
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)"), F.lit(1)), lambda p: F.transform(F.split(p, ","), lambda v: F.trim(v).cast("double")))
    props = F.when(F.col("f.id").isNull() | F.coalesce(F.map_contains_key("f.properties", "id"), F.lit(False)), F.coalesce("f.properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).otherwise(
        F.map_concat(F.coalesce("f.properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.create_map(F.lit("id"), F.col("f.id")))
    )
    rows = parsed.where(good).select(
        F.coalesce("f.id", F.sha2("value", 256)).alias("id"), F.lit(collection_id).alias("collection_id"), F.regexp_replace(kind, "^Multi", "").alias("kind"),
        F.to_json(props).alias("properties"), F.lit(job).cast("string").alias("bulk_import_job_id"), F.posexplode(pieces).alias("part_index", "coordinates"),
    )
    rows = rows.withColumn("_n", numbers(F.col("coordinates")))
    for name, at, f in (("minx", 0, F.array_min), ("miny", 1, F.array_min), ("maxx", 0, F.array_max), ("maxy", 1, F.array_max)):
        rows = rows.withColumn(name, f(F.transform("_n", _nth(at))))
    rows = rows.withColumn("rings", rings_of(F.col("kind"), F.col("coordinates")))
    return rows.drop("_n"), parsed.where(~F.coalesce(good, F.lit(False))).select("value")


def _nth(at: int):
    return lambda pair: pair[at]


def write_geojsonl(df: DataFrame, path: str) -> None:
    """One feature per line from columns id, kind, coordinates and properties, sorted by id and part. Without coordinates, features
    are polygons of their rings."""
    if "coordinates" not in df.columns:
        df = df.withColumns({"kind": F.lit("Polygon"), "coordinates": coordinates_of(F.col("rings"))})
    text = lambda c: F.regexp_replace(F.to_json(F.array(F.col(c))), r"(?s)^\[(.*)\]$", "$1")  # noqa: E731  a JSON string, or null
    geometry = F.coalesce(F.concat(F.lit('{"type":'), text("kind"), F.lit(',"coordinates":'), F.col("coordinates"), F.lit("}")), F.lit("null"))
    line = F.concat(F.lit('{"type":"Feature","id":'), text("id"), F.lit(',"geometry":'), geometry, F.lit(',"properties":'), F.coalesce("properties", F.lit("{}")), F.lit("}"))
    df.repartitionByRange("id").sortWithinPartitions("id", "part_index").select(line.alias("value")).write.mode("overwrite").text(path)


def orphan_files(files: DataFrame, owners: DataFrame, grace_hours: int = 24) -> DataFrame:
    """Files without a known owner that are older than the grace period before the newest file; candidates only."""
    last = files.agg(F.max("modified")).first()[0]
    old = files.where(F.col("modified") <= F.lit(last) - F.make_interval(hours=F.lit(grace_hours)))
    return old.join(owners.select("owner").distinct(), "owner", "left_anti")


def storage_usage(files: DataFrame) -> DataFrame:
    """Bytes and files by kind and in total (kind null)."""
    return files.rollup("kind").agg(F.sum("length").alias("bytes"), F.count("*").alias("n_files"))
