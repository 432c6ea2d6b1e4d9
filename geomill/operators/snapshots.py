"""Feature tables as snapshots: a version is a manifest that names its data, and is written last.

A change writes new folders of Parquet files, partitioned by collection, and then one manifest; readers follow the newest one.
So a replacement, a filtered delete or a rollback of a load swaps at once, a change that dies leaves the table as it was, and
older versions stay readable until they are expired. Of two changes at the same time the second fails at its manifest.
A manifest holds a line for each collection, with the folders that hold its rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another change has made the version that this one wanted to make."""


def _files(spark: SparkSession, path: str):
    """(file system, path maker) of the table's store."""
    jvm = spark._jvm
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *parts)))
    return at().getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, path)
    if not fs.exists(at("manifests")):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(at("manifests")))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{version, schema, collections: [[name, folders]]} of a version, the newest if not given."""
    known = versions(spark, path)
    if not known:
        return {"version": 0, "schema": None, "collections": []}
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"no version {version}")
    return json.loads(spark.read.text(f"{path}/manifests/{version:012d}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, base: dict, collections: dict, schema: StructType) -> int:
    """Writes the manifest after `base` under a name of its own and then gives it its number, which fails if that is taken."""
    version = base["version"] + 1
    fs, at = _files(spark, path)
    content = json.dumps({"version": version, "schema": schema.jsonValue(), "collections": sorted(([k, v] for k, v in collections.items()), key=str)})
    draft, final = at("manifests", f"{uuid.uuid4().hex}.tmp"), at("manifests", f"{version:012d}.json")
    out = fs.create(draft, True)
    out.write(bytearray(content.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(draft, final, options)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version} is there already") from e
        raise
    return version


def _held(name: str | None) -> Column:
    return F.col("collection_id").eqNullSafe(F.lit(name))


def read(spark: SparkSession, path: str, version: int | None = None, collection: str | None = ...) -> DataFrame:
    """The rows of a version, or of one of its collections; folders are read by partition, so others' files are not opened."""
    m = manifest(spark, path, version)
    if m["schema"] is None:
        raise ValueError(f"no table at {path}")
    schema = StructType.fromJson(m["schema"])
    by_folder: dict[str, list] = {}
    for name, folders in m["collections"]:
        for folder in folders if collection is ... or name == collection else ():
            by_folder.setdefault(folder, []).append(name)
    out = None
    for folder, names in sorted(by_folder.items()):
        some = F.col("collection_id").isin([n for n in names if n is not None])
        part = spark.read.schema(schema).parquet(f"{path}/data/{folder}").where(some | F.col("collection_id").isNull() if None in names else some).select(*schema.names)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _write(df: DataFrame, path: str) -> tuple[str, list]:
    """Rows as a new folder; (folder, its collections)."""
    folder = uuid.uuid4().hex
    where = f"{path}/data/{folder}"
    df.write.partitionBy("collection_id").parquet(where)
    names = df.sparkSession.read.schema(df.schema).parquet(where).select("collection_id").distinct().collect()  # partition values only
    return folder, [r[0] for r in names]


def _schema(base: dict, df: DataFrame) -> StructType:
    if base["schema"] is not None and [(f["name"], f["type"]) for f in base["schema"]["fields"]] != [(f["name"], f["type"]) for f in df.schema.jsonValue()["fields"]]:
        raise ValueError("columns differ from the table's")
    return df.schema


def append(df: DataFrame, path: str) -> int:
    """A version with the rows of `df` too."""
    spark = df.sparkSession
    base = manifest(spark, path)
    schema = _schema(base, df)
    folder, names = _write(df, path)
    collections = {k: list(v) for k, v in base["collections"]}
    for name in names:
        collections[name] = [*collections.get(name, []), folder]
    return _publish(spark, path, base, collections, schema)


def replace(df: DataFrame, path: str) -> int:
    """A version in which the collections that `df` has rows of hold these rows only; others stay, so no rows change nothing."""
    spark = df.sparkSession
    base = manifest(spark, path)
    schema = _schema(base, df)
    folder, names = _write(df, path)
    return _publish(spark, path, base, {k: v for k, v in base["collections"]} | {name: [folder] for name in names}, schema)


def rewrite(spark: SparkSession, path: str, collection: str | None, change: Callable[[DataFrame], DataFrame]) -> int:
    """A version in which a collection's rows are what `change` makes of them: filtered deletes and replacements, the end of a
    shadow load, the rollback of a job, upserts. Where no rows are left the collection goes."""
    base = manifest(spark, path)
    current = read(spark, path, base["version"], collection)
    folder, names = _write(change(current).select(*current.columns), path)
    if any(n != collection for n in names):
        raise ValueError("rows of another collection")
    collections = {k: v for k, v in base["collections"] if k != collection}
    return _publish(spark, path, base, collections | ({collection: [folder]} if names else {}), current.schema)


def drop(spark: SparkSession, path: str, collection: str | None) -> int:
    base = manifest(spark, path)
    return _publish(spark, path, base, {k: v for k, v in base["collections"] if k != collection}, StructType.fromJson(base["schema"]))


def restore(spark: SparkSession, path: str, version: int) -> int:
    """A new version with the rows of an older one."""
    old = manifest(spark, path, version)
    return _publish(spark, path, manifest(spark, path), dict(old["collections"]), StructType.fromJson(old["schema"]))


def orphans(spark: SparkSession, path: str, grace_hours: float = 24.0) -> DataFrame:
    """(kind, path, modified): folders that no version names and drafts of manifests, older than the grace: what died changes left.
    Nothing is deleted."""
    fs, at = _files(spark, path)
    named = {f for v in versions(spark, path) for _, folders in manifest(spark, path, v)["collections"] for f in folders}
    limit, found = (time.time() - grace_hours * 3600) * 1000, []
    for kind, part in (("data", "data"), ("draft", "manifests")):
        for s in fs.listStatus(at(part)) if fs.exists(at(part)) else ():
            name = s.getPath().getName()
            left = name not in named if kind == "data" else name.endswith(".tmp")
            if left and s.getModificationTime() <= limit:
                found.append((kind, f"{part}/{name}", s.getModificationTime() / 1000))
    return spark.createDataFrame(found, "kind string, path string, modified double").withColumn("modified", F.timestamp_seconds("modified"))


def expire(spark: SparkSession, path: str, keep: int = 10) -> list[str]:
    """Removes the manifests of all but the newest `keep` versions; gives the folders that only they named, now orphans."""
    fs, at = _files(spark, path)
    every = versions(spark, path)
    folders = lambda vs: {f for v in vs for _, fs_ in manifest(spark, path, v)["collections"] for f in fs_}
    old = every[:-keep] if keep > 0 else []
    gone = sorted(folders(old) - folders(every[len(old) :]))
    for v in old:
        fs.delete(at("manifests", f"{v:012d}.json"), False)
    return gone
