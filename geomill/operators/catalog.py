"""Lists of collections, and the storage that their files take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .paging import ordered

SORTS = ("id", "title", "description", "created_at")
CLASSES = ("db", "tiles", "raster")


def collections_matching(collections: DataFrame, q: str | None = None, box=None, kind: str | None = None, tiled: DataFrame | None = None) -> DataFrame:
    """Collections by a text in id, title or description (case aside), an extent that meets `box`, their type, and whether they
    stand in `tiled` (id). Collections without an extent only drop out if a box is given. Who may see them: filters.visible_to."""
    if tiled is not None:
        has = tiled.select(F.col("id").alias("_tiled")).where("_tiled is not null")
        collections = collections.join(has, F.col("id") == F.col("_tiled"), "left_semi")
    if kind is not None:
        collections = collections.where(F.col("collection_type") == kind)
    if q and q.strip():
        text = F.lit(q.strip().lower())
        hit = F.lit(False)
        for c in ("id", "title", "description"):
            hit = hit | F.coalesce(F.contains(F.lower(c), text), F.lit(False))
        collections = collections.where(hit)
    if box is not None:
        x1, y1, x2, y2 = box
        collections = collections.where((F.col("minx") <= x2) & (F.col("maxx") >= x1) & (F.col("miny") <= y2) & (F.col("maxy") >= y1))
    return collections


def collections_list(collections: DataFrame, sortby: str = "id", descending: bool = False, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """A page of matching collections; an unknown `sortby` sorts by id, ties go by id. Count them with collections_matching."""
    by = sortby if sortby in SORTS else "id"
    page = collections_matching(collections, **filters).orderBy(ordered(F.col(by), descending), "id").offset(offset)
    return page if limit is None else page.limit(limit)


def usage_by_owner(files: DataFrame, owners: DataFrame) -> DataFrame:
    """Bytes of files(owner, kind, length) by owner and class, with what the owner is: its kind in owners(owner, kind), each once,
    else orphan; last, a row of all (owner_kind total). Kinds of files beyond CLASSES are other bytes, null lengths none."""
    held = lambda hit, name: F.sum(F.when(hit, F.coalesce("length", F.lit(0))).otherwise(0)).alias(f"{name}_bytes")
    known = F.coalesce(F.col("kind").isin(*CLASSES), F.lit(False))
    sums = [held(F.col("kind") == c, c) for c in CLASSES] + [held(~known, "other")]
    named = owners.select(F.col("owner").alias("_owner"), F.col("kind").alias("_kind"))
    per = files.groupBy("owner").agg(*sums).join(named, F.col("owner") == F.col("_owner"), "left")
    per = per.withColumn("owner_kind", F.coalesce("_kind", F.lit("orphan"))).drop("_owner", "_kind")
    parts = [f"{c}_bytes" for c in (*CLASSES, "other")]
    every = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts)).select(F.lit(None).cast("string").alias("owner"), *parts, F.lit("total").alias("owner_kind"))
    total = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    out = per.unionByName(every).withColumn("total_bytes", total).withColumn("total_size", S.format_bytes(F.col("total_bytes")))
    return out.orderBy(F.col("owner_kind") == "total", F.desc("total_bytes"), "owner")
