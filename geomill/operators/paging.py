"""Sorting, paging and dedupe. Ascending order puts nulls last and descending first, as the reference data store does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import prop


def logical(df: DataFrame, *also: str) -> DataFrame:
    """One row per logical feature: box of all parts, properties of the first part, first creation, last update; `also` are
    columns that all its parts share."""
    return df.groupBy("collection_id", "id", *also).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
        F.min_by("properties", "part_index").alias("properties"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
        F.sum((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("area"), F.count("*").alias("n_parts"),
    )


def ordered(column: Column, descending: bool) -> Column:
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def _page_order(sortby: str, descending: bool) -> list[Column]:
    return [ordered(F.col("sort_key"), descending), ordered(F.col("id"), descending if sortby == "id" else False), F.col("collection_id")]


def page(df: DataFrame, sortby: str = "id", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of logical features by id, created_at or a property's text; ties by id. Only the page's rows are carried on."""
    limit = max(1, min(limit, 1000))
    order = _page_order(sortby, descending)
    key = {"id": F.col("id"), "created_at": F.min("created_at")}.get(sortby)
    keyed = df.groupBy("collection_id", "id").agg((F.min_by(prop(sortby), "part_index") if key is None else F.min(key) if sortby == "id" else key).alias("sort_key"))
    return keyed.orderBy(*order).offset(offset).limit(limit)


def page_features(df: DataFrame, sortby: str = "id", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """The page's logical features with their `place` on it, from 1. Ids are paged first (at most 1000, broadcast), so only the
    parts of the page's features are grouped."""
    ids = page(df, sortby, descending, limit, offset)
    ids = ids.select("collection_id", "id", F.row_number().over(Window.orderBy(*_page_order(sortby, descending))).alias("place"))
    return logical(df.join(F.broadcast(ids), ["collection_id", "id"]), "place").orderBy("place")


def page_summary(df: DataFrame, **options) -> DataFrame:
    """The box of a page's features and the number of all that match, in one pass; the page (at most 1000 ids) is broadcast."""
    ids = page(df, **options).select("collection_id", "id", F.lit(True).alias("_paged"))
    held = lambda f, c: f(F.when(F.col("_paged"), F.col(c))).alias(c)
    box = (held(F.min, "minx"), held(F.min, "miny"), held(F.max, "maxx"), held(F.max, "maxy"))
    return df.join(F.broadcast(ids), ["collection_id", "id"], "left").agg(*box, F.countDistinct("id").alias("number_matched"))


def keyset_page(df: DataFrame, after_id: str, after_part: int, limit: int = 1000) -> DataFrame:
    later = (F.col("id") > after_id) | ((F.col("id") == after_id) & (F.col("part_index") > after_part))
    return df.where(later).orderBy("id", "part_index", "collection_id").limit(limit)


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. Rows are shuffled before they are sorted, so what a task sorts is a shuffle
    partition and not a split of the input."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.repartition(*keys).withColumn("_n", first).where("_n = 1").drop("_n")


def swap_pages(df: DataFrame, keys: list[str], order: list[Column], offset: int = 0, limit: int = 5) -> DataFrame:
    """Rows offset..offset+limit of each key, with the key's total; limit is held to 1..50."""
    limit = max(1, min(limit, 50))
    w = Window.partitionBy(*keys)
    placed = df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return placed.where((F.col("place") > offset) & (F.col("place") <= offset + limit))
