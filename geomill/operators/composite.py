"""Composite collections: the ordered union of member collections, seen as one.

`members` is the short, ordered list of a composite's member collections. An item's id is member:feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import prop
from .paging import logical, ordered

SEPARATOR = ":"


def member_order(members: list[str], column: str = "collection_id") -> Column:
    return F.array_position(F.array(*(F.lit(m) for m in members)), F.col(column)).cast("int") - 1


def of_members(df: DataFrame, members: list[str]) -> DataFrame:
    """Rows of the members, with `member_ord`; the filter reaches the partitions of the collections."""
    return df.where(F.col("collection_id").isin(members)).withColumn("member_ord", member_order(members))


def number_matched(df: DataFrame, members: list[str]) -> DataFrame:
    """number_matched: the sum over members of their features, counted by id."""
    return of_members(df, members).agg(F.countDistinct("collection_id", "id").alias("number_matched"))


def _marked(keys: list[str] | None) -> Column:
    """Properties with the member and the feature they come from, unless they have such keys; of others only `keys`, if given."""
    held = F.coalesce(F.from_json("properties", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    own = F.create_map(F.lit("_member_collection_id"), F.col("collection_id").cast("variant"), F.lit("_member_feature_id"), F.col("id").cast("variant"))
    both = F.map_concat(held, F.map_filter(own, lambda k, _: ~F.map_contains_key(held, k)))
    return F.to_json(both if keys is None else F.map_filter(both, lambda k, _: k.isin(keys) | k.startswith("_member")))


def composite_items(df: DataFrame, members: list[str], sortby: str | None = None, descending: bool = False, limit: int = 100, offset: int = 0, keys: list[str] | None = None) -> DataFrame:
    """A page of a composite's logical features: id (member:feature), member_ord, collection_id, box, properties, times, in order.

    Without `sortby`: by member, then id. Else by id, created_at or a property's text over all members (null last, or first when
    descending), then by member and id. Only ids and sort keys of all features are sorted; the parts of the page's features,
    1000 at most, are grouped after. A feature has its first part's properties, with `_member_collection_id` and
    `_member_feature_id`.
    """
    limit = max(1, min(limit, 1000))
    rows = of_members(df, members)
    key = {None: F.lit(0), "id": F.first("id"), "created_at": F.min("created_at")}.get(sortby)
    keyed = rows.groupBy("collection_id", "id", "member_ord").agg((F.min_by(prop(sortby), "part_index") if key is None else key).alias("_key"))
    order = [ordered(F.col("_key"), descending), F.col("member_ord"), F.col("id")]
    page = keyed.orderBy(*order).offset(offset).limit(limit)
    found = logical(rows.join(F.broadcast(page.select("collection_id", "id", "_key")), ["collection_id", "id"]), "member_ord", "_key")
    name = F.concat("collection_id", F.lit(SEPARATOR), "id")
    return found.orderBy(*order).select(name.alias("id"), "member_ord", "collection_id", "minx", "miny", "maxx", "maxy", _marked(keys).alias("properties"), "created_at", "updated_at")


def composite_get(df: DataFrame, members: list[str], items: DataFrame) -> DataFrame:
    """(item, collection_id, id) of each id of items(item) that the composite has.

    With a separator and something on both sides of the first one it names a member and a feature of it, and nothing else is
    looked at; without it is a feature of the first member that has it.
    """
    items = items.select("item").where("item is not null").distinct()
    at = F.instr("item", SEPARATOR)
    whole = (at > 1) & (at < F.length("item"))
    named = items.select("item", F.when(whole, F.left("item", at - 1)).alias("_member"), F.when(whole, F.substring("item", at + 1, F.length("item"))).otherwise(F.col("item")).alias("_id"))
    have = of_members(df, members).select("collection_id", "id", "member_ord").distinct()
    met = named.join(have, (F.col("_id") == F.col("id")) & (F.col("_member").isNull() | (F.col("_member") == F.col("collection_id"))))
    return met.groupBy("item").agg(F.min_by(F.struct("collection_id", "id"), "member_ord").alias("f")).select("item", "f.collection_id", "f.id")


def dynamic_revision(collections: DataFrame, members: list[str]) -> DataFrame:
    """revision: 16 characters that change when a member's features do: a digest of `member:last update` lines in member order.

    collections(collection_id, last_updated); a member that isn't there or never was updated has an empty time. The lines are
    as many as the composite has members.
    """
    at, micros = F.col("last_updated"), F.date_format("last_updated", "SSSSSS")
    stamp = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))
    known = collections.where(F.col("collection_id").isin(members)).groupBy("collection_id").agg(F.max(stamp).alias("stamp"))
    times = known.agg(F.map_from_entries(F.collect_list(F.struct("collection_id", F.coalesce("stamp", F.lit(""))))).alias("m"))  # members only
    lines = [F.concat(F.lit(f"{m}:"), F.coalesce(F.col("m")[m], F.lit(""))) for m in members]
    return times.select(F.left(F.sha2(F.concat_ws("\n", *lines), 256), F.lit(16)).alias("revision"))
