"""Composite collections: order, sums, ids and what properties say."""

import json
from datetime import datetime
from hashlib import sha256

from geomill.operators import composite as cp
from pyspark.sql import functions as F


def _features(spark):
    rows = [("b", "1", 0, '{"k":"z","n":1}'), ("b", "1", 1, '{"k":"other"}'), ("b", "2", 0, '{"_member_feature_id":"own"}'), ("a", "1", 0, '{"k":"y"}'), ("a", "3", 0, None), ("c", "9", 0, '{"k":"x"}')]
    df = spark.createDataFrame(rows, "collection_id string, id string, part_index int, properties string")
    t = F.lit(datetime(2024, 1, 1))
    return df.withColumns({c: F.lit(float(k)) for k, c in enumerate(("minx", "miny", "maxx", "maxy"))} | {"created_at": t, "updated_at": t})


def test_order_and_properties(spark):
    df = _features(spark)
    ids = lambda **o: [r.id for r in cp.composite_items(df, ["b", "a"], **o).collect()]
    assert ids() == ["b:1", "b:2", "a:1", "a:3"] and ids(limit=2, offset=1) == ["b:2", "a:1"]
    assert ids(sortby="k") == ["a:1", "b:1", "b:2", "a:3"] and ids(sortby="k", descending=True) == ["b:2", "a:3", "b:1", "a:1"]
    assert ids(sortby="id") == ["b:1", "a:1", "b:2", "a:3"]
    props = {r.id: json.loads(r.properties) for r in cp.composite_items(df, ["b", "a"]).collect()}
    assert props["b:1"] == {"k": "z", "n": 1, "_member_collection_id": "b", "_member_feature_id": "1"}
    assert props["b:2"] == {"_member_collection_id": "b", "_member_feature_id": "own"} and props["a:3"]["_member_collection_id"] == "a"
    some = {r.id: json.loads(r.properties) for r in cp.composite_items(df, ["b", "a"], keys=["n"]).collect()}
    assert set(some["b:1"]) == {"n", "_member_collection_id", "_member_feature_id"}
    assert cp.number_matched(df, ["b", "a"]).first()[0] == 4 and cp.number_matched(df, ["none"]).first()[0] == 0


def test_lookup(spark):
    items = spark.createDataFrame([(i,) for i in ("1", "a:1", "3", "c:9", "9", ":1", "b:", "a:3:x", None, "1")], "item string")
    out = sorted(map(tuple, cp.composite_get(_features(spark), ["b", "a"], items).collect()))
    assert out == [("1", "b", "1"), ("3", "a", "3"), ("a:1", "a", "1")]


def test_revision(spark):
    rows = [("x", datetime(2024, 5, 6, 7, 8, 9)), ("y", datetime(2024, 5, 6, 7, 8, 9, 120)), ("z", None)]
    df = spark.createDataFrame(rows, "collection_id string, last_updated timestamp")
    lines = ["z:", "y:2024-05-06T07:08:09.000120+00:00", "gone:", "x:2024-05-06T07:08:09+00:00"]
    assert cp.dynamic_revision(df, ["z", "y", "gone", "x"]).first()[0] == sha256("\n".join(lines).encode()).hexdigest()[:16]
