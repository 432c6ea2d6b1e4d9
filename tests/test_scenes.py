"""Readers, scene columns, mosaic plans and previews: golden cases and brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from geomill.functions import geometry as G
from geomill.functions import scenes as sc
from geomill.operators import cover as cv
from geomill.operators import previews as pv
from geomill.operators.spatial import BOX
from geomill.sources import readers as rd
from geomill.streaming import metrics as st


def boxed(spark, rows, names):
    df = spark.createDataFrame(rows, names)
    return df.withColumn("rings", G.box_rings(*BOX))


def squares(spark, n, seed):
    """Scenes as boxes on a grid of unit squares over an area of 12 by 12."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, w, h = rng.randint(-3, 11), rng.randint(-3, 11), rng.randint(1, 6), rng.randint(1, 6)
        rows.append((f"s{k:03d}", float(rng.randint(0, 5)), dt.datetime(2024, 1, 1 + rng.randint(0, 4)), float(x), float(y), float(x + w), float(y + h)))
    return rows


SCENE = "id string, cloud double, dt timestamp, minx double, miny double, maxx double, maxy double"
AOI = "aoi string, minx double, miny double, maxx double, maxy double"


def greedy_on_squares(rows, side=12):
    cells = {r[0]: {(x, y) for x in range(int(r[3]), int(r[5])) for y in range(int(r[4]), int(r[6]))} for r in rows}
    hole, picks, left = {(x, y) for x in range(side) for y in range(side)}, [], dict(cells)
    cloud = {r[0]: r[1] for r in rows}
    while left and len(hole) > 0.005 * side * side:
        best = min(left, key=lambda k: (-len(left[k] & hole), -len(left[k] & hole) / len(left[k]), cloud[k], k))
        if not left[best] & hole or (picks and len(left[best] & hole) < 0.005 * len(hole)):
            break
        picks.append(best)
        hole -= left.pop(best)
    return picks, len(hole)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_equals_squares(spark, seed):
    rows = squares(spark, 60, seed)
    plan = cv.cover(boxed(spark, [("a", 0.0, 0.0, 12.0, 12.0)], AOI), boxed(spark, rows, SCENE)).collect()
    picks = [r.id for r in sorted((r for r in plan if r.kind == "pick"), key=lambda r: r.place)]
    want, left = greedy_on_squares(rows)
    assert picks == want
    total = next(r for r in plan if r.kind == "total")
    assert abs(total.uncovered - left / 144) < 1e-9
    assert abs(sum(r.area for r in plan if r.kind in ("pick", "rest")) - 144) < 1e-9


def test_area_without_scenes_is_all_rest(spark):
    plan = cv.cover(boxed(spark, [("a", 0.0, 0.0, 2.0, 2.0)], AOI), boxed(spark, [], SCENE)).collect()
    assert sorted(r.kind for r in plan) == ["rest", "total"]
    assert next(r for r in plan if r.kind == "total").uncovered == 1.0


def test_strips_prefer_one_day(spark):
    whole = [(f"d{k}", 1.0, dt.datetime(2024, 1, 2), 4.0 * k, 0.0, 4.0 * k + 4, 8.0) for k in range(4)]
    mixed = [("x", 0.0, dt.datetime(2024, 1, 5), 0.0, 0.0, 1.5, 4.0)]
    plan = cv.cover(boxed(spark, [("a", 0.0, 0.0, 16.0, 8.0)], AOI), boxed(spark, whole + mixed, SCENE), mode="strips").collect()
    assert sorted(r.id for r in plan if r.kind == "pick") == ["d0", "d1", "d2", "d3"]
    assert next(r for r in plan if r.kind == "total").uncovered == 0.0


def test_newest_breaks_ties(spark):
    rows = [("old", 0.0, dt.datetime(2024, 1, 1), 0.0, 0.0, 2.0, 2.0), ("new", 9.0, dt.datetime(2024, 2, 1), 0.0, 0.0, 2.0, 2.0)]
    area = boxed(spark, [("a", 0.0, 0.0, 2.0, 2.0)], AOI)
    picked = lambda **o: [r.id for r in cv.cover(area, boxed(spark, rows, SCENE), **o).where("kind = 'pick'").collect()]
    assert picked() == ["old"] and picked(prefer="newest") == ["new"]


def flood(cells):
    todo, out = set(cells), []
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            x, y = edge.pop()
            group.add((x, y))
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in todo:
                    todo.remove(q)
                    edge.append(q)
        out.append(group)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_blobs_and_holes_equal_flood_fill(spark, seed):
    rng = random.Random(seed)
    data = {(x, y) for x in range(14) for y in range(11) if rng.random() < 0.55}
    grey = lambda q: 100 if q in data else rng.choice((5, 250))
    rows = [(1, x, y, g, g, g) for x in range(14) for y in range(11) for g in [grey((x, y))]]
    got = pv.data_footprint(spark.createDataFrame(rows, "raster_id long, px long, py long, red int, green int, blue int")).collect()
    largest = min(flood(data), key=lambda b: (-len(b), min((y, x) for x, y in b)))
    frame = {(x, y) for x in range(-1, 15) for y in range(-1, 12)}
    outside = next(b for b in flood(frame - largest) if (-1, -1) in b)
    assert [r.n_pixels for r in got] == [len(frame) - len(outside)]
    edge = {(x + a, y + b) for x, y in largest for a in (0, 1) for b in (0, 1)}
    assert got[0].corners[0] == list(min(edge, key=lambda q: (q[0] - q[1], q[0], -q[1])))


def test_preview_of_padding_only_has_no_row(spark):
    assert pv.data_footprint(spark.createDataFrame([(1, 0, 0, 3, 4, 5), (1, 1, 0, 255, 240, 236)], "raster_id long, px long, py long, red int, green int, blue int")).collect() == []


def test_winter_ends_on_28_february(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 9), dt.date(2023, 12, 20)), (None, dt.date(2024, 1, 1))], "a date, b date")
    got = df.select(sc.date_slices(F.col("a"), F.col("b"), ["winter"]).alias("s")).collect()
    assert [tuple(x) for x in got[0].s] == [(dt.date(2023, 12, 20), dt.date(2023, 12, 31)), (dt.date(2024, 1, 1), dt.date(2024, 2, 28))]
    assert [tuple(x) for x in got[1].s] == [(dt.date(2024, 1, 1), dt.date(2024, 1, 1))]


def test_item_fallbacks(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    asset = lambda href, **more: {"href": href, **more}
    items = [
        {"id": "a", "geometry": {"type": "Polygon", "coordinates": [ring]}, "bbox": [0, 0, 1, 1], "properties": {"cloud_cover": "x", "cloud": 7, "datetime": "2024-02-03T04:05:06Z", "collection": "c"}, "assets": {"b": asset("https://h/b.TIF"), "visual": asset("s3://no")}},
        {"id": "b", "geometry": {"type": "Point", "coordinates": [0, 0]}, "bbox": [2, 2, 4, 5], "properties": {}, "assets": {"p": asset("https://h/p.PNG")}},
        {"id": "c", "geometry": None, "properties": None, "assets": None},
    ]
    path = tmp_path / "items.json"
    path.write_text("\n".join([json.dumps(items[0]), json.dumps({"type": "FeatureCollection", "features": items[1:]}), "not json"]))
    got = {r.id: r for r in rd.read_scenes(spark, {"k": str(path)}).withColumn("area", G.planar_area(F.col("rings"))).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].cloud, got["a"].dt, got["a"].href, got["a"].collection, got["a"].area) == (7.0, dt.datetime(2024, 2, 3, 4, 5, 6), "https://h/b.TIF", "c", 1.0)
    assert (got["b"].thumbnail, got["b"].href, got["b"].area) == ("https://h/p.PNG", None, 6.0)
    assert (got["c"].rings, got["c"].cloud, got["c"].href) == (None, None, None)


def test_geojson_collection_and_kml(spark, tmp_path):
    point = {"type": "Feature", "id": "p", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"name": "a"}}
    multi = {"type": "Feature", "id": "m", "geometry": {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, "properties": None}
    bare = {"type": "Feature", "id": "n", "geometry": None, "properties": {}}
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [point, multi, bare]}, indent=1))
    good, bad = rd.read_geojson(spark, str(tmp_path / "f.json"), "c")
    assert sorted((r.id, r.part_index, r.minx, r.maxy) for r in good.collect()) == [("m", 0, 1.0, 2.0), ("m", 1, 3.0, 4.0), ("p", 0, 1.0, 2.0)]
    assert bad.count() == 1
    line = "<LineString><coordinates>0,0,5 2,1,5\n 4,-1</coordinates></LineString>"
    ring = "<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    (tmp_path / "f.kml").write_text(f'<?xml version="1.0"?><kml><Document><Placemark id="l"><name>x</name>{line}</Placemark><Placemark>{ring}</Placemark></Document></kml>')
    got = sorted(rd.read_kml(spark, str(tmp_path / "f.kml"), "c").collect(), key=lambda r: r.kind)
    assert [(r.kind, r.minx, r.miny, r.maxx, r.maxy) for r in got] == [("LineString", 0.0, -1.0, 4.0, 1.0), ("Polygon", 0.0, 0.0, 1.0, 1.0)]
    assert got[0].id == "l" and got[0].coordinates == [0.0, 0.0, 2.0, 1.0, 4.0, -1.0]


def test_stream_drops_repeats_and_goes_on(spark, tmp_path):
    row = lambda k: json.dumps({"type": "Feature", "id": k, "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}})
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for k, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join([*map(row, ids), "", "junk"]))
        st.run_to_table(st.ingest_stream(spark, folder, "c"), out, log)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_pairs_without_address_or_shape_are_counted(spark):
    rows = [("c", "1", "/a", None, [0.0, 0.0, 1.0, 1.0]), ("c", "2", " ", None, [0.0, 0.0, 1.0, 1.0]), ("c", "3", "/b", None, None), ("c", "4", "/d", [], [0.0, 0.0])]
    pairs, counts = cv.collection_pairs(spark.createDataFrame(rows, "collection_id string, id string, href string, rings array<array<double>>, bounds array<double>"))
    assert [r.id for r in pairs.collect()] == ["1"]
    assert [tuple(r) for r in counts.collect()] == [("c", 4, 1, 2)]
