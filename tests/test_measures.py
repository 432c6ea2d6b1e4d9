"""Geodesic lengths, interior points, and measures that are written back."""

import json
import math
import random

import pytest
from geomill.functions import geometry as G
from geomill.operators import measures as ms
from geomill.operators import mosaics as mo
from pyspark.sql import functions as F


def test_known_lengths(spark):
    degree = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    rows = [
        (0.0, 0.0, 1.0, 0.0, 6378137 * math.pi / 180),
        (10.0, 0.0, 10.0, 90.0, 10001965.7293127),
        (degree(144, 25, 29.52440), degree(-37, 57, 3.72030), degree(143, 55, 35.38390), degree(-37, 39, 10.15610), 54972.271),
        (-73.8, 40.6, -0.5, 51.6, 5551759.400),
        (179.5, 10.0, -179.5, 10.0, None),
        (5.0, 5.0, 5.0, 5.0, 0.0),
        (0.0, 0.0, 179.9, 0.1, None),
    ]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, want double")
    out = df.select("want", G.geodesic_length(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("m")).collect()
    for r in out:
        if r.want is not None:
            assert abs(r.m - r.want) <= 1e-3 and abs(r.m - r.want) <= 1e-8 * max(r.want, 1)
    assert abs(out[4].m - 109639.4) < 5  # over the date line: one degree on the parallel of 10 degrees
    assert 19_900_000 < out[6].m < 20_003_932  # almost opposite: the other formula


def test_interior_points_are_inside(spark):
    draw = random.Random(5)
    shapes = [[[0.0, 0, 4, 0, 4, 4, 3, 4, 3, 1, 1, 1, 1, 4, 0, 4]], [[0.0, 0, 9, 0, 9, 9, 0, 9], [1.0, 1, 1, 8, 8.5, 8, 8.5, 1]], [[0.0, 0, 1, 0, 0.5, 1]]]
    for _ in range(200):  # stars around a point
        angles = sorted(draw.uniform(0, 2 * math.pi) for _ in range(draw.randrange(5, 30)))
        shapes.append([[v for a in angles for r in [draw.uniform(0.2, 3)] for v in (7 + r * math.cos(a), -3 + r * math.sin(a))]])
    df = spark.createDataFrame([(k, [[float(v) for v in r] for r in s]) for k, s in enumerate(shapes)] + [(-1, []), (-2, None), (-3, [[1.0, 1.0, 2.0, 1.0]])], "id int, rings array<array<double>>")
    out = df.withColumn("p", G.interior_point(F.col("rings"))).select("id", "p", G.holds(F.col("rings"), F.col("p.x"), F.col("p.y")).alias("inside")).collect()
    assert all(r.inside for r in out if r.id >= 0) and all(r.p is None for r in out if r.id < 0)


def test_measures_in_every_part(spark):
    box = lambda x, y, w, h: [[x, y, x + w, y, x + w, y + h, x, y + h]]
    rows = [
        ("c", "two", 0, box(0.0, 0.0, 2.0, 1.0), None, '{"n":1,"area":"old"}'),
        ("c", "two", 1, box(1.0, 0.0, 2.0, 1.0), None, '{"k":[1,2]}'),
        ("c", "line", 0, None, [0.0, 0.0, 1.0, 0.0, 1.0, 1.0], None),
        ("c", "none", 0, None, None, "no json"),
        ("d", "two", 0, box(5.0, 5.0, 1.0, 1.0), None, "{}"),
    ]
    df = spark.createDataFrame(rows, "collection_id string, id string, part_index int, rings array<array<double>>, line array<double>, properties string")
    df = df.withColumns(G.bounds(F.col("rings")))
    found = lambda op, unit: {(r.collection_id, r.id, r.part_index): json.loads(r.properties) for r in ms.measure(df, op, unit, "area").collect()}
    area = found("area", "km2")
    whole = spark.createDataFrame([(box(0.0, 0.0, 3.0, 1.0),)], "rings array<array<double>>").select(G.ellipsoid_area(F.col("rings"), "km2")).first()[0]
    assert abs(area["c", "two", 0]["area"] - whole) < 1e-6 * whole and area["c", "two", 0]["area"] == area["c", "two", 1]["area"]
    assert area["c", "two", 0]["n"] == 1 and area["c", "two", 1]["k"] == [1, 2] and area["c", "line", 0]["area"] == 0.0 and area["c", "none", 0] == {"area": 0.0}
    around = found("perimeter", "km")
    assert abs(around["c", "line", 0]["area"] - (111.319490793 + 110.574388558)) < 1e-6
    assert abs(around["c", "two", 0]["area"] - 2 * (3 * 111.319490793 + 110.574388558)) < 0.2  # the upper side is a geodesic
    with pytest.raises(ValueError):
        ms.measure(df, "area", "km", "x")


def test_search_boxes(spark):
    notch = [[float(v) for v in (0, 0, 4, 0, 4, 4, 3, 4, 3, 1, 1, 1, 1, 4, 0, 4)]]
    gaps = spark.createDataFrame([("a", "g", 7.0, notch), ("a", "twin", 7.0, notch), ("a", "flat", 0.0, [[0.0, 0.0, 1.0, 0.0]]), ("b", "g", 7.0, notch), ("c", "g", 7.0, notch)], "aoi string, id string, area double, rings array<array<double>>")
    areas = spark.createDataFrame([("a", -9.0, -9.0, 9.0, 9.0), ("b", 3.9, 3.9, 5.0, 5.0), ("c", 50.0, 50.0, 60.0, 60.0)], "aoi string, minx double, miny double, maxx double, maxy double")
    out = sorted(map(tuple, mo.search_boxes(gaps, areas).collect()))
    assert [r[:2] for r in out] == [("a", 1), ("b", 0)]  # equal boxes count once; b's gap point is outside, c's gaps are
    assert [round(v, 6) for v in out[0][2:]] == [0.39, 2.39, 0.61, 2.61] and [round(v, 6) for v in out[1][2:]] == [3.9, 3.9, 4.12, 4.12]
