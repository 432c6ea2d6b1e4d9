"""Pairs of features whose shapes repeat: what depends on shapes alone is done once for equal ones, and every pair is there."""

import json

import pytest
from geomill.functions import rings as R
from geomill.operators import lines as ln
from geomill.operators import overlay as ov
from geomill.operators import spatial as sp
from pyspark.sql import functions as F

SQUARE, LOW = ([[float(v) for v in r]] for r in ([0, 0, 4, 0, 4, 4, 0, 4, 0, 0], [2, -1, 6, -1, 6, 1, 2, 1, 2, -1]))
POLYGONS = "id string, rings array<array<double>>, properties string"


def _polygons(spark, rows):
    return ov.with_box(spark.createDataFrame(rows, POLYGONS))


def _seen(monkeypatch, module, name):
    """The tables that `name` gives while the test runs."""
    every, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: every.append(real(*a, **k)) or every[-1])
    return every


def test_copies_stand_in_rows_of_bounded_length(spark, monkeypatch):
    monkeypatch.setattr(sp, "TOGETHER", 3)
    monkeypatch.setattr(sp, "DENSE", 4)
    rows = [(f"s{k}", SQUARE, None) for k in range(11)] + [("low", LOW, None), ("none", None, None)]
    got = sp.by_shape(_polygons(spark, rows).select("id", "rings", *sp.BOX), "rings").collect()
    assert all(1 <= len(r.members) <= 3 and len({r.minx}) == 1 for r in got)
    assert sorted(m.id for r in got for m in r.members) == sorted(["low", *(f"s{k}" for k in range(11))])


def test_copies_are_overlaid_once(spark, monkeypatch):
    met = _seen(monkeypatch, ov, "spatial_join")
    a, b = _polygons(spark, [(f"a{k}", SQUARE, '{"x":"1"}') for k in range(20)]), _polygons(spark, [(f"b{k}", LOW, f'{{"k":"{k}"}}') for k in range(30)])
    got = ov.intersection(a, b, 4.0).withColumn("area", R.area("rings")).collect()
    assert met[0].count() == 1
    assert {(r.id, r.id_b, r.part_index) for r in got} == {(f"a{i}", f"b{k}", 0) for i in range(20) for k in range(30)} and {r.area for r in got} == {2.0} and len(got) == 600
    assert {r.properties for r in got if (r.id, r.id_b) == ("a7", "b3")} == {'{"x":"1","k":"3","_id_a":"a7","_id_b":"b3"}'}
    assert {tuple(r.value) for r in ov.intersections(a, b, 4.0, value=R.outline).collect()} == {(1, 4, 2.0)}


def test_lines_and_points_meet_copies_once(spark, monkeypatch):
    joins, points_in = _seen(monkeypatch, ln, "spatial_join"), _seen(monkeypatch, ln, "points_in")
    b = _polygons(spark, [(f"b{k}", SQUARE, '{"status":"F"}') for k in range(30)])
    lines = ln.with_line_box(spark.createDataFrame([(f"l{k}", [-1.0, 2.0, 2.0, 2.0, 2.0, 9.0], None) for k in range(20)], "id string, line array<double>, properties string"))
    got = ln.intersect_lines(lines, b, value=R.planar_length, keys=("_id_b", "status")).collect()
    assert joins[0].count() == 1 and {(r.id, r.id_b) for r in got} == {(f"l{i}", f"b{k}") for i in range(20) for k in range(30)}
    assert {r.lines for r in got} == {4.0} and all(tuple(r.properties) == (r.id_b, "F") for r in got)
    points = spark.createDataFrame([("in", 4.0, 1.0, None), ("out", 4.5, 1.0, None)], "id string, lon double, lat double, properties string")
    assert {(r.id, r.id_b) for r in ln.intersect_points(points, b).collect()} == {("in", f"b{k}") for k in range(30)}
    assert points_in[0].count() == 1


def test_points_meet_copies_once(spark, monkeypatch):
    met = _seen(monkeypatch, sp, "points_in")
    points = spark.createDataFrame([("in", 1.0, 1.0), ("edge", 3.0, -1.0), ("out", 4.5, 3.0), (None, None, 1.0)], "id string, lon double, lat double")
    b = _polygons(spark, [(f"s{k}", SQUARE, None) for k in range(40)] + [(f"l{k}", LOW, None) for k in range(5)])
    got = sorted((r.id, r.id_b) for r in sp.points_in_polygons(points, b).collect())
    assert got == sorted([*(("in", f"s{k}") for k in range(40)), *(("edge", f"l{k}") for k in range(5))])
    assert met[0].count() == 2


@pytest.mark.parametrize("first, second", [('{"a":"1","k":"mine","_id_a":"x"}', '{"k":"its","_id_b":"y"}'), (None, '{"k":null}'), ('{"k":null,"a":2}', None), ("no json", '{"k":"a,b"}'), ('{"é,":"\\"{"}', "{}")])
def test_properties_of_pairs(spark, first, second):
    a, b = _polygons(spark, [('"q,', SQUARE, first)]), _polygons(spark, [("b", LOW, second)])
    parsed = lambda t: json.loads(t) if t and t.startswith("{") else {}
    want = {k: v if v is None else str(v) for k, v in {**parsed(first), **parsed(second), "_id_a": '"q,', "_id_b": "b"}.items()}
    assert [json.loads(r.properties) for r in ov.intersection(a, b).collect()] == [want]
    values = ov.intersections(a, b, keys=("_id_a", "k", "a")).select("properties.*").collect()
    assert [tuple(r) for r in values] == [('"q,', want.get("k"), want.get("a"))]
