"""Polygon functions and overlays against sampled points and known measures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.functions import geometry as G
from geomill.operators import overlay as ov


def inside(rings, x, y):
    odd = False
    for r in rings:
        p = np.asarray(r).reshape(-1, 2)
        for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, 0), strict=True):
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                odd = not odd
    return odd


def star(rng, n):
    cx, cy = rng.random(), rng.random()
    at = [(rng.uniform(0.2, 1), 2 * math.pi * k / n) for k in range(n)]
    return [[v for r, t in at for v in (cx + r * math.cos(t), cy + r * math.sin(t))]]


RULES = {"and": all, "minus": lambda n: n[0] > 0 and n[1] == 0, "or": any}


@pytest.mark.parametrize("rule", RULES)
def test_overlay_against_points(rule):
    rng = random.Random(rule)
    for _ in range(25):
        a, b, c = star(rng, 9), star(rng, 7), [[rng.random() * 2 for _ in range(12)]]  # the last one crosses itself
        parts = ov.overlay([(0, a), (1, b), (1, c)], RULES[rule])
        for _ in range(120):
            x, y = rng.uniform(-1, 2), rng.uniform(-1, 2)
            n = [int(inside(a, x, y)), inside(b, x, y) + inside(c, x, y)]
            assert sum(inside([p], x, y) for p in parts) == int(RULES[rule](n))


def frame(spark, rows):
    return ov.with_box(spark.createDataFrame(rows, f"id string, rings {ov.RINGS}, properties string"))


SQUARE = [[0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0]]
HOLED = [*SQUARE, [1.0, 1.0, 2.0, 1.0, 2.0, 2.0, 1.0, 2.0, 1.0, 1.0]]


def area(df):
    return round(df.agg(F.sum(G.planar_area(F.col("rings")))).first()[0] or 0, 9)


def test_measures(spark):
    df = frame(spark, [("h", HOLED, "{}"), ("n", None, None), ("e", [], None)])
    rows = {r.id: r for r in df.select("id", G.planar_area(F.col("rings")).alias("a"), G.n_points(F.col("rings")).alias("n"), G.holds(F.col("rings"), F.lit(1.5), F.lit(1.5)).alias("hole"), G.holds(F.col("rings"), F.lit(4.0), F.lit(3.0)).alias("edge")).collect()}
    assert rows["h"].a == 15 and rows["h"].n == 9 and not rows["h"].hole and rows["h"].edge
    assert rows["n"].a == rows["e"].a == 0 and rows["n"].n == 0 and not rows["n"].edge
    length = spark.range(1).select(*(G.ellipsoid_length(*(F.lit(float(v)) for v in p)) for p in ((0, 0, 1, 0), (0, 0, 0, 1), (5, 5, 5, 5)))).first()
    assert abs(length[0] - 111319.491) < 1 and abs(length[1] - 110574.389) < 1 and length[2] == 0
    world = spark.range(1).select(G.ellipsoid_area(F.array(F.array(*(F.lit(float(v)) for v in (-180, -90, 180, -90, 180, 90, -180, 90)))), "km2")).first()[0]
    assert abs(world - 510065621.7) < 1


def test_features(spark):
    a = frame(spark, [("a", HOLED, '{"k":"1","s":"a"}'), ("far", [[50.0, 50.0, 51.0, 50.0, 51.0, 51.0]], None), ("null", None, None)])
    b = frame(spark, [("b", [[1.5, 1.5, 9.0, 1.5, 9.0, 9.0, 1.5, 9.0]], '{"k":"2"}'), ("b", [[1.5, 1.5, 9.0, 1.5, 9.0, 9.0, 1.5, 9.0]], '{"k":"2"}')])
    met = ov.intersection(a, b.dropDuplicates(["id"]), 4.0)
    assert area(met) == 6.0 and {r.properties for r in met.collect()} == {'{"s":"a","k":"2","_id_a":"a","_id_b":"b"}'}
    assert area(ov.erase(a, b, 4.0).where("id = 'a'")) == 9.0
    assert [r.cx for r in ov.erase(a, b, 4.0).where("id = 'far'").collect()] == [None]
    assert area(ov.erase(a, b.where("false"))) == 15.5
    assert area(ov.dissolve(a.union(b), None, 2.0)) == 15 + 56.25 - 6 + 0.5


def test_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(ov, "GROUP", 4)
    rows = [(str(k), [[k / 8, 0.0, k / 8 + 0.5, 0.0, k / 8 + 0.5, 1.0, k / 8, 1.0]], "{}") for k in range(30)]
    assert area(ov.dissolve(frame(spark, rows * 2), F.lit(None), 2.0)) == 29 / 8 + 0.5


def test_buffer_and_subdivide(spark):
    hook = [[0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 3.0, 4.0, 3.0, 1.0, 0.0, 1.0]]
    grown = area(ov.buffer(frame(spark, [("h", hook, "{}"), ("n", None, None)]), 0.25))
    exact = 7 + 16 * 0.25 + math.pi / 16 * 5 / 4 - 0.0625  # five outer corners, one inner one
    assert abs(grown - exact) < 1e-3
    ring = [[v for k in range(200) for v in (math.cos(k * math.pi / 100), math.sin(k * math.pi / 100))]]
    cut = ov.subdivide(frame(spark, [("c", ring, "{}")]), 20)
    assert abs(area(cut) - 100 * math.sin(math.pi / 100)) < 1e-9 and cut.agg(F.max(G.n_points(F.col("rings")))).first()[0] <= 20
    with pytest.raises(ValueError):
        ov.buffer(cut, 0)
