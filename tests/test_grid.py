"""Spatial joins over boxes of mixed sizes and crowded cells, against a plain loop."""

import random

import pytest
from geomill.operators import spatial as sp

SCHEMA = "id long, minx double, miny double, maxx double, maxy double"


def _boxes(seed, n, first=0):
    draw = random.Random(seed)
    out = []
    for i in range(first, first + n):
        w, h = (draw.choice((0.0, 0.01, 0.5, 1.0, 3.0, 40.0, 400.0)) * draw.random() for _ in range(2))
        x, y = draw.uniform(-180, 180), draw.uniform(-90, 90)
        if draw.random() < 0.3:
            x, y = float(round(x)), float(round(y))
        if draw.random() < 0.3:  # a crowded spot
            x, y, w, h = 10 + draw.random() / 4, 20 + draw.random() / 4, w / 50, h / 50
        out.append((i, x, y, x + w, y + h))
    return out


def _meets(p, q):
    return p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]


@pytest.mark.parametrize("dense", [50_000, 20])
def test_mixed_sizes(spark, monkeypatch, dense):
    monkeypatch.setattr(sp, "DENSE", dense)
    a, b = _boxes(1, 300), _boxes(2, 250, 1000)
    b += [(5000, -180.0, -90.0, 180.0, 90.0), (5001, float("-inf"), -5.0, float("inf"), 5.0), (5002, 3.0, 3.0, 2.0, 4.0), (5003, float("nan"), 0.0, 1.0, 1.0), (5004, None, 0.0, 1.0, 1.0)]
    met = sp.spatial_join(spark.createDataFrame(a, SCHEMA).repartition(3), spark.createDataFrame(b, SCHEMA).repartition(3)).select("id", "id_b")
    want = sorted((p[0], q[0]) for p in a for q in b if q[0] < 5002 and _meets(p, q))
    assert sorted(map(tuple, met.collect())) == want and len(want) > 1000


def test_points_and_those_outside(spark, monkeypatch):
    monkeypatch.setattr(sp, "DENSE", 30)
    draw = random.Random(4)
    points = [(i, 10 + draw.random() if i % 3 else draw.uniform(-180, 180), 20 + draw.random() if i % 3 else draw.uniform(-80, 80)) for i in range(400)] + [(999, None, 1.0), (999, 500.0, 1.0)]
    boxes = _boxes(6, 120)
    df, bx = spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(boxes, SCHEMA)
    inside = lambda p, q: p[1] is not None and q[1] <= p[1] <= q[3] and q[2] <= p[2] <= q[4]
    want = sorted((p[0], q[0]) for p in points for q in boxes if inside(p, q))
    assert sorted(map(tuple, sp.points_in(df, bx).select("id", "id_b").collect())) == want
    alone = sorted(p[0] for p in points if not any(inside(p, q) for q in boxes))
    kept = sp.points_in(df, bx, keep=True)
    assert sorted(r.id for r in kept.where("id_b is null").collect()) == alone and kept.count() == len(want) + len(alone)


def test_a_large_box_costs_few_rows(spark):
    box = tuple(sp.F.col(c) for c in sp.BOX)
    world = spark.createDataFrame([(1, -180.0, -90.0, 180.0, 90.0), (2, float("-inf"), 0.0, 1e300, 1.0)], SCHEMA)
    looks = sp.F.array(sp.F.struct(sp.F.lit(1).alias("turn"), sp.home_level(box, 0.001).alias("level")))
    assert sp._in_cells(world, box, 0.001, looks).count() <= 2 * 25


def test_a_crowded_cell_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sp, "DENSE", 100)
    cells = spark.range(5000).selectExpr("cast(id % 2 as int) as _side", "1 as _turn", "0 as _level", "id % 2 as _x", "0L as _y")
    crowded = sp._crowded(cells)
    assert crowded == {(1, 0, 0, 0): [25, 1], (1, 0, 1, 0): [1, 25]}
    parts = sp._dealt(cells.where("_side = 0").drop("_side"), crowded, 0).groupBy("_u", "_v").count().collect()
    assert len(parts) == 25 and max(r["count"] for r in parts) <= 110


def test_empty_sides(spark):
    some, none = spark.createDataFrame(_boxes(1, 20), SCHEMA), spark.createDataFrame([], SCHEMA)
    for a, b in ((some, none), (none, some), (none, none)):
        assert sp.spatial_join(a, b).count() == 0
