"""Outlines of regions against flood fills of grids of squares."""

import random

import pytest
from geomill.functions import geometry as G
from geomill.operators import outlines as ol
from geomill.operators import overlay as ov
from pyspark.sql import functions as F


def _grid(seed, n, share):
    draw = random.Random(seed)
    return {(x, y) for x in range(-n, n) for y in range(-n, n) if draw.random() < share}


def _components(cells):
    left, n = set(cells), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            x, y = todo.pop()
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
    return n


def _corners(cells):
    """Corners of all rings: one where one or three of the four squares at a point are there, two where two opposite ones are."""
    out = 0
    for x, y in {(x + i, y + j) for x, y in cells for i in (0, 1) for j in (0, 1)}:
        here = [(x - 1, y - 1) in cells, (x, y - 1) in cells, (x, y) in cells, (x - 1, y) in cells]
        out += {1: 1, 3: 1, 2: 2 if here[0] == here[2] else 0}.get(sum(here), 0)
    return out


def _square(x, y, unit=0.125):
    return [x * unit, y * unit, (x + 1) * unit, y * unit, (x + 1) * unit, (y + 1) * unit, x * unit, (y + 1) * unit]


def _check(polys, cells, unit=0.125):
    area = lambda r: sum(r[k] * r[k + 3] - r[k + 2] * r[k + 1] for k in range(0, len(r) - 2, 2)) / 2
    assert len(polys) == _components(cells)
    assert sum(len(r) // 2 - 1 for p in polys for r in p) == _corners(cells)
    assert abs(sum(area(r) for p in polys for r in p) - len(cells) * unit * unit) < 1e-9
    for shell, *holes in polys:
        assert area(shell) > 0 and all(area(h) < 0 for h in holes) and shell[:2] == shell[-2:]
        assert sum(map(area, (shell, *holes))) > 0 and len(set(zip(shell[:-2:2], shell[1:-2:2], strict=True))) == len(shell) // 2 - 1


@pytest.mark.parametrize("share", [0.1, 0.5, 0.7, 0.9])
def test_parts_of_one_row(share):
    for seed in range(6):
        cells = _grid(seed, 9, share)
        _check(ol.assemble(ov.overlay([(0, [_square(*c)]) for c in cells], lambda n: n[0] > 0)), cells)


@pytest.mark.parametrize("size", [0.5, 1.0, 0.375])
def test_across_cells(spark, size):
    """Regions over many cells, around the origin, two keys at once, one of them null."""
    grids = {"a": _grid(1, 20, 0.6), None: _grid(2, 16, 0.85)}
    rows = [(k, [_square(*c)]) for k, cells in grids.items() for c in cells]
    df = ov.with_box(spark.createDataFrame(rows, "key string, rings array<array<double>>"))
    parts = ov.dissolve(df.withColumn("key", F.coalesce("key", F.lit("null"))), F.col("key"), size).withColumn("key", F.nullif("key", F.lit("null")))
    found = ol.polygons(parts, ["key"], size).collect()
    for k, cells in grids.items():
        _check([r.rings for r in found if r.key == k], cells)


def test_long_ring_and_nested_rings(spark):
    """A frame of some hundred cells' width, with an island in its hole that has a hole of its own."""
    frame = lambda r, w: [[-r, -r, r, -r, r, r, -r, r], [-r + w, -r + w, -r + w, r - w, r - w, r - w, r - w, -r + w]]
    df = ov.with_box(spark.createDataFrame([(1, frame(40.5, 2.25)), (1, frame(10.0, 1.5)), (1, [[100.0, 0.0, 101.0, 0.0, 100.5, 1.0]])], "id int, rings array<array<double>>"))
    found = ol.polygons(ov.dissolve(df, F.col("id"), 1.0), ["key"], 1.0)
    out = sorted((len(r.rings), round(r.area, 9)) for r in found.select("rings", G.planar_area(F.col("rings")).alias("area")).collect())
    assert out == [(1, 0.5), (2, 20.0**2 - 17.0**2), (2, 81.0**2 - 76.5**2)]
    many = ol.multipolygons(found, ["key"]).collect()
    assert len(many) == 1 and len(many[0].polygons) == 3


def test_sloped_edges_and_overlaps(spark):
    """Random triangles: the outline has the area of the parts, and holds the points that some triangle holds."""
    draw = random.Random(3)
    rows = [(k % 2, [[draw.uniform(-3, 3) for _ in range(6)]]) for k in range(24)]
    df = ov.with_box(spark.createDataFrame(rows, "id int, rings array<array<double>>"))
    parts = ov.dissolve(df, F.col("id"), 1.0)
    before = {r.key: r.a for r in parts.groupBy("key").agg(F.sum(G.planar_area(F.col("rings"))).alias("a")).collect()}
    found = ol.polygons(parts, ["key"], 1.0)
    after = {r.key: r.a for r in found.groupBy("key").agg(F.sum(G.planar_area(F.col("rings"))).alias("a")).collect()}
    assert before.keys() == after.keys() and all(abs(before[k] - after[k]) < 1e-6 for k in before)
    local = ol.assemble(ov.overlay([(0, r) for k, r in rows if k == 0], lambda n: n[0] > 0))
    mine = [r.rings for r in found.where("key = '0'").collect()]
    assert len(local) == len(mine) and sum(map(len, local)) == sum(map(len, mine))


def test_empty(spark):
    none = spark.createDataFrame([], "key string, cx int, cy int, rings array<array<double>>")
    assert ol.polygons(none, ["key"], 1.0).count() == 0 and ol.assemble([]) == []
