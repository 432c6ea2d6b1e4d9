"""Kernels that work on many rows together: the same parts as one row alone, fast enough for millions."""

import random
import time

import numpy as np
import pyarrow as pa

from geomill.operators import lines as ln
from geomill.operators import overlay as ov

POLYGONS = pa.list_(pa.list_(pa.float64()))


def _shapes(n, seed):
    r = random.Random(seed)
    c = lambda: r.randint(0, 16) / 8
    return [[[c() for _ in range(2 * r.randint(3, 6))] for _ in range(r.randint(1, 2))] if r.random() > 0.05 else None for _ in range(n)]


def test_rows_together_have_the_parts_of_each_alone():
    a, b = _shapes(400, 1), _shapes(400, 2)
    at, parts = ov._overlaid([pa.array(a, POLYGONS), pa.array(b, POLYGONS)], all, ov.apart)
    alone = [(k, p) for k, (x, y) in enumerate(zip(a, b, strict=True)) for p in ov.overlay([(0, x), (1, y)], all)]
    assert [(k, p[0]) for k, p in zip(at.tolist(), parts.to_pylist(), strict=True)] == alone


def test_twenty_thousand_pairs_take_seconds():  # 22 s and more, one by one
    a, b = pa.array(_shapes(20_000, 3), POLYGONS), pa.array(_shapes(20_000, 4), POLYGONS)
    began = time.process_time()
    for k in range(0, len(a), ov.ROWS):
        ov._overlaid([a.slice(k, ov.ROWS), b.slice(k, ov.ROWS)], all, ov.apart)
    assert time.process_time() - began < 8


def test_halves_stand_in_the_place_of_their_whole(spark):
    circle = [float(v) for k in range(64) for v in (np.cos(k * np.pi / 32), np.sin(k * np.pi / 32))]
    df = spark.createDataFrame([(1, [circle]), (2, None), (3, [[0.0, 0.0, 1.0, 0.0, 1.0, 1.0]]), (4, [circle, circle])], "id int, rings array<array<double>>")
    rows = ov.subdivide(df, 24).collect()
    area = lambda p: float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum() / 2)
    total = {k: sum(area(np.reshape(p, (-1, 2))) for r in rows if r.id == k for p in r.rings) for k in (1, 3, 4)}
    whole = 32 * np.sin(np.pi / 32)
    assert abs(total[1] - whole) < 1e-9 and abs(total[3] - 0.5) < 1e-12 and abs(total[4] - 2 * whole) < 1e-9
    assert [r.part_index for r in rows if r.id == 1] == list(range(4)) and all(sum(len(x) // 2 for x in r.rings) <= 24 for r in rows)
    west = [min(p[0] for p in np.reshape(r.rings[0], (-1, 2)).tolist()) for r in rows if r.id == 1]
    assert west == sorted(west)


def test_groups_go_on_across_batches(spark):
    boxes = [(k % 3, None if k % 5 == 0 else "n", float(k), 0.0, k + 1.5, 1.0) for k in range(40)]
    df = spark.createDataFrame(boxes, "a int, key string, minx double, miny double, maxx double, maxy double")
    from geomill.functions import geometry as G

    df = df.withColumn("rings", G.box_rings("minx", "miny", "maxx", "maxy"))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = ov.dissolve(df, None, 16.0).groupBy("key").agg({"rings": "collect_list"}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    area = sum((p[0][2] - p[0][0]) * (p[0][5] - p[0][1]) for p in rows[0][1])
    assert len(rows) == 1 and abs(area - 40.5) < 1e-9


def test_lines_cut_together_are_those_cut_alone():
    r = random.Random(7)
    c = lambda: r.randint(0, 16) / 8
    lines, polygons = [[c() for _ in range(2 * r.randint(0, 6))] for _ in range(5000)], _shapes(5000, 8)
    for outside in (False, True):
        began = time.process_time()
        of, sizes, points = ln.cut_lines(ov.Rings.of_lists([[x] for x in lines]), ov.Rings.of_lists(polygons), len(lines), outside)
        assert time.process_time() - began < 1  # 2.6 s and more, one by one
        together = list(zip(of.tolist(), ov.Rings(points, sizes, of).lists(), strict=True))
        assert together == [(k, p) for k, (x, y) in enumerate(zip(lines, polygons, strict=True)) for p in ln.cut_line(x, y, outside)]
