"""Lines and points against sampled places."""

import math
import random

from geomill.operators import lines as ln
from geomill.operators import overlay as ov
from geomill.functions import geometry as G
from pyspark.sql import functions as F

SQUARE = [[float(v) for v in r] for r in ([0, 0, 4, 0, 4, 4, 0, 4], [1, 1, 1, 3, 3, 3, 3, 1])]


def _length(lines):
    return sum(math.dist(line[k : k + 2], line[k + 2 : k + 4]) for line in lines for k in range(0, len(line) - 2, 2))


def test_cuts_by_hand():
    assert ln.cut_line([-1.0, 2, 5, 2], SQUARE) == [[0, 2, 1, 2], [3, 2, 4, 2]]
    assert ln.cut_line([-1.0, 2, 5, 2], SQUARE, True) == [[-1, 2, 0, 2], [1, 2, 3, 2], [4, 2, 5, 2]]
    assert ln.cut_line([0.5, 0.5, 3.5, 0.5, 3.5, 3.5], SQUARE) == [[0.5, 0.5, 3.5, 0.5, 3.5, 3.5]]  # around a corner in one
    assert ln.cut_line([0.0, 0, 4, 0], SQUARE) == [] == ln.cut_line([0.0, 0, 4, 0], SQUARE, True)  # along the border
    assert ln.cut_line([-1.0, 1, 1, -1], SQUARE) == [] and ln.cut_line([], SQUARE) == [] and ln.cut_line([1.0, 1.0], SQUARE) == []
    assert ln.cut_line([9.0, 9, 10, 10], SQUARE, True) == [[9, 9, 10, 10]] and ln.cut_line([0.0, 0, 1, 1], [], True) == [[0, 0, 1, 1]]


def test_lengths_equal_sampled_ones():
    draw = random.Random(1)
    for _ in range(30):
        rings = [[draw.uniform(-3, 3) for _ in range(draw.choice((6, 8, 12)))]]
        line = [draw.uniform(-4, 4) for _ in range(8)]
        n, hit, whole = 4000, 0.0, 0.0
        for k in range(0, 6, 2):
            a, b = line[k : k + 2], line[k + 2 : k + 4]
            long = math.dist(a, b)
            t = [(i + 0.5) / n for i in range(n)]
            inside = ln._inside(rings, ln.np.array([a[0] + (b[0] - a[0]) * x for x in t]), ln.np.array([a[1] + (b[1] - a[1]) * x for x in t]))
            hit, whole = hit + long * inside.mean(), whole + long
        assert abs(_length(ln.cut_line(line, rings)) - hit) < 0.03
        assert abs(_length(ln.cut_line(line, rings)) + _length(ln.cut_line(line, rings, True)) - whole) < 1e-9


def test_tables(spark):
    lines = ln.with_line_box(spark.createDataFrame([("l", [-1.0, 2.0, 5.0, 2.0], '{"a":"1","k":"mine"}'), ("far", [50.0, 50.0, 51.0, 50.0], None), ("in", [0.25, 0.25, 0.5, 0.25], None), ("none", None, None), ("dot", [1.0, 0.5], None)], "id string, line array<double>, properties string"))
    polys = ov.with_box(spark.createDataFrame([("p", SQUARE, '{"k":"its"}'), ("q", [[-1.0, 1.0, 0.0, 1.0, 0.0, 3.0, -1.0, 3.0]], None)], "id string, rings array<array<double>>, properties string"))
    got = {(r.id, r.id_b): (r.lines, r.properties) for r in ln.intersect_lines(lines, polys).collect()}
    assert {k: v[0] for k, v in got.items()} == {("l", "p"): [[0, 2, 1, 2], [3, 2, 4, 2]], ("l", "q"): [[-1, 2, 0, 2]], ("in", "p"): [[0.25, 0.25, 0.5, 0.25]]}
    assert '"k":"its"' in got["l", "p"][1] and '"_id_b":"p"' in got["l", "p"][1]
    left = {r.id: r.lines for r in ln.erase_lines(lines.where("id <> 'dot'"), polys).collect()}
    assert left == {"l": [[1, 2, 3, 2], [4, 2, 5, 2]], "far": [[50, 50, 51, 50]]}
    points = spark.createDataFrame([("1", 0.5, 0.5, None), ("2", 2.0, 2.0, None), ("3", 0.0, 2.0, None), ("4", None, 2.0, None)], "id string, lon double, lat double, properties string")
    assert sorted((r.id, r.id_b) for r in ln.intersect_points(points, polys).collect()) == [("1", "p"), ("3", "p"), ("3", "q")]


def test_buffers_of_lines(spark):
    rows = [("dot", [1.0, 2.0]), ("line", [0.0, 0.0, 3.0, 0.0]), ("twice", [0.0, 0.0, 0.0, 0.0, 3.0, 0.0]), ("corner", [0.0, 0.0, 3.0, 0.0, 3.0, 3.0]), ("loop", [0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0, 0.0, 0.0]), ("none", None)]
    out = {}
    for r in ln.buffer_lines(spark.createDataFrame(rows, "id string, line array<double>"), 0.5).select("id", F.size("rings").alias("n"), G.planar_area(F.col("rings")).alias("area")).collect():
        out.setdefault(r.id, []).append((r.n, r.area))
    disc = 0.25 * 32 * math.sin(2 * math.pi / 64)
    assert out.keys() == {"dot", "line", "twice", "corner", "loop"} and all(len(v) == 1 for v in out.values())
    assert abs(out["dot"][0][1] - disc) < 1e-9 and abs(out["line"][0][1] - (3 + disc)) < 1e-9 and out["twice"] == out["line"]
    assert abs(out["corner"][0][1] - (6 - 0.25 + disc * 5 / 4)) < 1e-6
    assert out["loop"][0][0] == 2 and abs(out["loop"][0][1] - (25 - (1 - disc) - 9)) < 1e-6  # a ring with a hole
