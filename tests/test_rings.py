"""Measures by arrays against those edge by edge."""

import math
import random

from geomill.functions import geometry as G
from geomill.functions import rings as R
from pyspark.sql import functions as F


def _shapes(n: int) -> list:
    draw = random.Random(7)
    ring = lambda: [v for _ in range(draw.randrange(0, 9)) for v in (draw.randrange(-40, 40) / 8, draw.randrange(-40, 40) / 8)]
    shapes = [[ring() for _ in range(draw.randrange(0, 4))] for _ in range(n)]
    return [*shapes, None, [], [None, [0.0, 0.0, 4.0, 0.0, 4.0, 4.0]], [[1.0]], [[0.0, 0.0, 4.0, 0.0, 4.0]], [[0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0], None, [1.0, 1.0, 2.0, 1.0, 2.0, 2.0]], [[]], [[0.0, 0.0, None, 0.0, 4.0, 4.0]]]


def test_areas_and_points_as_edge_by_edge(spark):
    rows = [(k, s, (k % 80 - 40) / 8, (k * 7 % 80 - 40) / 8) for k, s in enumerate(_shapes(3000))]
    df = spark.createDataFrame(rows, "k int, rings array<array<double>>, x double, y double").repartition(3)
    both = df.select("k", G.planar_area(F.col("rings")), R.area("rings"), G.holds(F.col("rings"), F.col("x"), F.col("y")), R.holds("rings", "x", "y")).collect()
    assert len(both) == 3008 and all(r[1] == r[2] and r[3] == r[4] for r in both if r.k < 3007)
    assert 50 < sum(r[4] for r in both) < 1500 and sum(r[2] > 0 for r in both) > 1000
    assert df.select(R.holds("rings", F.lit(None), "y").alias("h")).where("h").count() == 0


def test_lengths_as_edge_by_edge(spark):
    draw = random.Random(8)
    ends = [[draw.uniform(-180, 180), draw.uniform(-90, 90), draw.uniform(-180, 180), draw.uniform(-90, 90)] for _ in range(2000)]
    ends += [[0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 179.9, 0.1], [10.0, 0.0, 10.0, 90.0], [179.5, 10.0, -179.5, 10.0], [0.0, 0.0, 5.0, 0.0], [0.0, 0.0, 180.0, 0.0]]
    df = spark.createDataFrame([(e,) for e in ends], "line array<double>")
    out = df.select(G.geodesic_length(*(F.get("line", k) for k in range(4))), R.line_length("line"), R.perimeter(F.array("line")), R.rings_length(F.array("line", "line"))).collect()
    for one, line, around, rings in out:
        assert abs(one - line) <= 1e-9 * max(1.0, one) and math.isclose(around, 2 * line, rel_tol=1e-9) and math.isclose(rings, 2 * around)
    few = spark.createDataFrame([(None,), ([],), ([1.0, 2.0],), ([0.0, 0.0, 1.0, 0.0, 1.0, 1.0],), ([None, 0.0, 1.0, 0.0, 1.0, 1.0],)], "line array<double>")
    none, empty, point, whole, cut = (r[0] for r in few.select(R.line_length("line", "km")).collect())
    assert (none, empty, point) == (0, 0, 0) and abs(whole - 111.319490793 - 110.574388558) < 1e-6 and abs(cut - 110.574388558) < 1e-6
