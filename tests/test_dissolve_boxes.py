"""Boxes that a wider one covers are dropped before a union works on them."""

from pyspark.sql import functions as F

from geomill.functions import rings as R
from geomill.operators import overlay as ov


def ring(x1, y1, x2, y2):
    return [x1, y1, x2, y1, x2, y2, x1, y2, x1, y1]


def frame(spark, polygons):
    return ov.with_box(spark.createDataFrame(polygons, "id string, rings array<array<double>>"))


def area(parts):
    return {r.key: r.a for r in parts.groupBy("key").agg(F.round(F.sum(R.area("rings")), 9).alias("a")).collect()}


def test_only_the_widest_box_is_worked_on(spark, monkeypatch):
    rows, plain = [], ov._by_cell

    def seen(pieces, *rest):
        rows.append(pieces.count())
        return plain(pieces, *rest)

    monkeypatch.setattr(ov, "_by_cell", seen)
    df = frame(spark, [(k, [ring(1.0, 1.0, 1 + w / 8, 2.0)]) for k in "ab" for w in range(1, 9)] * 2)
    assert area(ov.dissolve(df, F.col("id"), 4.0)) == {"a": 1.0, "b": 1.0}
    assert sum(rows) == 2  # 16 before: every width of each key


def test_other_shapes_stay(spark):
    box, left, triangle = ring(0.0, 0.0, 1.0, 1.0), ring(0.0, 2.0, 2.0, 3.0), [0.0, 0.0, 3.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    hole = [ring(0.0, 5.0, 4.0, 9.0), ring(1.0, 6.0, 2.0, 7.0)]
    around = [4.0, 9.0, 0.0, 9.0, 0.0, 5.0, 4.0, 5.0, 4.0, 9.0]  # another start: not known as a box
    polygons = [("a", [box]), ("a", [left]), ("a", [triangle]), ("b", hole), ("b", [ring(0.0, 5.0, 0.5, 9.0)]), ("c", hole), ("c", [around]), ("d", None), ("e", [ring(-1.0, -1.0, -1.0, 4.0)])]
    found = area(ov.dissolve(frame(spark, polygons * 2), F.col("id"), 2.0))
    assert found == {"a": round(1 + 2 + 1.5 - 5 / 6, 9), "b": 15.0, "c": 16.0}
