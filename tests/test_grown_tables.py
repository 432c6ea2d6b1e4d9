"""What fails only on larger tables, made small."""

from geomill.operators import mosaics as mo
from geomill.operators import spatial as sp

BOXES = "collection_id string, id string, minx double, miny double, maxx double, maxy double"


def test_many_boxes_meet_an_empty_side(spark, monkeypatch):
    monkeypatch.setattr(sp, "DENSE", 3)
    rows = [("c", str(k), float(k), 0.0, k + 1.0, 1.0) for k in range(8)]
    many, none = spark.createDataFrame(rows, BOXES), spark.createDataFrame([], BOXES)
    assert sp.spatial_join(many, none).count() == 0 == sp.spatial_join(none, many).count()
    assert sp.spatial_join(many, many).count() == 22


def test_swaps_are_joined_on_tile_and_box(spark, monkeypatch):
    monkeypatch.setattr(sp, "DENSE", 3)
    scene = "mgrs string, id string, minx double, miny double, maxx double, maxy double, cloud double"
    rows = [("T1", f"a{k}", float(k), 0.0, k + 1.5, 1.0, 1.0 * k) for k in range(6)] + [("T2", "b", 0.0, 0.0, 9.0, 9.0, 0.5)]
    scenes = spark.createDataFrame(rows, scene)
    got = {(r.id_s, r.id) for r in mo.swap_options(scenes.where("cloud >= 3"), scenes).collect()}
    assert got == {("a3", "a2"), ("a3", "a4"), ("a4", "a3"), ("a4", "a5"), ("a5", "a4")}
    untiled = scenes.unionByName(spark.createDataFrame([(None, "u", 3.2, 0.0, 3.3, 1.0, 9.0)], scene))
    got = {(r.id_s, r.id) for r in mo.swap_options(untiled.where("id in ('a3', 'u')"), untiled).collect()}
    assert got == {("a3", "a2"), ("a3", "a4"), ("a3", "u"), ("u", "a2"), ("u", "a3"), ("u", "b")}
