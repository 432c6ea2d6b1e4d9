"""Lists of collections and storage by owner: nulls, ties, empty tables."""

from geomill.operators import catalog as cg

SHAPE = "id string, title string, description string, collection_type string, minx double, miny double, maxx double, maxy double"
ROWS = [("a", "Roads", None, "vector", 0.0, 0.0, 1.0, 1.0), ("b", None, "100% of ROADS", "vector", None, None, None, None), ("c", "Fields", "x", "raster", 1.0, 1.0, 2.0, 2.0)]


def test_collections_by_text_box_type_and_tiles(spark):
    df = spark.createDataFrame(ROWS, SHAPE)
    ids = lambda **o: [r.id for r in cg.collections_list(df, **o).collect()]
    assert ids() == ["a", "b", "c"] and ids(sortby="nothing", descending=True) == ["c", "b", "a"]
    assert ids(q=" roads ") == ["a", "b"] and ids(q="0%") == ["b"] and ids(q="_") == [] and ids(q="  ") == ["a", "b", "c"]
    assert ids(box=(1.0, 1.0, 5.0, 5.0)) == ["a", "c"] and ids(kind="raster") == ["c"]
    assert ids(sortby="title") == ["c", "a", "b"] and ids(sortby="description", descending=True, limit=2) == ["a", "c"] and ids(offset=2, limit=5) == ["c"]
    assert ids(tiled=spark.createDataFrame([("b",), ("b",), (None,)], "id string")) == ["b"]


def test_usage_of_orphans_nulls_and_nothing(spark):
    files = spark.createDataFrame([("c1", "db", 1024), ("c1", "log", 1), ("c1", None, None), ("x", "tiles", 5000), (None, "raster", 7)], "owner string, kind string, length long")
    owners = spark.createDataFrame([("c1", "collection"), ("unused", "mosaic")], "owner string, kind string")
    rows = [(r.owner, r.owner_kind, r.db_bytes, r.tiles_bytes, r.raster_bytes, r.other_bytes, r.total_bytes, r.total_size) for r in cg.usage_by_owner(files, owners).collect()]
    assert rows == [
        ("x", "orphan", 0, 5000, 0, 0, 5000, "4.88 KB"), ("c1", "collection", 1024, 0, 0, 1, 1025, "1.00 KB"),
        (None, "orphan", 0, 0, 7, 0, 7, "7 B"), (None, "total", 1024, 5000, 7, 1, 6032, "5.89 KB"),
    ]
    assert [(r.owner_kind, r.total_bytes) for r in cg.usage_by_owner(files.where("false"), owners).collect()] == [("total", 0)]
