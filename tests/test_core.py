"""Every registered query of the library proper against its SQL, and golden cases."""

import datetime as dt
import os

import duckdb
import pytest

from geomill import registry
from geomill.functions import scalar as S
from geomill.operators import filters as fl
from geomill.operators import spatial as sp
from geomill.operators import tables as tb
from geomill.operators import tiles as tl

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = sorted("|".join(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows == sorted("|".join(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())


def test_filter_text_is_read_leniently():
    assert fl.parse_filter("a:eq:b:c\n:eq:x\nz:between:1\nq:gte:3") == [("a", "eq", "b:c"), ("q", "gte", "3")]


def test_null_property_never_matches(spark):
    df = spark.createDataFrame([("1", '{"a":"x"}'), ("2", "{}"), ("3", None)], "id string, properties string")
    assert [r.id for r in fl.structured_filter(df, "a:ne:y").collect()] == ["1"]
    assert [r.id for r in fl.structured_filter(df, "a:like:x%").collect()] == ["1"]


def test_numbers_compare_as_numbers(spark):
    df = spark.createDataFrame([("1", '{"a":"10"}'), ("2", '{"a":"9"}'), ("3", '{"a":"n"}')], "id string, properties string")
    assert [r.id for r in fl.structured_filter(df, "a:gt:9.5").collect()] == ["1"]


def test_geojson_lines(spark, tmp_path):
    lines = [
        '{"type":"Feature","id":"p","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"name":"a"}}',
        "",
        "not json",
        '{"type":"Feature","geometry":null,"properties":{}}',
        '{"type":"Feature","id":"m","geometry":{"type":"MultiPoint","coordinates":[[1,2],[3,4]]},"properties":null}',
    ]
    (tmp_path / "in.geojsonl").write_text("\n".join(lines))
    good, bad = tb.read_geojsonl(spark, str(tmp_path / "in.geojsonl"), "c", "job")
    rows = sorted((r.id, r.part_index, r.minx, r.maxy) for r in good.collect())
    assert rows == [("m", 0, 1.0, 2.0), ("m", 1, 3.0, 4.0), ("p", 0, 1.0, 2.0)] and bad.count() == 2
    tb.write_geojsonl(good, str(tmp_path / "out"))
    again, none = tb.read_geojsonl(spark, str(tmp_path / "out"), "c")
    assert again.count() == 3 and none.count() == 0


def test_replace_with_nothing_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("c", "1", 0, "{}")], "collection_id string, id string, part_index int, properties string")
    path = str(tmp_path / "features")
    tb.write_features(df, path)
    tb.write_features(df.where("false"), path, "replace")
    assert spark.read.parquet(path).count() == 1
    tb.write_features(df.withColumn("id", df.id + 1), path, "replace")
    assert spark.read.parquet(path).count() == 1


def test_pairs_over_many_cells_come_once(spark):
    schema = "collection_id string, id string, minx double, miny double, maxx double, maxy double"
    big = spark.createDataFrame([("c", "1", 0.0, 0.0, 9.0, 9.0), ("c", "2", None, None, None, None)], schema)
    assert sp.spatial_join(big, big).count() == 1
    apart = spark.createDataFrame([("c", "3", 9.0, 0.0, 10.0, 1.0), ("c", "4", 9.5, 0.0, 10.0, 1.0)], schema)
    assert [r.id_b for r in sp.spatial_join(big, apart).collect()] == ["3"]  # touching counts


def test_season_slices():
    assert len(S.season_slices(dt.date(2023, 1, 1), dt.date(2023, 12, 31))) == 12
    assert S.season_slices(dt.date(2023, 6, 30), dt.date(2023, 6, 1)) == [(dt.date(2023, 6, 1), dt.date(2023, 6, 30))]
    assert S.season_slices(dt.date(2023, 1, 1), dt.date(2024, 12, 31), ["winter"])[:2] == [(dt.date(2023, 12, 1), dt.date(2023, 12, 31)), (dt.date(2024, 1, 1), dt.date(2024, 2, 28))]
    assert S.season_slices(dt.date(2023, 1, 1), dt.date(2023, 2, 1), ["winter"]) == [(dt.date(2023, 1, 1), dt.date(2023, 2, 1))]


def test_exported_id_moves(spark):
    df = spark.createDataFrame([("1", "c", '{"id":"a"}'), ("2", "c", '{"id":"b","id_source":"z"}'), ("3", "c", None)], "id string, collection_id string, properties string")
    rows = {r.id: (r.number, r.properties) for r in tl.export_rows(df).collect()}
    assert rows == {"1": (1, '{"id_source":"a"}'), "2": (2, '{"id_source_1":"b","id_source":"z"}'), "3": (3, None)}
