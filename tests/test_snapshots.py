"""Snapshot tables: swaps, died changes, conflicts, older versions and what is left over."""

import pytest
from geomill.operators import snapshots as sn
from pyspark.sql import functions as F

SCHEMA = "id string, collection_id string, job string, v double"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/features"


def _df(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_swaps_and_older_versions(spark, path):
    first = [("1", "7", None, 1.0), ("2", "7", "j", 2.0), ("3", "a/b=c", "j", 3.0), ("4", None, None, None)]
    assert sn.versions(spark, path) == [] and sn.append(_df(spark, *first), path) == 1
    assert _rows(sn.read(spark, path)) == sorted(first, key=str) and _rows(sn.read(spark, path, collection=None)) == first[3:]
    assert sn.append(_df(spark, ("5", "7", "k", 5.0)), path) == 2
    assert sn.rewrite(spark, path, "7", lambda d: d.where(~F.col("job").eqNullSafe("j"))) == 3  # rollback of a job
    assert [r[0] for r in _rows(sn.read(spark, path, collection="7"))] == ["1", "5"]
    assert sn.replace(_df(spark, ("9", "a/b=c", None, 9.0)), path) == 4
    assert sn.replace(_df(spark).where("false"), path) == 5  # no rows change nothing
    assert [r[0] for r in _rows(sn.read(spark, path))] == ["1", "4", "5", "9"]
    assert sn.rewrite(spark, path, "a/b=c", lambda d: d.where("false")) == 6 and sn.drop(spark, path, None) == 7
    assert [r[0] for r in _rows(sn.read(spark, path))] == ["1", "5"]
    assert _rows(sn.read(spark, path, version=1)) == sorted(first, key=str)
    assert sn.restore(spark, path, 1) == 8 and _rows(sn.read(spark, path)) == sorted(first, key=str)
    with pytest.raises(ValueError):
        sn.append(spark.range(1).selectExpr("cast(id as string) as id", "'7' as collection_id"), path)
    with pytest.raises(ValueError):
        sn.read(spark, path, version=99)


def test_a_died_change_leaves_the_table(spark, path, monkeypatch):
    sn.append(_df(spark, ("1", "a", None, 1.0)), path)
    with monkeypatch.context() as m:
        m.setattr(sn, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            sn.replace(_df(spark, ("2", "a", None, 2.0)), path)
    assert _rows(sn.read(spark, path)) == [("1", "a", None, 1.0)] and sn.versions(spark, path) == [1]
    assert sn.orphans(spark, path).count() == 0  # within the grace
    left = sn.orphans(spark, path, -1).collect()
    assert [r.kind for r in left] == ["data"] and left[0].path.startswith("data/")


def test_of_two_changes_the_second_fails(spark, path):
    sn.append(_df(spark, ("1", "a", None, 1.0)), path)

    def meanwhile(df):
        sn.append(_df(spark, ("2", "b", None, 2.0)), path)
        return df.where("false")

    with pytest.raises(sn.Conflict):
        sn.rewrite(spark, path, "a", meanwhile)
    assert [r[0] for r in _rows(sn.read(spark, path))] == ["1", "2"]
    assert {r.kind for r in sn.orphans(spark, path, -1).collect()} <= {"data"}


def test_expired_versions(spark, path):
    for k in range(4):
        sn.replace(_df(spark, (str(k), "a", None, float(k))), path)
    gone = sn.expire(spark, path, keep=2)
    assert sn.versions(spark, path) == [3, 4] and len(gone) == 2
    assert sorted(r.path for r in sn.orphans(spark, path, -1).collect()) == [f"data/{g}" for g in gone]
    assert [r[0] for r in _rows(sn.read(spark, path))] == ["3"]
