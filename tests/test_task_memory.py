"""What a task sorts or gathers is a shuffle partition, not a split of the input."""

from geomill.operators import tables as tb
from geomill.operators.paging import newest
from pyspark.sql import functions as F


def _before_shuffles(df) -> list[str]:
    """The steps of each branch of the plan below its last exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [part.split("Exchange")[0] for part in plan.replace("BroadcastExchange", "Exchange").split("Exchange")[1:]]


def test_newest_does_not_sort_splits(spark):
    df = spark.range(100).selectExpr("id % 10 as k", "id as v", "concat('x', id) as t")
    out = newest(df, ["k"], F.col("v").desc())
    below = _before_shuffles(out)
    assert sorted(map(tuple, out.collect())) == [(k, 90 + k, f"x{90 + k}") for k in range(10)]
    assert below and not any("Sort" in steps for steps in below)


def test_counts_of_collections_gather_ids_behind_a_shuffle(spark, tmp_path):
    rows = "concat('c', id % 2) as collection_id, if(id = 7, null, cast(id div 4 as string)) as id, cast(id % 4 div 2 as int) as part_index, id * 1.0D as minx, 0.0D as miny, id + 1.0D as maxx, 1.0D as maxy, '{}' as properties, timestamp_seconds(id) as updated_at"
    stage = spark.sql(f"select {rows} from range(400)")
    out = tb.bulk_append(stage.unionAll(stage), str(tmp_path / "t"))
    got = {r.collection_id: (r.feature_count, r.minx, r.maxx) for r in out.collect()}
    assert got == {"c0": (100, 0.0, 399.0), "c1": (100, 1.0, 400.0)}
    assert "count(distinct" not in out._jdf.queryExecution().optimizedPlan().toString()
