"""Percentiles of minutes to the last bit, as SQL has them."""

import datetime as dt
import random
from fractions import Fraction

import duckdb
import pyarrow as pa
from geomill.functions.scalar import fused
from geomill.operators import requests as rq
from pyspark.sql import functions as F


def test_sums_of_products_are_rounded_once(spark):
    draw = random.Random(3)
    rows = [(float(draw.randrange(-10_000, 10_000)), draw.random(), draw.uniform(-9e3, 9e3)) for _ in range(2000)] + [(2.0, 1 - 0.9, 47 * 0.9), (0.0, 0.5, 0.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double").withColumn("d", fused(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r.d for r in got] == [float(Fraction(r.a) * Fraction(r.b) + Fraction(r.c)) for r in got]


def test_halves_are_rounded_as_in_sql(spark):
    """2 and 47 have a ninth tenth just above 42.5, which is 43."""
    draw, rows = random.Random(5), [("two", 2), ("two", 47), ("none", None), ("some", None), ("some", 7)]
    for k in range(3000):
        rows += [(f"r{k}", draw.randrange(60)) for _ in range(draw.choice((2, 4, 6, 7, 9, 12, 22)))]
    at = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(at, route, ms, 200) for route, ms in rows], "created_at timestamp, route_template string, latency_ms int, status_code int")
    got = {r.route_template: (r.requests, r.mean_ms, r.p50_ms, r.p90_ms) for r in rq.minute_metrics(events).collect()}
    sql = "SELECT k, count(*), CAST(round(avg(ms)) AS INT), CAST(round_even(quantile_cont(ms, 0.5), 0) AS INT), CAST(round_even(quantile_cont(ms, 0.9), 0) AS INT) FROM metrics GROUP BY 1"
    con = duckdb.connect()
    con.register("metrics", pa.table({"k": [r[0] for r in rows], "ms": pa.array([r[1] for r in rows], pa.int32())}))
    assert got == {r[0]: tuple(r[1:]) for r in con.execute(sql).fetchall()}
    assert got["two"][3] == 43 and got["none"] == (1, None, None, None) and got["some"][1:] == (7, 7, 7)
