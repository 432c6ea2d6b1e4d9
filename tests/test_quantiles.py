"""Split quantiles against numpy and Spark's own percentile."""

import random

import numpy as np
from geomill.operators.quantiles import quantiles
from geomill.operators.spatial import zonal_statistics
from pyspark.sql import functions as F

SHARES = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.98, "e": 1.0}


def test_equal_numpy(spark):
    rng = random.Random(4)
    draws = {"even": lambda: rng.uniform(-1e6, 1e6), "few": lambda: float(rng.randrange(5)), "tiny": lambda: rng.gauss(0, 1e-9), None: lambda: rng.expovariate(1e-3)}
    rows = [(k, draw()) for k, draw in draws.items() for _ in range(rng.randrange(1, 700))] + [("one", 7.5), ("two", -1.0), ("two", 2.0), ("nothing", None)]
    counts = spark.createDataFrame(rows, "k string, value double").groupBy("k", "value").agg(F.count("*").alias("n"))
    found = {r.k: r for r in quantiles(counts, ["k"], SHARES).collect()}
    assert "nothing" not in found and len(found) == 6
    for k in found:
        values = [v for key, v in rows if key == k and v is not None]
        for name, share in SHARES.items():
            assert np.isclose(found[k][name], np.quantile(values, share), rtol=1e-9, atol=1e-15)


def test_repeated_counts_nan_and_empty(spark):
    rows = [(1, 2.0, 3), (1, 2.0, 4), (1, 5.0, 1), (1, 9.0, 0), (2, float("nan"), 1), (2, 1.0, 2)]
    counts = spark.createDataFrame(rows, "k int, value double, n long")
    found = {r.k: (r.low, r.mid, r.top) for r in quantiles(counts, ["k"], {"low": 0.0, "mid": 0.5, "top": 1.0}).collect()}
    assert found[1] == (2.0, 2.0, 5.0) and found[2][:2] == (1.0, 1.0) and np.isnan(found[2][2])
    assert quantiles(counts.limit(0), ["k"], {"mid": 0.5}).count() == 0


def test_zone_without_valid_pixels(spark):
    zones = spark.createDataFrame([("z", 0.0, 0.0, 2.0, 2.0)], "id string, minx double, miny double, maxx double, maxy double")
    pixels = spark.createDataFrame([(1, 1.0, 1.0, 5.0, True), (2, 1.0, 1.0, 4.0, False), (2, 1.5, 1.0, None, False)], "band int, lon double, lat double, value double, masked boolean")
    one, two = sorted(zonal_statistics(zones, pixels).collect(), key=lambda r: r.band)
    assert (one.valid_pixels, one.masked_pixels, one.mean, one["median"], one.std) == (0, 1, None, None, None)
    assert (two.valid_pixels, two.masked_pixels, two.valid_percent, two["median"], two.std) == (1, 0, 50.0, 4.0, 0.0)
