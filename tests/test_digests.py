"""Versions of mosaics against plain digests."""

import random
from hashlib import sha256

import pytest
from geomill.operators import digests as dg
from pyspark.sql import functions as F


@pytest.mark.parametrize("chunk", [256, 3])
def test_versions(spark, monkeypatch, chunk):
    monkeypatch.setattr(dg, "CHUNK", chunk)
    draw = random.Random(4)
    ids = {"big": [f"f{draw.randrange(10**6)}" for _ in range(900)], "one": ["x"], "odd": ["ä", "a,b", "", "Z", "\U0001f642"]}
    rows = [(c, i, k) for c, values in ids.items() for i in values for k in range(1 + draw.randrange(2))] + [(None, "x", 0), ("none", None, 0)]
    df = spark.createDataFrame(rows, "collection_id string, id string, part_index int").repartition(5)
    want = {c: sha256(f"{c}:{','.join(sorted(set(v), key=lambda x: x.encode()))}".encode()).hexdigest() for c, v in ids.items()}
    assert {r.collection_id: r.version for r in dg.mosaic_versions(df).collect()} == want
    assert dg.mosaic_versions(df.limit(0)).count() == 0


def test_matches(spark):
    v = "0123456789abcdef" * 4
    rows = [(v, True), (v[:16], True), (v[:15], False), (v[:17], False), ("", False), (None, False), (v[1:17], False)]
    df = spark.createDataFrame(rows, "given string, want boolean").withColumn("v", F.lit(v))
    assert all(r.m == r.want for r in df.select("want", dg.version_matches(F.col("given"), F.col("v")).alias("m")).collect())
