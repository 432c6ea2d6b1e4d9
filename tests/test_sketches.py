"""Minutes of a stream as mergeable sketches, and the last minutes computed anew."""

import datetime as dt
import random

from pyspark.sql import functions as F

from geomill.operators import requests as rq
from geomill.streaming import sketches as sk

SHAPE = "created_at timestamp, route_template string, latency_ms int, status_code int"


def test_batches_merge_to_what_all_events_give(spark, tmp_path):
    rng = random.Random(3)
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(seconds=rng.randrange(240)), "/busy", int(rng.expovariate(0.01)), rng.choice((200, 200, 301, 404, 500))) for _ in range(9000)]
    rows += [(at, "/few", k, 200) for k in (5, 1, 9)] + [(at, "/untimed", None, 200), (at + dt.timedelta(days=-9), "/few", 4, 404)]
    rng.shuffle(rows)
    for k in range(3):  # the same minutes come again, and one that is very late
        spark.createDataFrame(rows[k::3], SHAPE).write.mode("append").parquet(f"{tmp_path}/in")
        sk.write_sketches(spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    found = sk.read_sketches(spark, f"{tmp_path}/out")
    got = {(r.minute, r.route_template): r for r in sk.merged(found).collect()}
    want = {(r.minute, r.route_template): r for r in rq.minute_metrics(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert (g.requests, g.mean_ms, g.s2xx, g.s3xx, g.s4xx, g.s5xx) == (w.requests, w.mean_ms, w.s2xx, w.s3xx, w.s4xx, w.s5xx)
        own = sorted(r[2] for r in rows if r[2] is not None and r[1] == key[1] and r[0].replace(second=0) == key[0])
        for q, p in ((0.5, g.p50_ms), (0.9, g.p90_ms)):
            if not own:
                assert p is None
                continue
            low, high = sum(x < p for x in own) / len(own), sum(x <= p for x in own) / len(own)
            assert low - sk.RANK_ERROR - 1 / len(own) <= q <= high + sk.RANK_ERROR + 1 / len(own)
    whole = sk.merged(found.where("route_template = '/busy'"), F.date_trunc("day", "minute")).collect()
    assert [r.requests for r in whole] == [9000]
    assert sk.merged(found.limit(0)).collect() == []


def test_the_last_minutes_are_computed_anew(spark):
    at = dt.datetime(2024, 1, 1, 12, 0, 30)
    events = spark.createDataFrame([(at - dt.timedelta(minutes=m), "/a", 10 * m, 200) for m in (0, 1, 100, 180, 181, 500)], SHAPE)
    old = rq.minute_metrics(events).withColumn("requests", F.lit(99).cast("long"))
    gone = old.limit(1).withColumn("minute", F.lit(at - dt.timedelta(minutes=50))).withColumn("route_template", F.lit("/gone"))
    got = {(r.route_template, r.minute): r.requests for r in sk.recompute(old.unionByName(gone), events, F.lit(at)).collect()}
    minute = lambda m: ("/a", at.replace(second=0) - dt.timedelta(minutes=m))
    assert got == {minute(0): 1, minute(1): 1, minute(100): 1, minute(180): 1, minute(181): 99, minute(500): 99}
