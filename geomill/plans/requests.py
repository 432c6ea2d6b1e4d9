"""Queries over request events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requests as rq
from ..sources import fixtures as fx
from ..sources.fixtures import with_views as wv
from ..sources.readers import shared_path
from ..streaming import metrics as st
from ..streaming import sketches as sk

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


FAMILIES = ", ".join(f"count(*) FILTER (status_code // 100 = {n}) AS s{n}xx" for n in (2, 3, 4, 5))


@query("a7_minute_metrics", wv(f"SELECT date_trunc('minute', created_at) AS minute, route_template, count(*) AS requests, CAST(round(avg(latency_ms)) AS INT) AS mean_ms, CAST(round_even(quantile_cont(latency_ms, 0.5), 0) AS INT) AS p50_ms, CAST(round_even(quantile_cont(latency_ms, 0.9), 0) AS INT) AS p90_ms, {FAMILIES} FROM request_events GROUP BY 1, 2", "request_events"))
def _(s, d):
    return rq.minute_metrics(fx.request_events(s, d))


@query("a8_top_endpoints", wv("SELECT route_template, count(*) AS requests FROM request_events WHERE created_at >= (SELECT max(created_at) FROM request_events) - INTERVAL 240 HOUR GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40", "request_events"))
def _(s, d):
    return rq.top_endpoints(fx.request_events(s, d), 240)


@query("r3_retention", wv("SELECT id FROM request_events WHERE created_at >= (SELECT max(created_at) FROM request_events) - INTERVAL 7 DAY", "request_events"))
def _(s, d):
    return rq.retention(fx.request_events(s, d), 7).select("id")


@query("r4_log_search", wv("SELECT id, latency_ms FROM request_events WHERE status_code // 100 = 4 AND method = 'GET' AND latency_ms >= 100 ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50", "request_events"))
def _(s, d):
    return rq.log_search(fx.request_events(s, d), family=4, method="get", min_latency=100, page=2).select("id", "latency_ms")


@query("r4_log_totals", wv("SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 50.0) AS BIGINT), 1) AS total_pages FROM request_events WHERE status_code // 100 = 4 AND method = 'GET' AND latency_ms >= 100", "request_events"))
def _(s, d):
    return rq.log_totals(fx.request_events(s, d), family=4, method="get", min_latency=100)


@query("r5_performance_series", wv("SELECT id, created_at, latency_ms FROM request_events WHERE route_template = (SELECT min(route_template) FROM request_events) ORDER BY created_at DESC, id DESC LIMIT 5000", "request_events"))
def _(s, d):
    e = fx.request_events(s, d)
    route = e.agg(F.min("route_template")).first()[0]
    return e.where(F.col("route_template") == route).orderBy(F.desc("created_at"), F.desc("id")).limit(5000).select("id", "created_at", "latency_ms")


@query("r2_event_shape", "SELECT event_id AS id, '10.0.0.' || (event_id % 250) AS ip, '[redacted]' AS cookie, event_type AS path, left(repeat('ab', CAST(event_id % 8000 AS INT)), 12000) AS body, event_id % 20 = 0 AS is_error FROM events")
def _(s, d):
    raw = fx.table(s, d, "events").selectExpr(
        "event_id as id", "concat(' 10.0.0.', event_id % 250, ', 172.16.0.1') as forwarded", "map('Cookie', 'secret', 'Accept', event_type) as headers",
        "event_type as path", "repeat('ab', cast(event_id % 8000 as int)) as body", "case event_id % 20 when 0 then 500 else 200 end as status_code",
    )
    return rq.shape_events(raw).select("id", "ip", F.col("headers")["Cookie"].alias("cookie"), "path", "body", "is_error")


@query("r1_minute_metrics_stream", wv(f"SELECT date_trunc('minute', created_at) AS minute, route_template, count(*) AS requests, CAST(round(avg(latency_ms)) AS INT) AS mean_ms, {FAMILIES} FROM request_events GROUP BY 1, 2", "request_events"))
def _(s, d):
    """The stream upserts the minutes of each batch; its exact columns equal the batch job's, percentiles are compared in a test."""
    events = fx.table(s, d, "events")
    stream = s.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*")
    path = shared_path(s, "minutes")
    st.upsert_minutes(st.minute_metrics_stream(fx.as_requests(stream)), f"{path}/table", f"{path}/checkpoint")
    return st.read_minutes(s, f"{path}/table").drop("p50_ms", "p90_ms").withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(
    "r1_sketch_days",
    wv(f"SELECT date_trunc('day', created_at)::TIMESTAMP AS day, route_template, count(*) AS requests, CAST(round(avg(latency_ms)) AS INT) AS mean_ms, {FAMILIES}, true AS p50_ok, true AS p90_ok FROM request_events GROUP BY 1, 2", "request_events"),
)
def _(s, d):
    """Days merged from the minute sketches of a stream; *_ok: the percentile's rank among the day's events is within the bound."""
    events = fx.table(s, d, "events")
    stream = fx.as_requests(s.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*"))
    path = shared_path(s, "sketches")
    sk.write_sketches(stream, f"{path}/table", f"{path}/checkpoint")
    days = sk.merged(sk.read_sketches(s, f"{path}/table"), F.date_trunc("day", "minute")).withColumnRenamed("minute", "day")
    own = fx.as_requests(events).select(F.date_trunc("day", "created_at").alias("day"), "route_template", "latency_ms")
    values = own.groupBy("day", "route_template", "latency_ms").agg(F.count("*").alias("n")).join(days, ["day", "route_template"])
    count = lambda c: F.sum(F.when(F.expr(c), F.col("n")).otherwise(0)) / F.sum("n")
    slack = sk.RANK_ERROR + 1 / F.sum("n")
    ok = lambda p, q: ((count(f"latency_ms < {p}") - slack <= q) & (count(f"latency_ms <= {p}") + slack >= q)).alias(f"{p[:3]}_ok")
    kept = [c for c in days.columns if c not in ("day", "route_template", "p50_ms", "p90_ms")]
    out = values.groupBy("day", "route_template", *kept).agg(ok("p50_ms", 0.5), ok("p90_ms", 0.9))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))
