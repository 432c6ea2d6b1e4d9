"""Request logs: minute metrics, top endpoints, searches, retention, shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fused

HIDDEN_HEADERS = ("authorization", "cookie", "set-cookie", "x-api-key", "proxy-authorization")


def minute_metrics(events: DataFrame) -> DataFrame:
    """Per minute and route: count, latencies (mean rounds half up, percentiles half to even) and status classes.

    Requests are counted by latency first, so the rows of a minute and route are its different latencies. A percentile between two
    of them is low * (1 - part) + high * part with one rounding of the sum, as SQL has it: half a millisecond more or less is rounded apart.
    """
    ms, n, families = F.col("latency_ms"), F.col("n"), (2, 3, 4, 5)
    family = lambda k: F.count_if(F.floor(F.col("status_code") / 100) == k).alias(f"s{k}xx")
    counts = events.groupBy(F.date_trunc("minute", "created_at").alias("minute"), "route_template", "latency_ms").agg(F.count("*").alias("n"), *(family(k) for k in families))
    whole = Window.partitionBy("minute", "route_template")
    timed = F.when(ms.isNotNull(), n)
    counts = counts.withColumns({"end": F.sum(timed).over(whole.orderBy(F.asc_nulls_last("latency_ms"))), "timed": F.sum(timed).over(whole)})
    place = lambda share: F.lit(share) * (F.col("timed") - 1)
    at = lambda rank: F.min(F.when(F.col("end") > rank, ms)).cast("double")
    shares = {"p50_ms": 0.5, "p90_ms": 0.9}
    ends = [at(rank(place(share))).alias(f"{side} {name}") for name, share in shares.items() for side, rank in (("low", F.floor), ("high", F.ceil))]
    sums = counts.groupBy("minute", "route_template").agg(
        F.sum("n").alias("requests"), F.round(F.sum(ms * n) / F.max("timed")).cast("int").alias("mean_ms"), F.max("timed").alias("timed"), *ends, *(F.sum(f"s{k}xx").alias(f"s{k}xx") for k in families)
    )

    def between(name: str) -> Column:
        low, high, part = F.col(f"`low {name}`"), F.col(f"`high {name}`"), place(shares[name]) - F.floor(place(shares[name]))
        return F.rint(F.when(low == high, low).otherwise(fused(low, 1 - part, high * part))).cast("int").alias(name)

    return sums.select("minute", "route_template", "requests", "mean_ms", *(between(name) for name in shares), *(f"s{k}xx" for k in families))


def top_endpoints(events: DataFrame, hours: int, limit: int = 40) -> DataFrame:
    last = events.agg(F.max("created_at")).first()[0]
    recent = events.where(F.col("created_at") >= F.lit(last) - F.make_interval(hours=F.lit(hours)))
    return recent.groupBy("route_template").agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "route_template").limit(limit)


def log_filter(events: DataFrame, family: int | None = None, method: str | None = None, path: str | None = None, min_latency: int | None = None) -> DataFrame:
    """Events by status family, method, part of the route and least latency."""
    if family is not None:
        events = events.where(F.floor(F.col("status_code") / 100) == family)
    if method:
        events = events.where(F.col("method") == method.upper())
    if path:
        events = events.where(F.contains(F.lower("route_template"), F.lit(path.lower())))
    if min_latency is not None:
        events = events.where(F.col("latency_ms") >= min_latency)
    return events


def log_search(events: DataFrame, page: int = 1, size: int = 50, **filters) -> DataFrame:
    """A page of matching events (see log_filter), newest first."""
    return log_filter(events, **filters).orderBy(F.desc("created_at"), F.desc("id")).offset((max(page, 1) - 1) * size).limit(size)


def log_totals(events: DataFrame, size: int = 50, **filters) -> DataFrame:
    """(total, total_pages) of the events that log_search pages through; without any there is one page."""
    total = log_filter(events, **filters).agg(F.count("*").alias("total"))
    return total.withColumn("total_pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)))


def retention(events: DataFrame, days: int) -> DataFrame:
    """Events of the last days before the newest one."""
    last = events.agg(F.max("created_at")).first()[0]
    return events.where(F.col("created_at") >= F.lit(last) - F.make_interval(days=F.lit(days)))


def shape_events(raw: DataFrame, path_limit: int = 2048, body_limit: int = 12000) -> DataFrame:
    """raw(id, forwarded, headers map, path, body, status_code): first hop of the forward list, hidden headers redacted, lengths held."""
    headers = F.transform_values("headers", lambda k, v: F.when(F.lower(k).isin(*HIDDEN_HEADERS), "[redacted]").otherwise(v))
    return raw.select(
        "id", F.trim(F.get(F.split("forwarded", ","), 0)).alias("ip"), headers.alias("headers"), F.left("path", F.lit(path_limit)).alias("path"),
        F.left("body", F.lit(body_limit)).alias("body"), (F.col("status_code") >= 500).alias("is_error"),
    )
