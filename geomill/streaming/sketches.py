"""Minute metrics whose percentiles can be merged: each batch of a stream adds a quantile sketch for the minutes it has events of.

No state is kept between batches and no event is too late: a batch writes what it saw, and readers merge. Counts and means are
exact; a percentile's rank is within RANK_ERROR of what was asked for, and exact for groups of up to about K events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.requests import minute_metrics

#: Size of a sketch, and the error of a rank that it keeps to (99 % of the time, by its authors' bound).
K, RANK_ERROR = 400, 0.01
FAMILIES = (2, 3, 4, 5)


def minute_sketches(events: DataFrame, k: int = K) -> DataFrame:
    """(minute, route_template, requests, sum_ms, s2xx to s5xx, sketch) of events; minutes without latencies have no sketch."""
    family = lambda n: F.count_if(F.floor(F.col("status_code") / 100) == n).alias(f"s{n}xx")
    ms = F.col("latency_ms").cast("long")
    minute = F.date_trunc("minute", "created_at").alias("minute")
    sums = (F.count("*").alias("requests"), F.count(ms).alias("timed"), F.sum(ms).alias("sum_ms"), *map(family, FAMILIES))
    return events.groupBy(minute, "route_template").agg(*sums, F.kll_sketch_agg_bigint(ms, k).alias("sketch"))


def write_sketches(events: DataFrame, path: str, checkpoint: str, k: int = K) -> None:
    """Adds what is available now in a stream of events and stops. A batch that runs again overwrites its own folder, so
    nothing counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        minute_sketches(batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(sketches: DataFrame, by: Column | str = "minute", k: int = K) -> DataFrame:
    """Metrics of sketches merged by route and minute, or by any coarser time, as F.date_trunc('day', 'minute')."""
    at = F.col(by) if isinstance(by, str) else by
    sums = [F.sum(c).alias(c) for c in ("requests", "timed", "sum_ms", *(f"s{n}xx" for n in FAMILIES))]
    whole = sketches.groupBy(at.alias("minute"), "route_template").agg(*sums, F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    part = lambda q: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(q))).cast("int")
    mean = F.round(F.col("sum_ms") / F.col("timed")).cast("int")
    return whole.select("minute", "route_template", "requests", mean.alias("mean_ms"), part(0.5).alias("p50_ms"), part(0.9).alias("p90_ms"), *(f"s{n}xx" for n in FAMILIES))


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def recompute(stored: DataFrame, events: DataFrame, now: Column, minutes: int = 180) -> DataFrame:
    """`stored` metrics with the last `minutes` before `now` computed anew from `events`, with exact percentiles.

    The window starts at a whole minute, so no minute is half old and half new. Minutes in it that have no events any more go;
    older ones stay as they are, whatever events say. Later ones than `now` are computed too.
    """
    start = F.date_trunc("minute", now - F.make_interval(mins=F.lit(minutes)))
    fresh = minute_metrics(events.where(F.col("created_at") >= start))
    return stored.where(F.col("minute") < start).unionByName(fresh.select(*stored.columns))
