"""Minute metrics over a stream of request events, and a drop folder of GeoJSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paging import newest
from ..operators.tables import KEY, parse_features


def minute_metrics_stream(events: DataFrame, lateness: str = "180 minutes") -> DataFrame:
    """Tumbling minutes by route. Percentiles are approximate here; the batch job over the same events is exact."""
    ms = F.col("latency_ms")
    family = lambda n: F.count_if(F.floor(F.col("status_code") / 100) == n)
    grouped = events.withWatermark("created_at", lateness).groupBy(F.window("created_at", "1 minute").alias("w"), "route_template")
    out = grouped.agg(F.count("*").alias("requests"), F.round(F.avg(ms)).cast("int").alias("mean_ms"), F.percentile_approx(ms, 0.5).alias("p50_ms"), F.percentile_approx(ms, 0.9).alias("p90_ms"), *(family(n).alias(f"s{n}xx") for n in (2, 3, 4, 5)))
    return out.select(F.col("w.start").alias("minute"), *[c for c in out.columns if c != "w"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is available now to Parquet and stops; the checkpoint makes a repeated run write nothing twice."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def upsert_minutes(metrics: DataFrame, path: str, checkpoint: str) -> None:
    """Writes the minutes that each batch changed to a folder of its own under `path` and stops; a batch that runs again
    overwrites its folder. `read_minutes` gives the newest row of each minute and route."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    metrics.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def read_minutes(spark: SparkSession, path: str) -> DataFrame:
    return newest(spark.read.parquet(path), ["minute", "route_template"], F.col("batch").desc()).drop("batch")


def ingest_stream(spark: SparkSession, folder: str, collection_id: str, job: str | None = None, lateness: str = "180 minutes") -> DataFrame:
    """Features of the GeoJSON lines that arrive in a folder. A part that comes again within `lateness` of its first arrival is
    dropped, so the state stays bounded; later repeats are for `dedupe_staging`."""
    lines = spark.readStream.text(folder)
    parts, _ = parse_features(lines, collection_id, job)
    return parts.withColumn("ingested_at", F.current_timestamp()).withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(KEY)
