"""Exact quantiles of weighted values, with no group held by one task.

Values are counted first, so repeated ones cost a row. Each group's values then fall into bins by their logarithm; sums over
bins, of which a group has a bounded number, tell in which bins the wanted places lie, and only those bins are sorted, each on
its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins for each step by a factor of e.
FINENESS = 64


def quantiles(counts: DataFrame, keys: list[str], shares: dict[str, float], value: str = "value", n: str = "n") -> DataFrame:
    """keys and one column for each of `shares` {name: share}, between the two nearest values as `percentile` has it.

    counts: keys, value (double) and how often it stands there. Null values and those that stand nowhere don't count; a group
    without others has no row. Keys may be null. NaN is greater than all others.
    """
    v = F.col("_v")
    rows = counts.where((F.col(n) > 0) & F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.col(n).cast("long").alias("_n"))
    bin_ = F.when(F.isnan(v), F.lit(1 << 30)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * FINENESS))
    rows = rows.withColumn("_bin", bin_.cast("long"))
    bins = rows.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"))
    whole = Window.partitionBy(*keys)
    bins = bins.withColumns({"_end": F.sum("_m").over(whole.orderBy("_bin")), "_total": F.sum("_m").over(whole)})
    at = {name: F.lit(float(share)) * (F.col("_total") - 1) for name, share in shares.items()}
    wanted = [F.struct(F.lit(f"{name} {side}").alias("place"), rank(at[name]).cast("long").alias("rank")) for name in shares for side, rank in (("low", F.floor), ("high", F.ceil))]
    start = F.col("_end") - F.col("_m")
    here = F.filter(F.array(*wanted), lambda w: (w["rank"] >= start) & (w["rank"] < F.col("_end")))
    needed = bins.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_bin").alias("_of"), start.alias("_start"), "_total", here.alias("_here")).where(F.size("_here") > 0)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_bin") == F.col("_of"))
    met = rows.join(needed, same)
    end = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = met.withColumn("_end", end)
    found = F.filter("_here", lambda w: (w["rank"] >= F.col("_end") - F.col("_n")) & (w["rank"] < F.col("_end")))
    picked = met.select(*keys, "_v", "_total", F.explode(found).alias("_w"))
    pick = lambda place: F.max(F.when(F.col("_w.place") == place, v))
    ends = {f"_{side} {name}": pick(f"{name} {side}") for name in shares for side in ("low", "high")}
    out = picked.groupBy(*keys).agg(F.max("_total").alias("_total"), *(c.alias(k) for k, c in ends.items()))

    def between(name: str):
        low, high, place = F.col(f"`_low {name}`"), F.col(f"`_high {name}`"), at[name]
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return out.select(*keys, *(between(name).alias(name) for name in shares))
