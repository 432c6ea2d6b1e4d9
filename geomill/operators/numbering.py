"""Row numbers in an order, by distributed prefix sums: no task holds all rows, or all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored


def number_rows(df: DataFrame, order: list[str | Column], name: str = "number", within: list[str | Column] | None = None, drop: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    """`df` as a stored table with the place of each row, from `first` on, in the order of the columns `order`.

    Rows are dealt to ranges of `order` and sorted in each by `within` (`order`, if not given; it has to refine it); counts by
    range, of which there are as many as shuffle partitions, say where each range starts. Rows equal in all of `order` fall
    into one range, so it should end in a column that tells them apart. Columns `drop` are only sorted by. Null values come
    where `order` puts them; ties are numbered in any order.
    """
    own = [c for c in df.columns if c not in drop]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*(within or order))
    placed = dealt.select(*(F.col(f"`{c}`") for c in own), F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    table = stored(placed, "ranges")
    starts, total = [], first
    for part, n in sorted(tuple(r) for r in table.groupBy("_range").agg(F.count("*")).collect()):
        starts.append((part, total))
        total += n
    offsets = F.broadcast(table.sparkSession.createDataFrame(starts, "_range int, _start long"))
    return table.join(offsets, "_range").select(*(F.col(f"`{c}`") for c in own), (F.col("_start") + F.col("_at")).alias(name))
