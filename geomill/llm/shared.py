"""The shared folder, written tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it; where it names none, a local one in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at a time; Spark's own 64 MB are a whole input split of texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on an Arrow batch of the session has about BATCH_BYTES. The executor's buffers outside its heap, and the worker's
    copy, are as large as a batch for each task, and neither gives all of it back."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Keys that hold more than this part of all rows are frequent: there are fewer than HOT of them.
HOT = 1000


def frequent_counts(rows: DataFrame, key: str, part: int = HOT) -> DataFrame:
    """(key, n) of the values, null aside, that hold more than 1 / part of all rows: fewer than `part`, at any size of input."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * part > F.lit(rows.count()))


def frequent(rows: DataFrame, key: str, part: int = HOT) -> list:
    return [r[0] for r in frequent_counts(rows, key, part).select(key).collect()]


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, hot: list, how: str = "inner", merge: bool = True) -> DataFrame:
    """`rows` joined with `table`, in which every key stands once; columns of the two have different names.

    Rows of the frequent keys `hot` find their row of `table` by broadcast, so no task gets all rows of such a key; the
    others are shuffled, or with merge=False joined as Spark chooses by the size of `table`.
    """
    table = table.hint("merge") if merge else table
    on = F.col(key) == F.col(table_key)
    if not hot:
        return rows.join(table, on, how)
    kind = rows.schema[key].dataType
    value = lambda x: F.unhex(F.lit(x.hex())) if isinstance(x, (bytes, bytearray)) else F.lit(x)
    keys = F.broadcast(rows.sparkSession.range(1).select(F.explode(F.array(*(value(x).cast(kind) for x in hot))).alias("hot_key")))
    few = table.join(keys, F.col(table_key) == F.col("hot_key"), "left_semi")
    often = rows.join(keys, F.col(key) == F.col("hot_key"), "left_semi").join(F.broadcast(few), on, how)
    return often.unionByName(rows.join(keys, F.col(key) == F.col("hot_key"), "left_anti").join(table, on, how))


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of `links(a, b)`: the smallest node of its connected component.

    Each round takes the smallest label among a node and its neighbours, then follows that label's own label
    (pointer jumping), so long chains shrink geometrically. Nodes with very many neighbours, and labels that very many
    nodes have already, are looked up by broadcast (`lookup`), so a large component does not go to one task.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    centres = frequent(both, "b")
    for _ in range(rounds):
        near = lookup(both, "b", labels, "node", centres).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("next")
        )
        step = written(step, "steps")
        parents = labels.select(F.col("node").alias("parent"), F.col("label").alias("grand"))
        jumped = lookup(step, "next", parents, "parent", frequent(step, "next"), "left").select(
            "node", "old", F.least("next", F.coalesce("grand", "next")).alias("label")
        )
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label < old").isEmpty():
            return labels
    raise RuntimeError(f"labels still changed after {rounds} rounds")
