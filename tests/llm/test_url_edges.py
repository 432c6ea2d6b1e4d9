"""Ranks by edges that lie sorted by their source."""

from geomill.llm import urlgraph
from geomill.llm.shared import lookup
from pyspark.sql import functions as F


def test_edges_lie_where_they_are_summed(spark, monkeypatch):
    seen = {}
    plain = urlgraph.written
    monkeypatch.setattr(urlgraph, "written", lambda df, name: seen.setdefault(name, plain(df, name)) if name == "edges" else plain(df, name))
    edges = spark.sql("select concat('h', id % 50) as src, concat('h', id * 7 % 53) as dst, 1L as w from range(2000)").where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    seeds, ends = (spark.createDataFrame([(x,)], "host string") for x in ("h1", "h2"))
    assert urlgraph.normalised_rank(edges, seeds, ends).count() > 40
    placed = seen["edges"].select("src", F.col("_metadata.file_path").alias("file")).groupBy("src").agg(F.countDistinct("file").alias("n"))
    assert placed.where("n > 1").count() < placed.count() / 4


def test_small_tables_are_not_shuffled_to(spark):
    rows, table = spark.range(1000).select(F.col("id").alias("k")), spark.createDataFrame([(k, k) for k in range(100)], "t long, v long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(lookup(rows, "k", table, "t", [])) and "BroadcastHashJoin" in plan(lookup(rows, "k", table, "t", [], merge=False))
