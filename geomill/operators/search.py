"""Document search: a score per document from token hits in its first line and its text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doc_search(docs: DataFrame, tokens: list[str], limit: int = 8) -> DataFrame:
    """score = sum over tokens: first-line hit 18 + 6 x count there; text 4 x min(count, 20) + 2 x min(length, 12) ** 0.3."""
    head, body = F.lower(F.coalesce(F.substring_index("text", "\n", 1), F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    count = lambda c, t: (F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t)
    score = F.lit(0.0)
    for t in (x.lower() for x in tokens):
        score = score + F.when(F.contains(head, F.lit(t)), 18 + 6 * count(head, t)).otherwise(0.0)
        score = score + F.when(F.contains(body, F.lit(t)), 4 * F.least(count(body, t), F.lit(20.0)) + 2 * min(len(t), 12) ** 0.3).otherwise(0.0)
    return docs.select("doc_id", F.round(score, 6).alias("score"), F.left("text", F.lit(220)).alias("snippet")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(limit)
