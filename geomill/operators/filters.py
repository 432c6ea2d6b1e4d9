"""Feature filters. A property is read as text (nested values stay JSON text); a null property never matches."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

# Filter operators, and what a token for exact search looks like.
OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "like", "ilike")
#: A token has at least this many characters.
GRAM = 8
#: Grams of a token that are looked up.
PROBES = 3
TOKEN = r"^[A-Za-z0-9][A-Za-z0-9._:-]{7,127}\z"
#: A run of characters of tokens in lower case, as long as a token or longer.
WORD = rf"[a-z0-9._:-]{{{GRAM},}}+"


def properties_map(column: str = "properties") -> Column:
    return F.from_json(F.col(column), "map<string,string>")


def prop(key: str, column: str = "properties") -> Column:
    return properties_map(column)[key]


def flat_text(column: str = "properties") -> Column:
    """All values, joined by a space in key order."""
    return F.concat_ws(" ", F.transform(F.array_sort(F.map_entries(properties_map(column))), lambda e: e["value"]))


def parse_filter(text: str) -> list[tuple[str, str, str]]:
    """Lines of key:op:value, split at the first two colons; unknown ops and empty keys are skipped."""
    out = []
    for line in text.splitlines():
        pieces = line.split(":", 2)
        if len(pieces) == 3 and pieces[0].strip() and pieces[1].strip().lower() in OPS:
            out.append((pieces[0].strip(), pieces[1].strip().lower(), pieces[2]))
    return out


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def condition(key: str, op: str, value: str) -> Column:
    """Ordering ops compare as numbers if the value is one (a property that is no number then never matches), else as text."""
    p = prop(key)
    if op in ("eq", "ne"):
        return p == value if op == "eq" else p != value
    if op in ("like", "ilike"):
        return getattr(p, op)(like_pattern(value))
    n = _number(value)
    left, right = (p.try_cast("double"), F.lit(n)) if n is not None else (p, F.lit(value))
    return {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]


def like_pattern(value: str) -> str:
    """`value` as a pattern in which a backslash escapes %, _ and itself and stands for itself before anything else."""
    return re.sub(r"\\([%_\\])|\\", lambda m: m[0] if m[1] else "\\\\", value)


def structured_filter(df: DataFrame, filters: str | list[tuple[str, str, str]]) -> DataFrame:
    for f in parse_filter(filters) if isinstance(filters, str) else filters:
        df = df.where(condition(*f))
    return df


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def property_filter(df: DataFrame, **wanted: str) -> DataFrame:
    """name=value: equal, or with * in the value any text there."""
    for key, value in wanted.items():
        df = df.where(prop(key) == value if "*" not in value else prop(key).like(escape_like(value).replace("*", "%")))
    return df


def fulltext(df: DataFrame, q: str) -> DataFrame:
    if len(q.strip()) < 4:
        raise ValueError("at least 4 characters are needed")
    return df.where(F.contains(F.lower(flat_text()), F.lower(F.lit(q.strip()))))


def gram_hashes(text: str) -> np.ndarray:
    """Distinct hashes of all runs of GRAM characters; time is linear in the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(c) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + n] + np.uint64(1)
    h ^= h >> np.uint64(29)
    return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))


def _grams(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys and `gram` for each distinct run of GRAM characters in the column `text`; the text itself is not copied."""

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, 64):
                part = b.slice(first, 64)
                found = [gram_hashes(t or "") for t in part.column(len(keys)).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(len(keys))), pa.array(np.concatenate(found))], names=[*keys, "gram"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInArrow(run, f"{kinds}, gram long")


def _postings(df: DataFrame) -> DataFrame:
    """word, collection_id, id: the words of the features' texts in lower case, once a row."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(flat_text()), F.lit(WORD), F.lit(0)))
    return df.select(F.explode(words).alias("word"), "collection_id", "id")


def build_text_index(df: DataFrame, path: str) -> str:
    """An inverted index of the features' texts below `path`: postings (word, collection_id, id), sorted by word, so a probe reads
    few row groups; grams (gram, word) of the different words, and the number of words of each gram. Gives `path`.

    A word is a run of the characters that tokens consist of, so a text holds a token exactly where one of its words does."""
    read = df.sparkSession.read.parquet
    _postings(df).repartitionByRange("word", "id").sortWithinPartitions("word", "id").write.option("compression", "zstd").parquet(f"{path}/postings")
    words = read(f"{path}/postings").select("word").distinct()
    _grams(words, "word", ["word"]).repartitionByRange("gram", "word").sortWithinPartitions("gram").write.option("compression", "zstd").parquet(f"{path}/grams")
    counts = read(f"{path}/grams").groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.option("compression", "zstd").parquet(f"{path}/counts")
    return path


def exact_search(df: DataFrame, tokens: DataFrame, keys: list[str], limit: int | None = None, index: str | None = None) -> DataFrame:
    """Rows for each token of `tokens(token)`: by id, else by a known key's value, else by the flat text; the first tier
    with rows wins; with a limit a token gets so many rows at most, the first by id.

    The first two tiers are equi-joins on exploded keys. Tokens without rows there go on to the third: of a token's grams the
    PROBES rarest are looked up among the different words of the texts, words that have all of them are compared with the token,
    and the features of those that hold it are its rows. `index` is the path of an index of the same features; without one, the
    words are gathered from all texts in one pass."""
    spark = df.sparkSession
    valid = tokens.where(F.col("token").rlike(TOKEN)).distinct()
    entries = F.array(F.struct(F.lit(1).alias("tier"), F.col("id").alias("value")), *(F.struct(F.lit(2).alias("tier"), prop(k).alias("value")) for k in keys[:16]))
    keyed = df.select("id", "collection_id", F.explode(entries).alias("e")).where("e.value is not null")
    hits = stored(valid.join(keyed, valid.token == F.col("e.value")).select("token", "e.tier", "id", "collection_id").distinct(), "hits")
    best = hits.groupBy(F.col("token").alias("_token")).agg(F.min("tier").alias("_best"))
    rest = stored(valid.join(best, F.col("token") == F.col("_token"), "left_anti").select("token", F.lower("token").alias("low")), "tokens")
    asked = _grams(rest, "low", ["token"])
    if index is None:
        postings = stored(_postings(df), "postings")
        grams = stored(_grams(postings.select("word").distinct(), "word", ["word"]).join(asked.select("gram").distinct(), "gram", "left_semi"), "grams")
        counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    else:
        postings, grams, counts = (spark.read.parquet(f"{index}/{t}") for t in ("postings", "grams", "counts"))
    of = Window.partitionBy("token")
    ranked = asked.join(counts, "gram", "left").withColumn("found", F.count("n").over(of) == F.count("*").over(of)).where("found")
    rarest = ranked.withColumn("place", F.row_number().over(of.orderBy("n", "gram"))).where(F.col("place") <= PROBES)
    rarest = rarest.withColumn("probes", F.count("*").over(of)).select("token", "gram", "probes")
    near = rarest.join(grams, "gram").groupBy("token", "word").agg(F.count("*").alias("n"), F.first("probes").alias("probes")).where("n = probes")
    holding = stored(near.where(F.contains("word", F.lower("token"))).select("token", "word"), "words")
    loose = holding.join(postings, "word").select("token", F.lit(3).alias("tier"), "id", "collection_id").distinct()
    first = hits.join(best, (F.col("token") == F.col("_token")) & (F.col("tier") == F.col("_best"))).select(*hits.columns).union(loose)
    if limit is None:
        return first
    place = F.row_number().over(of.orderBy("id", "collection_id"))
    return first.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def datetime_filter(df: DataFrame, text: str, column: str = "created_at") -> DataFrame:
    """`a` or `a/b`, both ends included and `..` open. Where one end can't be read, nothing is filtered."""
    first, _, last = text.partition("/")
    ends = [(side, op) for side, op in ((first, ">="), (last or first, "<=")) if side and side != ".."]
    value = {side: F.try_to_timestamp(F.lit(side)) for side, _ in ends}
    unread = reduce(lambda p, q: p | q, (v.isNull() for v in value.values()), F.lit(False))
    for side, op in ends:
        df = df.where(unread | (F.col(column) >= value[side] if op == ">=" else F.col(column) <= value[side]))
    return df


def bbox_filter(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Boxes that meet `box`; touching counts, null boxes don't. Plain comparisons, so they reach the Parquet scan."""
    x1, y1, x2, y2 = box
    return df.where((F.col("minx") <= x2) & (F.col("maxx") >= x1) & (F.col("miny") <= y2) & (F.col("maxy") >= y1))


def select_properties(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("properties", F.to_json(F.map_filter(properties_map(), lambda k, _: k.isin(keys))))


def shadow_visible(df: DataFrame, active_jobs: list[str]) -> DataFrame:
    job = F.col("bulk_import_job_id")
    return df.where(job.isNull() | ~job.isin(active_jobs)) if active_jobs else df


def queryables(df: DataFrame, sample_ids: int = 100, limit: int = 500) -> DataFrame:
    """Top-level property keys of the first ids, sorted."""
    ids = df.select("id").distinct().orderBy("id").limit(sample_ids)
    keys = df.join(F.broadcast(ids), "id", "left_semi").select(F.explode(F.map_keys(properties_map())).alias("name"))
    return keys.distinct().orderBy("name").limit(limit)


def visible_to(df: DataFrame, shares: DataFrame, user: str | None, admin: bool = False) -> DataFrame:
    """Public rows; with a user also those for logged-in users, their own and those shared with them."""
    if admin:
        return df
    if user is None:
        return df.where("visibility = 'public'")
    own = shares.where(F.col("username") == user).select(F.col("resource_id").alias("_r")).distinct()
    return df.join(own, df.id == F.col("_r"), "left").where(F.col("visibility").isin("public", "logged") | (F.col("owner") == user) | F.col("_r").isNotNull()).drop("_r")
