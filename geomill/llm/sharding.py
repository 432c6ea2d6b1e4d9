"""Consistent placement with a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, from two hashes of its name. Shards take turns:
each claims its next preferred slot that is still free, until the table is full, so all shards hold nearly the same number
of slots and a change of shards moves few of them. A row's slot is a hash of its key modulo the table's size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS, SHARDS = 65_537, 64
#: About so many bytes, uncompressed, are written by one task.
TASK_BYTES = 256 << 20


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in `shards`) of each slot. The size is a parameter and does not depend on the data."""
    if not is_prime(slots) or not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("a prime number of slots and at least one shard, with distinct names, are needed")
    place = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % slots
            table[place[k]] = k
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    rows = [(slot, k, shards[k]) for slot, k in enumerate(lookup_table(shards, slots))]
    return spark.createDataFrame(rows, "slot long, shard int, shard_name string")


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """A slot from the keys: 60 bits of an MD5 of their text, so that other systems can compute it too. Null is a value of its own."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), k.cast("string")), F.lit("n")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def shard(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """`df` with slot, shard and shard_name; columns of these names are replaced.

    Placement is a broadcast join with the table of `slots` rows (a fixed bound), so no row is shuffled. All rows of one
    key get one shard; where one key holds a large part of all rows, give a second, finer key as well. Null keys are placed
    like any other value. Rows are never dropped.
    """
    named = df.drop("slot", "shard", "shard_name").withColumn("slot", slot_of(*(F.col(f"`{k}`") for k in keys), slots=slots))
    table = table_frame(df.sparkSession, shards, slots)
    return named.join(F.broadcast(table), "slot", "left").select(*(F.col(f"`{c}`") for c in named.columns), "shard", "shard_name")


def row_bytes(df: DataFrame) -> Column:
    """About the size of a row: the bytes of texts, binaries and of nested values as text, and 8 for any other column."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    sized = [F.octet_length(F.col(f"`{c}`")) for c, k in kinds.items() if k in ("string", "binary")]
    nested = [F.octet_length(F.to_json(F.col(f"`{c}`"))) for c, k in kinds.items() if k in ("array", "map", "struct")]
    return sum((F.coalesce(x, F.lit(0)).cast("long") for x in sized + nested), F.lit(8 * len(kinds)).cast("long"))


def writers(placed: DataFrame, n_shards: int, task_bytes: int = TASK_BYTES) -> list[int]:
    """How many tasks write each shard, from the bytes of its rows; one pass that gathers a sum for each shard."""
    sums = dict(tuple(r) for r in placed.groupBy("shard").agg(F.sum(row_bytes(placed.drop("slot", "shard", "shard_name")))).collect())
    return [max(1, -(-sums.get(k, 0) // task_bytes)) for k in range(n_shards)]


def write_shards(
    df: DataFrame, path: str, keys: list[str], shards: list[str], slots: int = SLOTS, rows_per_file: int = 1_000_000, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """Writes every row of `df`, with its slot and shard_name, to the folder of its shard, and returns the shards read back.

    Tasks are dealt by shard and a salt from the whole row. A shard has one salt for each `task_bytes` of its rows, so the
    number of writing tasks grows with the data and a shard that holds a third of all rows has as large a part of them; rows
    that are equal in every column share a salt. Null keys have a shard like any other value, repeated rows are
    all written, an empty table gives an empty folder and an empty result. Columns of `df` named slot, shard or shard_name
    are replaced. The result's columns are those of `df`, slot, shard_name, and shard.
    """
    placed = shard(df, keys, shards, slots)
    salts = writers(placed, len(shards), task_bytes)
    columns = [c for c in placed.columns if c != "shard"]
    whole = F.xxhash64(*(F.col(f"`{k}`") for k in df.columns if df.schema[k].dataType.typeName() not in ("map", "variant")))
    salt = F.pmod(whole, F.element_at(F.array(*map(F.lit, salts)), F.col("shard") + 1).cast("long"))
    dealt = placed.select(*(F.col(f"`{c}`") for c in columns), "shard").repartition(sum(salts), "shard", salt)
    dealt.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)
