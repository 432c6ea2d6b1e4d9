"""Digests of ordered lists, such as versions of mosaics, with no list in one place."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one chunk joins.
CHUNK = 256


def _chunks(batches, most: int) -> Iterator[pa.RecordBatch]:
    """(key, first, text): runs of up to `most` values of a key, joined by commas; rows come sorted by key and value."""
    key, values, out = None, [], []

    def close() -> None:
        if values:
            out.append((key, values[0], ",".join(values)))
            values.clear()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["key", "first", "text"])

    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key or len(values) == most:
                close()
                key = k
            values.append(v)
        if out:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


def _joined(batches) -> Iterator[pa.RecordBatch]:
    """(key, version): SHA-256 of `key:` and the key's chunks, which come in order."""
    key, state, out = None, None, []
    for b in batches:
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if state is not None and k == key:
                state.update(b"," + text.encode())
            else:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, sha256(f"{k}:{text}".encode())
    if state is not None:
        out.append((key, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(2)], names=["key", "version"])


def mosaic_versions(df: DataFrame) -> DataFrame:
    """(collection_id, version): SHA-256 of the collection's id, a colon and its distinct feature ids in order, joined by commas.

    A collection without ids has no version. Ids are joined to chunks in ranges of their order, so those of a large collection
    come from many tasks; only the digest, which has to be taken in order, is one task for each collection, over CHUNK times
    fewer rows. Rows without a collection or an id don't count.
    """
    most = CHUNK
    ids = df.where("collection_id is not null and id is not null").select(F.col("collection_id").alias("key"), F.col("id").cast("string").alias("value")).distinct()
    chunks = ids.repartitionByRange("key", "value").sortWithinPartitions("key", "value").mapInArrow(lambda b: _chunks(b, most), "key string, first string, text string")
    out = chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "text").mapInArrow(_joined, "key string, version string")
    return out.withColumnRenamed("key", "collection_id")


def version_matches(given: Column, version: Column) -> Column:
    """Whether a version that a client gives is the current one; its first 16 characters will do."""
    return F.coalesce((given == version) | ((F.length(given) == 16) & (given == F.left(version, F.lit(16)))), F.lit(False))
