"""Substring deduplication with Rabin-Karp hashes of every fixed-length word window.

Documents are dealt into blocks of about BLOCK_BYTES of text. Three passes over the blocks use the same shuffle:

1. every block sends, for each hash bucket, the short hashes of its distinct windows once; a bucket's task answers
   with one bit for each: does another block have it too?
2. the few windows that another block has are sent with their full hashes and the block's smallest document id;
   a bucket's task answers with those for which another block has a smaller one;
3. with these answers each block marks the repeated windows and merges them into maximal removal intervals.

A window that repeats inside one block needs no shuffle, and however often a window repeats, each block sends it once:
a passage that a third of all documents share costs no bucket more than one entry a block. The sizes of blocks and buckets
are measured in bytes of text, so what a task holds at a time does not depend on the number of partitions. A block sends one
row for each bucket in which it has windows; on inputs of many terabytes larger blocks keep these rows well filled.

Windows are equal if two Rabin-Karp hashes agree, of 64 bits and of the upper 32 bits, over two independent hashes of each word.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans

WIDTH = 13
#: Text of a block, and text whose windows share a bucket: what one task holds at a time.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20


class _Windows:
    """All windows of a block: hash, upper half of a second hash, bucket (from the second hash), row, word position, and each row's words."""

    def __init__(self, texts: pa.Array, width: int, buckets: int):
        offsets, data = spans.buffers(texts)
        hashes, second, bucket, rows, places, counts = [], [], [], [], [], np.zeros(len(offsets) - 1, np.int64)
        for first, last in spans.slices(offsets):
            at = offsets[first : last + 1]
            words = spans.Words(at - at[0], data[at[0] : at[-1]])
            counts[first:last] = np.diff(words.of_row)
            starts = spans.inside(words.of_row, width)
            if len(starts):
                each = words.digests()
                hashes.append(spans.window_hashes(each[:, 0], width)[starts])
                other = spans.window_hashes(each[:, 1], width, spans.SECOND_BASE)[starts]
                second.append((other >> np.uint64(32)).astype(np.uint32))
                bucket.append(((other & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32))
                own = np.searchsorted(words.of_row, starts, "right") - 1
                rows.append((own + first).astype(np.int32))
                places.append((starts - words.of_row[own]).astype(np.int32))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hash, self.second, self.bucket = join(hashes, np.uint64), join(second, np.uint32), join(bucket, np.int32)
        self.row, self.place, self.counts = join(rows, np.int32), join(places, np.int32), counts

    def by_bucket(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.bucket, kind="stable")
        return order, np.searchsorted(self.bucket[order], np.arange(int(self.bucket.max(initial=-1)) + 2))


def _firsts(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Where another pair of hashes begins, in sorted pairs."""
    return np.concatenate((np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (s[1:] != s[:-1])))


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("s", pa.binary()), ("d", pa.binary())])
_BACK = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("v", pa.binary()), ("s", pa.binary())])


def _send_short(table: pa.Table, width: int, buckets: int) -> pa.Table:
    w = _Windows(table["text"], width, buckets)
    order, at = w.by_bucket()
    block, rows = table["block"][0].as_py(), []
    for b in np.flatnonzero(np.diff(at)):
        rows.append((int(b), block, np.unique(_short(w.hash[order[at[b] : at[b + 1]]])).tobytes(), None, None))
    return _packed(rows, _SENT)


def _answer_short(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["h"]]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    for bucket, block, part in zip(table["bucket"].to_pylist(), table["block"].to_pylist(), parts, strict=True):
        hit = _among(part, twice)
        if hit.any():
            rows.append((bucket, block, np.packbits(hit).tobytes(), None))
    return _packed(rows, _BACK)


def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of `values` are in the sorted `found`."""
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.searchsorted(found, values)
    at[at == len(found)] = 0
    return found[at] == values


def _send_full(table: pa.Table, answers: pa.Table, width: int, buckets: int) -> pa.Table:
    if not table.num_rows or not answers.num_rows:
        return _packed([], _SENT)
    w = _Windows(table["text"], width, buckets)
    ids = _ids(table)
    order, at = w.by_bucket()
    block, rows = table["block"][0].as_py(), []
    for b, bits in zip(answers["bucket"].to_pylist(), answers["v"], strict=True):
        own = order[at[b] : at[b + 1]]
        short = _short(w.hash[own])
        known = np.unique(short)
        hit = known[np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=len(known)).astype(bool)]
        own = own[_among(short, hit)]
        h, s, d = w.hash[own], w.second[own], ids[w.row[own]]
        o = np.lexsort((d, s, h))
        h, s, d = h[o], s[o], d[o]
        first = _firsts(h, s)
        rows.append((b, block, h[first].tobytes(), s[first].tobytes(), d[first].tobytes()))
    return _packed(rows, _SENT)


def _answer_full(table: pa.Table) -> pa.Table:
    h, s = ([np.frombuffer(x.as_buffer(), kind) for x in table[c]] for c, kind in (("h", np.uint64), ("s", np.uint32)))
    d = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["d"]])
    one, two = np.concatenate(h), np.concatenate(s)
    o = np.lexsort((d, two, one))
    first = _firsts(one[o], two[o])
    later = np.zeros(len(o), bool)
    later[o] = d[o[first]][np.cumsum(first) - 1] < d[o]
    rows, at = [], 0
    for bucket, block, x, y in zip(table["bucket"].to_pylist(), table["block"].to_pylist(), h, s, strict=True):
        own = later[at : at + len(x)]
        at += len(x)
        if own.any():
            rows.append((bucket, block, x[own].tobytes(), y[own].tobytes()))
    return _packed(rows, _BACK)


def _pairs_among(h: np.ndarray, s: np.ndarray, found_h: np.ndarray, found_s: np.ndarray) -> np.ndarray:
    """Which pairs (h, s) are among the found ones, which are sorted by h."""
    hit, at = np.zeros(len(h), bool), np.searchsorted(found_h, h)
    live = np.arange(len(h))
    while len(live):
        live = live[at[live] < len(found_h)]
        live = live[found_h[at[live]] == h[live]]
        hit[live[found_s[at[live]] == s[live]]] = True
        at[live] += 1
    return hit


def _ids(table: pa.Table) -> np.ndarray:
    """Ids as integers; a null id counts as the largest, so such a row keeps nothing from others."""
    column = table["id"].combine_chunks()
    return column.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)


def _removed(table: pa.Table, answers: pa.Table, width: int, buckets: int) -> tuple[_Windows, list[np.ndarray]]:
    """For each row which words go."""
    w = _Windows(table["text"], width, buckets)
    ids = _ids(table)
    marks = [np.zeros(n, bool) for n in w.counts]
    if not len(w.hash):
        return w, marks
    doc = ids[w.row]
    o = np.lexsort((doc, w.second, w.hash))
    d = doc[o]
    first = _firsts(w.hash[o], w.second[o])
    repeated = np.zeros(len(o), bool)
    repeated[o] = d > d[first][np.cumsum(first) - 1]
    if answers.num_rows:
        order, at = w.by_bucket()
        for b, v, s in zip(answers["bucket"].to_pylist(), answers["v"], answers["s"], strict=True):
            own = order[at[b] : at[b + 1]]  # what comes back is sorted as it was sent
            repeated[own] |= _pairs_among(w.hash[own], w.second[own], np.frombuffer(v.as_buffer(), np.uint64), np.frombuffer(s.as_buffer(), np.uint32))
    rows, places = w.row[repeated], w.place[repeated]
    bounds = np.searchsorted(rows, np.arange(len(marks) + 1))  # windows stand in row order
    for r in np.flatnonzero(np.diff(bounds)):
        edge = np.zeros(w.counts[r] + 1, np.int32)
        at_r = places[bounds[r] : bounds[r + 1]]
        np.add.at(edge, at_r, 1)
        np.add.at(edge, at_r + width, -1)
        marks[r] = np.cumsum(edge[:-1]) > 0
    return w, marks


def _apply(table: pa.Table, answers: pa.Table, width: int, buckets: int, columns: list[str]) -> pa.Table:
    if not table.num_rows:
        return _empty(table, columns)
    _, marks = _removed(table, answers, width, buckets)
    offsets, data = spans.buffers(table["text"])
    kept, intervals = [], []
    for r, mark in enumerate(marks):
        words = data[offsets[r] : offsets[r + 1]].tobytes().split()  # at the same six bytes as spans.Words
        kept.append(b" ".join(compress(words, (~mark).tolist()) if mark.any() else words).decode())
        edge = np.flatnonzero(np.diff(np.concatenate(([False], mark, [False])).astype(np.int8)))
        intervals.append([{"first": int(a), "last": int(b)} for a, b in edge.reshape(-1, 2)])
    return _result(table, columns, [len(m) for m in marks], [int(m.sum()) for m in marks], kept, intervals)


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _result(table, columns, n_words, n_removed, kept, intervals) -> pa.Table:
    arrays = [table[c].combine_chunks() for c in columns]
    arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(intervals, _SPANS)]
    return pa.Table.from_arrays(arrays, names=[*columns, "n_words", "n_removed", "kept_text", "removed"])


def _empty(table: pa.Table, columns: list[str]) -> pa.Table:
    return _result(table.slice(0, 0), columns, [], [], [], [])


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per row of `docs`: its id and other columns, and what is left of its text.

    A word goes if a window of `width` words covers it whose words also start somewhere in a document with a smaller id.
    Windows are judged on the input. Added columns: n_words, n_removed, kept_text (kept words joined by one space; a text
    that loses nothing is also rejoined this way) and removed (maximal intervals [first, last) of word positions).
    Null text: no words. A null id counts as larger than every id. Rows with the same id are the same document: they never
    remove words from each other. The text column itself is not returned; other columns pass through under their names,
    unless they clash with an added column, which then wins.
    """
    others = [c for c in docs.columns if c not in {"n_words", "n_removed", "kept_text", "removed", text_col, id_col}]
    ids, texts = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    size = docs.agg(F.sum(F.octet_length(texts))).first()[0] or 0
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    # rows are dealt by all they have, so rows without an id or with the same id don't meet in one block
    dealt = F.pmod(F.xxhash64(ids, texts, F.spark_partition_id()), F.lit(blocks)).cast("int").alias("block")
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("int")
    parts = docs.select(ids.alias("id"), texts.alias("text"), rest.alias("rest"), dealt)
    sent, back = "bucket int, block int, h binary, s binary, d binary", "bucket int, block int, v binary, s binary"
    one = parts.groupBy("block").applyInArrow(lambda t: _send_short(t, width, buckets), sent)
    two = one.groupBy("bucket").applyInArrow(_answer_short, back)
    three = parts.groupBy("block").cogroup(two.groupBy("block")).applyInArrow(lambda t, a: _send_full(t, a, width, buckets), sent)
    four = three.groupBy("bucket").applyInArrow(_answer_full, back)
    schema = T.StructType(
        [T.StructField("id", T.LongType()), parts.schema["rest"]]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
        + [T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])))]
    )
    out = parts.groupBy("block").cogroup(four.groupBy("block")).applyInArrow(lambda t, a: _apply(t, a, width, buckets, ["id", "rest"]), schema)
    kept = [F.col("rest")[c].alias(c) for c in others]
    return out.select(F.col("id").alias(id_col), *kept, "n_words", "n_removed", "kept_text", "removed")


def kept_digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> dict[int, tuple[int, int, str]]:
    """The same result by plain loops, for tests."""
    import re

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    least: dict[tuple, int] = {}
    for i in sorted(words, reverse=True):
        for k in range(len(words[i]) - width + 1):
            least[tuple(words[i][k : k + width])] = i
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - width + 1) if least[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
