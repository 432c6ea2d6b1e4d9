"""Media columns stored as content-defined chunks.

A gear hash rolls over each payload; where its top bits are zero, the payload is cut (not before MIN_CHUNK bytes, not after
MAX_CHUNK). The stored form of a media value is one blob: a header, the ordered list of its chunks (size, digest, and where
the chunk stands), and the bytes of those chunks that stand here. Chunks that may occur again stand in a chunk table, once per
digest. Which ones may is told by a filter, built from digests counted in Spark and sized by their number; a false hit only
sends a chunk the longer way. Reading joins the lists with the chunk table, puts the chunks in order and checks every digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .shared import HOT, lookup, written

MIN_CHUNK, MAX_CHUNK, CUT_BITS, UNIT = 256, 16_384, 11, 64
#: The filter has about SPARSE bits for each repeated digest, within these powers of two.
SPARSE, FEWEST_BITS, MOST_BITS = 256, 25, 28
GEAR = (spans.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
MAGIC, ENTRY = b"CDC2", struct.Struct("<IB32s")


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last 32 bytes has zeros in its top bits."""
    h = GEAR[data]
    for reach in (1, 2, 4, 8, 16):  # doubles the bytes that each hash covers
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
    return np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1


def chunk_ends(cuts: list[int], first: int, last: int) -> list[int]:
    """Ends of the chunks of a payload that stands at [first, last)."""
    out, at = [], first
    while last - at > MIN_CHUNK:
        k = bisect_left(cuts, at + MIN_CHUNK)
        end = cuts[k] if k < len(cuts) else last
        at = min(end, at + MAX_CHUNK, last)
        out.append(at)
    if at < last:
        out.append(last)
    return out


def _payloads(column):
    """(row, payload, chunk ends in it), over the slices of a batch; payloads are padded with zeros to whole units."""
    offsets, data = spans.buffers(column)
    for first, last in spans.slices(offsets):
        at = offsets[first : last + 1]
        sizes = np.diff(at)
        padded = np.maximum(-(-sizes // UNIT), 1) * UNIT
        to = np.concatenate(([0], np.cumsum(padded)))
        room = np.zeros(int(to[-1]), np.uint8)
        room[np.repeat(to[:-1] - (at[:-1] - at[0]), sizes) + np.arange(int(sizes.sum()))] = data[at[0] : at[-1]]
        cuts, body = gear_cuts(room).tolist(), room.tobytes()
        for r in range(last - first):
            a, b = int(to[r]), int(to[r + 1])
            yield first + r, int(sizes[r]), body[a:b], [e - a for e in chunk_ends(cuts, a, b)]


def _chunks(payload: bytes, ends: list[int]) -> list[bytes]:
    return [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _digests(batches):
    for batch in batches:
        found = [hashlib.sha256(c).digest() for _, _, p, ends in _payloads(batch.column(0)) for c in _chunks(p, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])


def repeated_chunks(texts: DataFrame) -> DataFrame:
    """(digest, n) of the chunks that occur more than once."""
    counted = texts.mapInArrow(_digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n"))
    return written(counted.where("n > 1"), "digests")


def repeated_filter(repeated: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words): a bit set that has the bits of the given digests; at most 2**(MOST_BITS - 5) words are gathered."""
    bits = min(max(int(repeated.count() * SPARSE).bit_length(), FEWEST_BITS), MOST_BITS)
    head = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    groups = (
        repeated.select(F.shiftrightunsigned(head, 56 - bits).alias("bit"))
        .groupBy(F.shiftright("bit", 5).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits"))
    )
    table = groups.toArrow()
    words = np.zeros(1 << (bits - 5), np.uint32)
    words[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)
    return bits, words


def _in_filter(filled: tuple[int, np.ndarray], digest: bytes) -> bool:
    bits, words = filled
    bit = int.from_bytes(digest[:8], "big") >> (64 - bits)
    return bool(words[bit >> 5] >> np.uint32(bit & 31) & np.uint32(1))


_WANTED = pa.list_(pa.struct([("at", pa.int32()), ("digest", pa.binary())]))


def form_of(chunks: list[bytes], digests: list[bytes], shared: list[bool]) -> bytes:
    entries = b"".join(ENTRY.pack(len(c), s, d) for c, d, s in zip(chunks, digests, shared, strict=True))
    return MAGIC + struct.pack("<I", len(chunks)) + entries + b"".join(c for c, s in zip(chunks, shared, strict=True) if not s)


def payload_of(form: bytes, shared: dict[int, bytes]) -> bytes:
    """The payload of a stored form; `shared` has the chunks that stand elsewhere, by their place. Every digest is checked."""
    if form[:4] != MAGIC:
        raise ValueError("no stored media form")
    n = int.from_bytes(form[4:8], "little")
    at, parts = 8 + n * ENTRY.size, []
    for k, (size, far, digest) in enumerate(ENTRY.iter_unpack(form[8:at])):
        part = shared[k] if far else form[at : at + size]
        at += 0 if far else size
        if len(part) != size or hashlib.sha256(part).digest() != digest:
            raise ValueError("a chunk does not have its digest")
        parts.append(part)
    return b"".join(parts)


def _store(batches, filled: tuple[int, np.ndarray]):
    for batch in batches:
        forms, wanted, sizes = [], [], []
        for _, n, payload, ends in _payloads(batch.column(1)):
            chunks = _chunks(payload, ends)
            digests = [hashlib.sha256(c).digest() for c in chunks]
            shared = [_in_filter(filled, d) for d in digests]
            forms.append(form_of(chunks, digests, shared))
            wanted.append([{"at": k, "digest": d} for k, (d, s) in enumerate(zip(digests, shared, strict=True)) if s])
            sizes.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(forms, pa.binary()), pa.array(wanted, _WANTED)], names=["doc_id", "n_bytes", "form", "wanted"])


def _shared_chunks(batches, filled: tuple[int, np.ndarray]):
    for batch in batches:
        found: dict[bytes, bytes] = {}
        for _, _, payload, ends in _payloads(batch.column(0)):
            for c in _chunks(payload, ends):
                d = hashlib.sha256(c).digest()
                if _in_filter(filled, d):
                    found[d] = c
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["same", "payload"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(media, chunks): the written tables. media has a row for each row of `docs` with a key of its own; its column form is
    what is stored of it, chunks has the chunks that stand elsewhere (`often`: over 1 / HOT of all repeated ones are this one).

    Null text: empty, stored as one unit of zeros. Null and repeated ids are ordinary. Extra columns are not read.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    repeated = repeated_chunks(named.select("text"))
    filled = docs.sparkSession.sparkContext.broadcast(repeated_filter(repeated))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(repeated.where(F.col("n") * HOT > total).select("digest", F.lit(True).alias("often")))  # fewer than HOT rows
    kind = docs.schema[id_col].dataType.simpleString()
    media = named.mapInArrow(lambda b: _store(b, filled.value), f"doc_id {kind}, n_bytes long, form binary, wanted array<struct<at: int, digest: binary>>")
    media = written(media.withColumn("key", F.monotonically_increasing_id()), "media")
    chunks = named.select("text").mapInArrow(lambda b: _shared_chunks(b, filled.value), "same binary, payload binary")
    chunks = chunks.groupBy("same").agg(F.first("payload").alias("payload")).join(often, F.col("same") == F.col("digest"), "left")
    return media, written(chunks.select("same", "payload", F.coalesce("often", F.lit(False)).alias("often")), "chunks")


def feature(payload: bytes) -> str:
    """Mean, deviation, zero share and mean step of the 8-bit samples."""
    x = np.frombuffer(payload, np.uint8)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.3f};std={x.std():.3f};zero={(x == 0).mean():.4f};step={step:.3f}"


def _read(batches):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
    for batch in batches:
        out = []
        for form, fetched in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            form = form.as_py()
            payload = payload_of(form, {f["at"]: f["payload"] for f in fetched or ()})
            digest, own = hashlib.sha256(payload).hexdigest(), hashlib.sha256(form).hexdigest()
            out.append((len(payload), digest, zlib.crc32(payload[-UNIT:]), len(form), own, feature(payload), int.from_bytes(form[4:8], "little")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", *names])


def read_features(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every media value read back from its chunks, with its digests and features; media_bytes and media_sha256 are of the
    stored form as it is read.

    A value without shared chunks is read where it stands; only lists with shared chunks are joined with the chunk table,
    and only these values are shuffled. A chunk that very many values share is looked up by broadcast.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    fetched_type = "array<struct<at: int, payload: binary>>"
    whole = media.where("size(wanted) = 0").select("doc_id", "n_bytes", "form", F.lit(None).cast(fetched_type).alias("fetched"))
    split = media.where("size(wanted) > 0")
    wanted = split.select("key", F.explode("wanted").alias("w")).select("key", "w.at", "w.digest")
    often = [r["same"] for r in chunks.where("often").select("same").collect()]
    found = lookup(wanted, "digest", chunks.select("same", "payload"), "same", often)
    found = found.groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("at", "payload")).cast(fetched_type).alias("fetched"))
    joined = split.join(found, F.col("key") == F.col("of"), "left").select("doc_id", "n_bytes", "form", "fetched")
    return whole.mapInArrow(_read, schema).unionByName(joined.mapInArrow(_read, schema))
