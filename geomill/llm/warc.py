"""WARC archives: written record by record with an index, read back by coalesced byte ranges.

Each record is a gzip member of its own. Writing emits the index first: file, offset, length, URL, digest. Readers take
the index rows they want, sort them by file and offset, join neighbouring ranges and read each range once.
Archives live in the folder that the caller names (the queries use the shared one), opened on the executors with pyarrow's
file systems. Only files that the index names count, so a task that is run again leaves no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT, lookup, shared_dir, written

FILE_BYTES, RANGE_BYTES, GAP_BYTES, LEVEL = 512 << 20, 4 << 20, 64 << 10, 1
#: Bytes of records that a task reads.
TASK_BYTES = 64 << 20
INDEX = "page_id long, url string, record_type string, digest string, file string, offset long, length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, when: str = "1970-01-01T00:00:00Z") -> tuple[bytes, str]:
    """One WARC/1.1 record and its payload digest. A revisit has no block of its own."""
    digest = base32_sha1(payload)
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n", digest


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at this place: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _open_dir(folder: str):
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def _write(batches, folder: str):
    system, path = _open_dir(folder)
    stream, name, at = None, "", 0
    try:
        for batch in batches:
            rows = {k: [] for k in ("record_type", "digest", "file", "offset", "length")}
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None or at >= FILE_BYTES:
                    if stream is not None:
                        stream.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = system.open_output_stream(f"{path}/{name}", compression=None)
                raw, digest = record(page_id, url, (html or "").encode(), refers_to)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                stream.write(member)
                for k, v in zip(rows, ("response" if refers_to is None else "revisit", digest, name, at, len(member)), strict=True):
                    rows[k].append(v)
                at += len(member)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64() if k in ("offset", "length") else pa.string()) for k, v in rows.items())], names=["page_id", "url", *rows])
    finally:
        if stream is not None:
            stream.close()


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for every row of `pages` and returns the written index (page_id, url, record_type, digest, file, offset, length).

    The payload is the html in UTF-8; null: empty. Of rows whose payloads are equal and have at least `min_revisit` bytes,
    the smallest page_id is a response and the others are revisits of it. Null ids are always responses. A repeated
    page_id with an equal payload is a response again (it can't refer to itself); with another payload it is a row of its
    own, so a revisit's target is the response with its id and its digest. Null url: empty. Extra columns are not read.
    """
    q = lambda c: F.col(f"`{c}`")
    rows = pages.select(q(id_col).cast("long").alias("page_id"), q(url_col).cast("string").alias("url"), F.coalesce(q(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sum", F.sha1(F.col("html").cast("binary")))
    keyed = written(rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= min_revisit)).select("page_id", "sum"), "payload-sums")
    first = keyed.groupBy(F.col("sum").alias("same")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    first = written(first, "responses")
    often = first.where(F.col("n") * HOT > F.lit(keyed.count())).select("same").collect()
    met = lookup(keyed, "sum", first, "same", [r[0] for r in often]).where("page_id <> refers_to")
    again = met.select(F.col("page_id").alias("again"), F.col("sum").alias("again_sum"), "refers_to").distinct()
    # a repeated page_id may have several payloads, so a row is matched by its payload as well; null ids match none
    marked = rows.join(again, (rows.page_id == again.again) & (rows["sum"] == again.again_sum), "left").select("page_id", "url", "html", "refers_to")
    return written(marked.mapInArrow(lambda b: _write(b, folder), INDEX), "warc-index")


def _read_ranges(batches, folder: str):
    system, path = pafs.FileSystem.from_uri(folder)
    handles: dict[str, pa.NativeFile] = {}
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    try:
        for batch in batches:
            rows = list(zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            first = 0
            while first < len(rows):
                file, start, size = rows[first]
                last, end = first + 1, start + size
                while last < len(rows) and rows[last][0] == file and start <= rows[last][1] <= end + GAP_BYTES and max(end, rows[last][1] + rows[last][2]) - start <= RANGE_BYTES:
                    end = max(end, rows[last][1] + rows[last][2])
                    last += 1
                if file not in handles:
                    for h in handles.values():
                        h.close()
                    handles = {file: system.open_input_file(f"{path}/{file}")}
                block = handles[file].read_at(end - start, start)
                out = []
                for _, offset, length in rows[first:last]:
                    fields, payload = parse_record(zlib.decompress(block[offset - start : offset - start + length], 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
                    number = lambda f: None if f not in fields or fields[f] == "<urn:page:null>" else int(fields[f][10:-1])  # noqa: B023, E731
                    out.append((number("WARC-Record-ID"), fields["WARC-Target-URI"], kind, digest, int(fields["X-Payload-Length"]), number("WARC-Refers-To"), payload))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
                first = last
    finally:
        for h in handles.values():
            h.close()


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that `index` (all of it, or a selection) names: page_id, url, record_type, payload_digest, payload_bytes,
    refers_to and, unless `payloads` is false, payload. Every response is checked against its digest.

    Tasks are counted by the bytes of the selected records, not of the index: about TASK_BYTES each."""
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    zone = F.floor(F.col("offset") / F.lit(RANGE_BYTES))
    dealt = index.select("file", "offset", "length", zone.alias("zone")).repartition(tasks, "file", "zone").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    if payloads:
        return dealt.mapInArrow(lambda b: _read_ranges(b, folder), schema)
    bare = schema.removesuffix(", payload binary")
    return dealt.mapInArrow(lambda b: (x.select(x.schema.names[:-1]) for x in _read_ranges(b, folder)), bare)


def archive_folder(spark) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
