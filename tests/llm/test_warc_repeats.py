"""Repeated page_ids, with equal and different payloads."""

from geomill.llm import warc


def test_repeated_page_ids(spark):
    a, b, c = "payload a", "payload b", "payload c"
    data = [(1, a), (5, a), (5, b), (2, b), (7, b), (7, a), (9, c), (9, c), (3, None), (None, a), (None, a)]
    frame = spark.createDataFrame([(i, "http://x/", h) for i, h in data], "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    out = warc.read_records(warc.write_archives(frame, folder), folder).collect()
    digest = {x: warc.base32_sha1((x or "").encode()) for x in (a, b, c, None)}
    first = {a: 1, b: 2, c: 9, None: 3}
    target = lambda i, h: None if i is None or i == first[h] else first[h]
    want = [(i or 0, digest[h], target(i, h) or 0, "" if target(i, h) else h or "") for i, h in data]
    assert sorted((r.page_id or 0, r.payload_digest, r.refers_to or 0, r.payload.decode()) for r in out) == sorted(want)
    kept = {(r.page_id, r.payload_digest) for r in out if r.record_type == "response"}
    assert all((r.refers_to, r.payload_digest) in kept for r in out if r.record_type == "revisit")
