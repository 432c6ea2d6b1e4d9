"""Media rows with null and repeated ids, repeated rows, a chunk that very many rows share, and stored forms."""

import random

import pytest

from geomill.llm import media


def test_null_and_repeated_ids(spark):
    rng = random.Random(3)
    shared = " ".join(str(rng.random()) for _ in range(400))
    texts = [None, "", "a", shared, shared + " tail", *(f"{shared} {k}" for k in range(60))]
    data = [(rng.choice([None, 1, 2]), t, b"x", 5) for t in texts] + [(1, "a", b"x", 5)] * 3
    frame = spark.createDataFrame(data, "doc_id long, text string, form binary, key int").repartition(4)
    stored, chunks = media.store(frame)
    out = media.read_features(stored, chunks).collect()
    size = lambda t: len((t or "").encode())
    none_last = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id or 0, r.n_bytes) for r in out)) == sorted((i or 0, size(t)) for i, t, _, _ in data)
    by_text = {}
    for r in out:
        by_text.setdefault(r.payload_sha256, set()).add((r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.n_chunks))
    assert len(by_text) == len({t or "" for t in texts}) and all(len(x) == 1 for x in by_text.values())
    assert stored.selectExpr("sum(octet_length(form))").first()[0] < sum(size(t) for t in texts) / 2


def test_a_broken_chunk_is_not_read():
    form = media.form_of([b"abc", b"de"], [__import__("hashlib").sha256(x).digest() for x in (b"abc", b"de")], [False, True])
    assert media.payload_of(form, {1: b"de"}) == b"abcde"
    for bad, far in ((form, {1: b"dX"}), (form[:-1] + b"X", {1: b"de"}), (b"none" + form[4:], {1: b"de"})):
        with pytest.raises(ValueError):
            media.payload_of(bad, far)
