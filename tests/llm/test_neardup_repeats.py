"""Candidates of texts that repeat a passage."""

import random

import pyarrow as pa

from geomill.llm import neardup


def test_repeats_inside_a_text_leave_candidates():
    rng, missed = random.Random(9), 0
    for n in range(200):
        base = [f"p{n}w{rng.random()}" for _ in range(104)]
        texts = [" ".join(base), " ".join(base[:54] * 1000 + base[54:])]  # half of the shingles 1000 times in one text
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts)], names=["id", "text"])
        x, y = next(neardup._sketches(iter([batch]), neardup.SHINGLE, neardup.REGISTERS, neardup.ROWS)).column("bands").to_pylist()
        missed += not set(x) & set(y)
    assert missed == 0


def test_near_copies_with_repeats_equal_brute_force(spark):
    rng, data = random.Random(10), []
    for n in range(60):
        base = [f"p{n}w{rng.random()}" for _ in range(104)]
        data += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(base[:54] * 100 + base[54:]))]
    found = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == neardup.brute_force(data)
