"""Exact search by grams against a plain search, and numbers of exported rows."""

import random
import time

import pytest
from geomill.operators import filters as fl
from geomill.operators import tiles as tl
from geomill.operators.numbering import number_rows
from pyspark.sql import functions as F


def _features(spark, texts):
    rows = [(f"f{k:04d}", "c", t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, collection_id string, note string").withColumn("properties", F.to_json(F.struct("note"))).drop("note")


@pytest.mark.parametrize("written", [False, True])
def test_like_a_plain_search(spark, tmp_path, written):
    draw = random.Random(2)
    words = ["Car-4711:88", "same.same", "ÄÖÜß", "abcabcab", "x" * 9, "12345678", " "]
    texts = ["".join(draw.choice(words) for _ in range(draw.randrange(8))) for _ in range(300)] + ["", None, "short", "\U0001f642car-4711:88\U0001f642"]
    df = _features(spark, texts)
    tokens = ["car-4711:88", "abcabcabc", "CABCABCA", "11:88same", "xxxxxxxxxxxx", "12345678", "f0003xyz", "f0004", "absent-token", "8812345678"]
    index = fl.build_text_index(df, str(tmp_path / "index")) if written else None
    found = fl.exact_search(df, spark.createDataFrame([(t,) for t in tokens], "token string"), [], index=index)
    want = sorted((t, f"f{k:04d}") for t in tokens if len(t) >= 8 for k, x in enumerate(texts) if x and t.lower() in x.lower())
    assert sorted((r.token, r.id) for r in found.collect()) == want and len(want) > 100
    assert {r.tier for r in found.collect()} == {3}
    none = fl.exact_search(df.limit(0), spark.createDataFrame([("absent-token",)], "token string"), ["k"])
    assert none.count() == 0


def test_grams_are_linear_in_the_text(spark):
    draw = random.Random(1)
    text = "".join(draw.choice("abcdefghijkl ") for _ in range(2_000_000))
    began = time.time()
    assert 1_990_000 < len(fl.gram_hashes(text)) <= 2_000_000 - 7 and time.time() - began < 5
    assert len(fl.gram_hashes("1234567")) == 0 and len(fl.gram_hashes("12345678")) == 1 and len(fl.gram_hashes("aaaaaaaaaaaa")) == 1


def test_numbers_of_ids_that_begin_alike(spark):
    rows = [(f"018f-{draw:09d}", "c", 1.0 if draw % 5 else None, '{"id": 1, "id_source": 2}') for draw in random.Random(3).sample(range(10**6), 500)]
    df = spark.createDataFrame(rows, "id string, collection_id string, minx double, properties string").withColumns({c: F.lit(0.0) for c in ("miny", "maxx", "maxy")}).repartition(5)
    kept = sorted(r[0] for r in rows if r[2] is not None)
    out = tl.export_rows(df).collect()
    assert {r.id: r.number for r in out} == {k: n + 1 for n, k in enumerate(kept)}
    assert {r.properties for r in out} == {'{"id_source_1":"1","id_source":"2"}'}
    assert tuple(tl.export_counts(df).first()) == (len(kept), 500 - len(kept))


def test_numbers_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), (None, 4), ("a", 5)], "k string, v int").repartition(3)
    out = sorted(tuple(r) for r in number_rows(df, [F.col("k").asc_nulls_last(), "v"]).select("number", "v").collect())
    assert out == [(0, 3), (1, 5), (2, 2), (3, 1), (4, 4)]
    assert number_rows(df.limit(0), ["k"]).count() == 0


def test_index_has_a_row_for_a_word_of_a_text(spark, tmp_path):
    word = "".join(random.Random(4).choice("abcdefgh.:-") for _ in range(100))
    df = _features(spark, [f"{word} short {word.upper()} {k}" for k in range(50)])
    index = fl.build_text_index(df, str(tmp_path / "index"))
    assert spark.read.parquet(f"{index}/postings").count() == 50
    assert spark.read.parquet(f"{index}/grams").count() == len(fl.gram_hashes(word))
    tokens = spark.createDataFrame([(word.lstrip(".:-")[:60],), (word[-9:].lstrip(".:-") + " short",), (word.lstrip(".:-")[:20] + "\n",)], "token string")
    assert {(r.token, r.tier) for r in fl.exact_search(df, tokens, [], index=index).collect()} == {(word.lstrip(".:-")[:60], 3)}
    assert fl.exact_search(df, tokens, [], index=index).count() == 50
