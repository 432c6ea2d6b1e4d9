"""What the driver gets of the feature counts."""

import numpy as np
import pytest

from geomill.llm import quality


@pytest.fixture
def tables(spark):
    word = lambda k, j: f"w{k}x{j}"  # noqa: E731  stands in one document only
    texts = [" ".join([*(word(k, j) for j in range(60)), *("fine", "##", "vile")[k % 3 : k % 3 + 1] * 2]) for k in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 != 1), int(k % 3 == 2)) for k in range(0, 240, 2)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_only_features_that_can_speak_reach_the_driver(spark, tables, monkeypatch):
    rows, plain = [], type(tables[0]).toArrow
    monkeypatch.setattr(type(tables[0]), "toArrow", lambda self: (rows.append((t := plain(self)).num_rows), t)[1])
    model = quality.fit(*tables, buckets=1 << 14)
    assert sum(rows) < 1000  # there are about 20 000 features
    assert (model.ratios != 0).any()


def test_the_model_is_that_of_all_counts(spark, tables):
    docs, labels = tables
    named = docs.withColumnRenamed("doc_id", "id")
    counts, _ = quality.label_counts(named, labels, buckets=1 << 14)
    whole = quality.Model(counts[0], counts)
    counted, _ = quality.label_table(named, labels, buckets=1 << 14)
    model = quality._fitted(counted.withColumn("good", counted["n0"]), 1, 1 << 14)
    assert (whole.ratios != 0).any() and np.array_equal(whole.ratios, model.ratios)
    assert np.array_equal(whole.shares, model.shares)
