import corpus_pipeline
import pyarrow as pa
import pytest
from geomill.llm.shared import BATCH_BYTES
from pyspark.sql import functions as F

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_hand_texts_to_python_in_small_batches(spark, name, monkeypatch):
    """24 MB of texts in one split were one batch before."""
    seen = {}

    class Started(Exception):
        pass

    def stop(*_, **__):
        seen["bytes"] = spark.conf.get(KEY)
        raise Started

    for module, function in ((corpus_pipeline.quality, "importance_sample"), (corpus_pipeline.neardup, "keep_one"), (corpus_pipeline.substring, "dedup_substrings"), (corpus_pipeline.decontam, "drop_contaminated"), (corpus_pipeline.bpe, "encode_column")):
        monkeypatch.setattr(module, function, stop)
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
    before = spark.conf.get(KEY)
    try:
        with pytest.raises(Started):
            dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
        assert seen["bytes"] == str(BATCH_BYTES)
        found = docs.mapInArrow(sizes, "n long, bytes long").agg(F.sum("n"), F.max("bytes")).first()
        assert found[0] == 6000 and found[1] <= 2 * BATCH_BYTES
    finally:
        spark.conf.set(KEY, before)
