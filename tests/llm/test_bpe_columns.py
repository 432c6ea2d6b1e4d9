"""Columns of the user's own that bear the operator's working names, and special tokens of another spelling."""

import json

import numpy as np
import public_tokenizers
from geomill.llm import bpe
from tokenizers import Tokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_own_columns_stay(spark):
    rows = [(1, "two words", "mine", [7], "old"), (None, None, "mine", None, "old"), (1, "two words", "mine", [7], "old"), (2, "", None, [], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _ids array<int>, decoded string")
    encoded = bpe.encode_column(docs, FILE)
    assert encoded.columns == [*docs.columns, "input_ids", "n_tokens"]
    out = bpe.decode_column(encoded, FILE)
    assert out.columns == ["doc_id", "text", "_text", "_ids", "input_ids", "n_tokens", "decoded"]
    tok = Tokenizer.from_file(FILE)
    found = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(found) == 4
    for r, (i, text, mine, ids, _) in zip(found, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert (r.doc_id, r.text, r._text, r._ids) == (i, text, mine, ids)
        e = tok.encode(text or "", add_special_tokens=False)
        assert r.input_ids == e.ids and r.decoded == tok.decode(e.ids, skip_special_tokens=False)
    assert bpe.decode_column(bpe.encode_column(docs.limit(0), FILE), FILE).count() == 0


def test_special_tokens_of_another_spelling():
    spec = json.load(open(FILE, encoding="utf-8"))
    unused = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    spec["added_tokens"].append({**spec["added_tokens"][-1], "id": unused, "content": "[SEP]"})
    text = json.dumps(spec)
    tok, own = Tokenizer.from_str(text), bpe.loaded(text)
    for t in ("a[SEP]b", "[SEP]", "x [SEP] <|endoftext|>y", "sep ]"):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
