"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from geomill.llm import pieces
from sentencepiece import SentencePieceProcessor

FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "▁", "a▁b", "  two  spaces ", "\n\t\r", "x" * 3000, "ab" * 2000 + " " + " " * 300 + "end", "<s> </s> <unk> <0x0A>", "\x00\x01", "Ωmega ﬁ ① Å Å", "한국어 日本語 中文字", "🙂👩‍👩‍👧 ok", "﻿bom", " nbsp　wide", "1234567", "''''----", "é" * 99, "\U0010ffff�"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def model():
    return pieces.loaded(open(FILE, "rb").read())


def _check(library, model, texts):
    for t, ids in zip(texts, model.encode(texts), strict=True):
        want = library.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert model.decode(ids) == library.decode(want), repr(t)


def test_odd_and_random_texts(library, model):
    _check(library, model, ODD)
    draw = random.Random(5)
    letters = "  ▁\n\taeiourstnlAE.,'-019é▁ßЖ中한🙂\x00"
    _check(library, model, ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(20_000)])
    model.forget()
    _check(library, model, ["".join(chr(draw.choice((draw.randrange(0x250), draw.randrange(0x3100), draw.randrange(0xE000, 0x11000)))) for _ in range(30)) for _ in range(3000)])


def test_every_code_point(library, model):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{chr(c)} {chr(c)}a" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for k in range(0, len(texts), 512):
        _check(library, model, texts[k : k + 512])
    model.forget()


def test_decoding_any_ids(library, model):
    draw = random.Random(7)
    for _ in range(3000):
        ids = [draw.randrange(draw.choice((3, 259, 400, 32000))) for _ in range(draw.randrange(1, 12))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_table_is_bounded(library, model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 50)
    model.forget()
    for k in range(40):
        _check(library, model, [" ".join(f"w{k}x{n}" for n in range(60)) + " common " + "z" * 100])
        assert len(model.known) <= 50 + 70 and len(model.before) <= 50 + 70
    model.forget()


def test_rows(spark, library):
    rows = [(k, t, "own", "mine") for k, t in enumerate(ODD)] + [(None, None, None, None), (3, ODD[4], None, None), (3, ODD[4], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _text string")
    found = sorted(map(tuple, pieces.round_trip(docs, FILE).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert found == sorted(want, key=str)
    out = pieces.decode_column(pieces.encode_column(docs, FILE), FILE)
    assert out.columns == ["doc_id", "text", "_text", "input_ids", "n_tokens", "decoded"]
    for r in out.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.input_ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
    assert pieces.round_trip(docs.limit(0), FILE).count() == 0 and pieces.decode_column(pieces.encode_column(docs.limit(0), FILE), FILE).count() == 0
