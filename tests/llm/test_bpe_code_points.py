"""Every code point, alone, before a letter, before a symbol and between letters, encodes and decodes as the library does."""

import hashlib

import numpy as np
import public_tokenizers
from geomill.llm import bpe
from tokenizers import Tokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")
EACH = 96


def test_every_code_point():
    tok = Tokenizer.from_file(FILE)
    own = bpe.loaded(open(FILE, encoding="utf-8").read())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for first in range(0, len(points), EACH * 512):
        part = points[first : first + EACH * 512]
        texts = [" ".join(f"{chr(c)} {chr(c)}a {chr(c)}! x{chr(c)}y" for c in part[k : k + EACH]) for k in range(0, len(part), EACH)]
        for text, e, ids in zip(texts, tok.encode_batch(texts, add_special_tokens=False), own.encode(texts), strict=True):
            if np.frombuffer(ids, "<u4").tolist() != e.ids:
                wrong.append(hex(ord(text[0])))
        own.forget()
    assert not wrong


def test_single_code_points_below_16_bits():
    """One text for each code point, so that texts of settled code points only are cut by the operator's own pattern."""
    tok = Tokenizer.from_file(FILE)
    own = bpe.loaded(open(FILE, encoding="utf-8").read())
    texts = [f"{chr(c)} {chr(c)}é A{chr(c)}'s {chr(c)}Σ {chr(c)}7" for c in [*range(0x3100), *range(0xAC00, 0xD800, 7)]]
    for text, e, ids in zip(texts, tok.encode_batch(texts, add_special_tokens=False), own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, hex(ord(text[0]))
        assert hashlib.sha256(own.decode(ids).encode()).digest() == hashlib.sha256(tok.decode(e.ids, skip_special_tokens=False).encode()).digest()


def test_settled_code_points_alone():
    tok = Tokenizer.from_file(FILE)
    own = bpe.loaded(open(FILE, encoding="utf-8").read())
    settled = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not bpe.unsettled(chr(c))]
    assert len(settled) > 30_000
    texts = [f"{chr(c)} {chr(c)}a {chr(c)}! Q{chr(c)}y {chr(c)}É 3{chr(c)}" for c in settled]
    for text, e, ids in zip(texts, tok.encode_batch(texts, add_special_tokens=False), own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, hex(ord(text[0]))
