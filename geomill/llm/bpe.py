"""BPE encoding and decoding by prefix-sharing trie traversal.

A BPE encoding of a string ends in one last token, and what stands before it is the encoding of the shorter prefix. So the
last token of every prefix describes all encodings: at a trie node it is the longest vocabulary entry that ends there and
is compatible with the last token of the prefix before it (the pair must not merge across its border). The distinct words
of a slice of documents go into a trie; a depth-first walk carries the last tokens down, so a shared prefix is encoded once.

Encodings are kept by word in a bounded table that the tasks of one Python worker share; documents are never shuffled.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from . import spans
from .shared import text_of

KEPT_WORDS, KEPT_PAIRS = 100_000, 200_000  # encodings (twice: new and old) and compatible pairs that a task keeps
END = "</w>"
TOKEN, FINAL, CHILDREN = 0, 1, 2


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


#: Code points whose kind, case and composition have stood since Unicode 3.0, so every library agrees on them. A text with any
#: other one is normalised and cut by the tokenizers library itself, whatever Unicode version it was built with.
SETTLED = (
    r"\u0000-\u0220\u0222-\u0233\u0391-\u03A1\u03A3-\u03A9\u03B1-\u03C9\u0410-\u044F\u0401\u0451\u2010-\u2027\u2030-\u2046\u20AC\u2190-\u2199"
    r"\u3001-\u3003\u3008-\u3011\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3"
)
unsettled = re.compile(f"[^{SETTLED}]").search


class WordBpe:
    """A tokenizers file of kind BPE with a word-end suffix, NFC, white space dropped and lower case."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): n for n, (a, b) in enumerate(merges)}
        self.parts = {self.vocab[a + b]: (self.vocab[a], self.vocab[b], n) for n, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split["pattern"]["Regex"]).findall
        cut = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        normalize = Tokenizer.from_str(content).normalizer.normalize_str
        self.library_words = lambda text: [word for word, _ in cut.pre_tokenize_str(normalize(text))]
        self.letters = byte_letters()
        self.size = {i: len(t.removesuffix(END)) for t, i in self.vocab.items()}
        self.names = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in {**self.vocab, **self.special}.items():
            self.names[i] = t
        self.trie: list = [None, None, {}]
        for t, i in self.vocab.items():
            node = self.trie
            for c in t.removesuffix(END):
                node = node[CHILDREN].setdefault(c, [None, None, {}])
            node[FINAL if t.endswith(END) and t != END else TOKEN] = i
        self.own = [array("I", [i]).tobytes() for i in range(len(self.names))]
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge while `token` is built, each with the rank at which it is merged into the next."""
        out, rank = [], float("inf")
        while True:
            out.append((token, rank))
            if token not in self.parts:
                return out[::-1]
            rank = self.parts[token][2]
            token = self.parts[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging keeps a border between a and b: no pair across it comes before the merges on its two sides."""
        found = self.pairs.get((a, b))
        if found is None:
            xs = self.right.get(a) or self.right.setdefault(a, self.edge(a, 1))
            ys = self.left.get(b) or self.left.setdefault(b, self.edge(b, 0))
            i = j = 0
            while True:
                (x, up_x), (y, up_y) = xs[i], ys[j]
                r = self.rank.get((x, y))
                if r is not None and r < up_x and r <= up_y:
                    found = False
                    break
                if i == len(xs) - 1 and j == len(ys) - 1:
                    found = True
                    break
                if up_x <= up_y:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not known yet."""
        collecting = gc.isenabled()
        gc.disable()  # a trie has no cycles; walking it again and again for some costs a quarter of the time
        try:
            self._walk(words)
        finally:
            if collecting:
                gc.enable()

    def _walk(self, words: set[str]) -> None:
        root: dict = {}
        letters = self.letters
        for word in words:
            node = root
            for b in word.encode():
                c = letters[b]
                node = node.get(c) or node.setdefault(c, {})
            node[""] = word
        # depth first: the last tokens of the prefixes on the way down, and the vocabulary entries that may still grow
        last: list[int] = [0]
        todo = [(child, 1, c, ()) for c, child in root.items() if c]
        if "" in root:
            self.known[""] = b""
        compatible, pairs, known, first = self.compatible, self.pairs, self.known, self.trie[CHILDREN]
        while todo:
            node, depth, letter, open_at = todo.pop()
            grown = [(start, children[letter]) for start, (_, _, children) in open_at if letter in children]
            grown.append((depth - 1, first[letter]))
            del last[depth:]
            word = node.pop("", None)
            if word is not None:
                known[word] = self._chain(last, grown)
            if node:
                for start, entry in grown:  # the longest first
                    token = entry[TOKEN]
                    if token is not None:
                        ok = start == 0 or pairs.get((last[start], token))
                        if ok or (ok is None and compatible(last[start], token)):
                            last.append(token)
                            break
                depth += 1
                for c, child in node.items():
                    todo.append((child, depth, c, grown))

    def _chain(self, last: list[int], grown: list) -> bytes:
        for start, entry in grown:
            token = entry[FINAL]
            if token is not None and (start == 0 or self.compatible(last[start], token)):
                if not start:
                    return self.own[token]
                out = [token]
                while start:
                    out.append(last[start])
                    start -= self.size[last[start]]
                return array("I", out[::-1]).tobytes()
        raise ValueError("no token at a word's end")

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.words_of(text.lower())
        if unsettled(text):
            return self.library_words(text)
        text = unicodedata.normalize("NFC", text)
        return self.words_of(text.lower() if "Σ" not in text else "".join(c.lower() for c in text))

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens that a text spells out."""
        if not any(s in text for s in self.special):
            return self.split(text)
        out: list[str | int] = []
        for k, part in enumerate(self.special_at.split(text)):
            out.extend([self.special[part]] if k % 2 else self.split(part))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.pieces(t) for t in texts]
        every = set().union(*cut)
        if len(self.known) > KEPT_WORDS:  # words that are still in use move on, the others go with the next turn
            self.before, self.known = self.known, {}
        known, before, fresh = self.known, self.before, set()
        for w in every:
            if w not in known:
                if w in before:
                    known[w] = before[w]
                else:
                    fresh.add(w)
        numbers = {x for x in fresh if isinstance(x, int)}
        self.learn(fresh - numbers)
        for x in numbers:
            self.known[x] = array("I", [x]).tobytes()
        find = self.known.__getitem__
        return [b"".join(map(find, words)) for words in cut]

    def forget(self) -> None:
        """Lets go of what was kept: a Python worker goes on to other stages, where this would only fill its memory."""
        self.known, self.before = {}, {}
        self.pairs.clear()

    def decode(self, ids: bytes) -> str:
        """Tokens in their own spelling, with spaces between: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


_LOADED: dict[str, WordBpe] = {}


def loaded(content: str) -> WordBpe:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(content)
    return _LOADED[key]


def over_slices(batches, load: Callable, row: Callable[[object, bytes], tuple], kinds: list[pa.DataType], names: list[str], text_at: str):
    """Rows of `row` beside the columns of a batch other than `text_at`, the texts' own; `load` gives the model."""
    model = load()
    try:
        for batch in batches:
            at = batch.schema.get_field_index(text_at)
            offsets, _ = spans.buffers(batch.column(at))
            for first, last in spans.slices(offsets, 4 * spans.SLICE_BYTES):
                part = batch.slice(first, last - first)
                texts = part.column(at).to_pylist()
                rows = [row(model, ids) for ids in model.encode([t or "" for t in texts])]
                kept = [part.column(i) for i in range(part.num_columns) if i != at]
                labels = [n for n in part.schema.names if n != text_at]
                yield pa.RecordBatch.from_arrays(kept + [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=labels + names)
    finally:
        model.forget()


def unused(name: str, columns: list[str]) -> str:
    """`name`, with as many underscores before it as it takes not to be one of `columns`; Spark's names ignore case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def run(docs: DataFrame, text_col: str, content: Broadcast, load: Callable, fields: list[T.StructField], kinds, row, keep_text: bool) -> DataFrame:
    """`docs` with the columns `fields` that `row` makes of a model (`load` of the vocabulary file's content) and the ids of a text."""
    names = [f.name for f in fields]
    others, text_at = [c for c in docs.columns if c not in names and (keep_text or c != text_col)], unused("_text", docs.columns)
    frame = docs.select(*(F.col(f"`{c}`") for c in others), text_of(f"`{text_col}`").alias(text_at))
    schema = T.StructType([*frame.select(*(f"`{c}`" for c in others)).schema.fields, *fields])
    return frame.mapInArrow(lambda b: over_slices(b, lambda: load(content.value), row, kinds, names, text_at), schema)


def vocabulary(spark: SparkSession, tokenizer_file: str) -> Broadcast:
    """A vocabulary file, read once by the driver."""
    with open(tokenizer_file, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(docs: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """`docs` with input_ids (array<int>) and n_tokens; null text: empty. A column of one of these names is replaced."""
    fields = [T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    return run(docs, text_col, vocabulary(docs.sparkSession, tokenizer_file), loaded, fields, [pa.list_(pa.int32()), pa.int64()], lambda m, ids: (np.frombuffer(ids, np.int32), len(ids) // 4), True)


def decode_column(encoded: DataFrame, tokenizer_file: str, ids_col: str = "input_ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` with the decoded text of an array<int> column; null ids: empty text. A column `out_col` is replaced."""
    content = vocabulary(encoded.sparkSession, tokenizer_file)
    others, ids_at = [c for c in encoded.columns if c != out_col], unused("_ids", encoded.columns)
    ids = F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>"))
    frame = encoded.select(*(F.col(f"`{c}`") for c in others), ids.alias(ids_at))
    schema = T.StructType([*(encoded.schema[c] for c in others), T.StructField(out_col, T.StringType())])

    def spell(batches):
        model = loaded(content.value)
        for b in batches:
            texts = [" ".join(map(model.names.__getitem__, x)) for x in b.column(ids_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*others, out_col])

    return frame.mapInArrow(spell, schema)


def round_trip(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, then decoded from the ids.

    Null text: empty, with no tokens. Repeated rows, null ids and texts of any length are ordinary rows; other columns are
    not read. A string of a special token in a text becomes that token.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def row(model: WordBpe, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()

    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return run(frame, "text", vocabulary(docs.sparkSession, tokenizer_file), loaded, fields, [pa.int64(), pa.string(), pa.string()], row, False)
