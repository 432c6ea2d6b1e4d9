"""SentencePiece encoding and decoding with a table of distinct chunks.

White space is a marker within the text, and no piece of the vocabulary has a marker after another character. So a text is
cut before every run of markers: what is merged never crosses a cut, and each distinct chunk (a marked word) is segmented
once. The ids of a text are those of its chunks, joined back by position, between the begin and the end id.

The table of chunks is bounded and kept by the tasks of one Python worker; documents are never shuffled. A table of the whole
corpus would have to be joined with every word of it, which is more data than the texts themselves.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from .bpe import run, unused

MARK = "▁"
KEPT_CHUNKS, LONGEST_KEPT = 150_000, 64  # chunks (twice: new and old) that a task keeps, and their characters at most
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one-by-one", _one_byte)


class PieceBpe:
    """A sentencepiece model of kind BPE with byte fallback and a marker before the first word, without normalisation."""

    def __init__(self, content: bytes):
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(content)
        model = SentencePieceProcessor(model_proto=content)
        rules, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("only models that keep their texts as they are")
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and without pieces of the user's own")
        if any(MARK in p.piece.lstrip(MARK) for p in spec.pieces):
            raise ValueError("a piece crosses a white space marker")
        self.begin, self.end = array("I", [model.bos_id()]).tobytes(), array("I", [model.eos_id()]).tobytes()
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.cost = {p.piece: -p.score for p in spec.pieces if p.type == NORMAL}
        self.of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.spelling = [p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"" for p in spec.pieces]
        self.marked = {i for p, i in self.ids.items() if p.startswith(MARK)}
        for b, i in self.of_byte.items():
            self.spelling[i] = bytes([b])
        self.spelling[spec.trainer_spec.unk_id] = spec.trainer_spec.unk_surface.encode()
        self.silent = np.array([not x for x in self.spelling])
        self.chunks_of = re.compile(" +[^ ]*").findall
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk, in which spaces stand for markers: the cheapest pair of neighbours merges first, of equal ones the left."""
        part = list(chunk.replace(" ", MARK))
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        cost, todo = self.cost, []
        for at in range(len(part) - 1):
            both = part[at] + part[at + 1]
            if both in cost:
                todo.append((cost[both], at, both))
        heapq.heapify(todo)
        while todo:
            _, at, both = heapq.heappop(todo)
            right = after[at]
            if not part[at] or right >= len(part) or len(part[at]) + len(part[right]) != len(both):
                continue  # one of the two has grown or is gone
            part[at], part[right] = both, ""
            after[at] = after[right]
            if after[at] < len(part):
                before[after[at]] = at
                more = both + part[after[at]]
                if more in cost:
                    heapq.heappush(todo, (cost[more], at, more))
            if before[at] >= 0:
                more = part[before[at]] + both
                if more in cost:
                    heapq.heappush(todo, (cost[more], before[at], more))
        out, ids, of_byte = [], self.ids, self.of_byte
        for piece in part:
            if piece:
                token = ids.get(piece)
                if token is None:
                    out.extend(map(of_byte.__getitem__, piece.encode()))
                else:
                    out.append(token)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the begin and the end id; an empty text has only these two."""
        if len(self.known) > KEPT_CHUNKS:  # chunks that are still in use move on, the others go with the next turn
            self.before, self.known = self.known, {}
        cut = [self.chunks_of(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        known, before, long = self.known, self.before, {}
        for chunk in set().union(*cut):
            if chunk not in known:
                found = before.get(chunk) or array("I", self.segment(chunk)).tobytes()
                (known if len(chunk) <= LONGEST_KEPT else long)[chunk] = found
        find = known.__getitem__ if not long else lambda c: known.get(c) or long[c]
        return [b"".join((self.begin, *map(find, chunks), self.end)) for chunks in cut]

    def forget(self) -> None:
        """Lets go of what was kept: a Python worker goes on to other stages, where this would only fill its memory."""
        self.known, self.before = {}, {}

    def decode(self, ids: bytes) -> str:
        """The pieces' spelling without the marker before the first word; bytes that form no character become U+FFFD each."""
        tokens = np.frombuffer(ids, "<u4")
        cuts = np.flatnonzero(self.silent[tokens]).tolist()  # what control pieces part never forms a character together
        runs = [tokens[a:b].tolist() for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(tokens)], strict=True)]
        text = "".join(b"".join(map(self.spelling.__getitem__, run)).decode("utf-8", "one-by-one") for run in runs)
        first = next((run[0] for run in runs if run), None)
        return text[1:] if first in self.marked else text


_LOADED: dict[bytes, PieceBpe] = {}


def loaded(content: bytes) -> PieceBpe:
    key = hashlib.sha256(content).digest()
    if key not in _LOADED:
        _LOADED[key] = PieceBpe(content)
    return _LOADED[key]


def vocabulary(spark: SparkSession, model_file: str) -> Broadcast:
    """A model file, read once by the driver."""
    with open(model_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(docs: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """`docs` with input_ids (array<int>, begin and end ids included) and n_tokens; null text: empty. A column of one of these names is replaced."""
    fields = [T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    row = lambda m, ids: (np.frombuffer(ids, np.int32), len(ids) // 4)
    return run(docs, text_col, vocabulary(docs.sparkSession, model_file), loaded, fields, [pa.list_(pa.int32()), pa.int64()], row, True)


def decode_column(encoded: DataFrame, model_file: str, ids_col: str = "input_ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` with the decoded text of an array<int> column; null ids: empty text. A column `out_col` is replaced."""
    content = vocabulary(encoded.sparkSession, model_file)
    others, ids_at = [c for c in encoded.columns if c != out_col], unused("_ids", encoded.columns)
    ids = F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>"))
    frame = encoded.select(*(F.col(f"`{c}`") for c in others), ids.alias(ids_at))
    schema = T.StructType([*(encoded.schema[c] for c in others), T.StructField(out_col, T.StringType())])

    def spell(batches):
        model = loaded(content.value)
        for b in batches:
            texts = [model.decode(array("I", x).tobytes()) for x in b.column(ids_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*others, out_col])

    return frame.mapInArrow(spell, schema)


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded with begin and end ids, then decoded from the ids.

    Null text: empty, with the begin and the end id alone. Repeated rows, null ids and texts of any length, with or without
    white space, are ordinary rows; other columns are not read. Strings of control pieces in a text are ordinary text. The
    marker's own character in a text counts as a space.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def row(model: PieceBpe, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()

    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return run(frame, "text", vocabulary(docs.sparkSession, model_file), loaded, fields, [pa.int64(), pa.string(), pa.string()], row, False)
