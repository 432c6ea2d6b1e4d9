"""Substring removal over many blocks: null and repeated ids, repeated rows, clashing columns, against plain loops."""

import random
import re

from geomill.llm import spans, substring

SCHEMA = "doc_id long, text string, id string, text2 string, block int, rest string, n_words int, _id long, _text string"


def by_loops(rows, width=13):
    """(n_words, n_removed, kept) for each row; a null id is larger than all others."""
    ids = [float("inf") if i is None else i for i, _ in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = {p for k in range(len(w) - width + 1) if least[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_many_blocks_equal_plain_loops(spark):
    rng = random.Random(11)
    word = lambda n, size=300: [f"w{rng.randrange(size)}" for _ in range(n)]
    shared = [word(40) for _ in range(4)]
    rows = [(None, None), (None, " ".join(shared[0])), (None, " ".join(shared[0])), (7, ""), (7, " ".join(shared[1])), (7, " ".join(shared[1]))]
    for i in range(60):
        parts = word(rng.randrange(30)) + rng.choice(shared)[: rng.randrange(12, 41)] + word(rng.randrange(30)) + rng.choice(shared)
        rows.append((rng.choice([i, i % 5, None]), "\n".join(parts)))
    rows += rows[-5:]
    rows.append((3, " ".join(word(9000) + shared[2])))
    given = spark.createDataFrame([(i, t, "u", "v", 1, "r", -1, 5, "x") for i, t in rows], SCHEMA).repartition(5)
    for size in (2_000, 50_000, 1 << 30):
        out = substring.dedup_substrings(given, block_bytes=size, bucket_bytes=size)
        assert out.columns == ["doc_id", "id", "text2", "block", "rest", "_id", "_text", "n_words", "n_removed", "kept_text", "removed"]
        found = out.collect()
        key = lambda r: tuple((x is None, x) for x in r)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found), key=key)
        want = sorted(((i, *x) for (i, _), x in zip(rows, by_loops(rows), strict=True)), key=key)
        assert got == want
        assert {(r.id, r.text2, r.block, r.rest, r["_id"], r["_text"]) for r in found} == {("u", "v", 1, "r", 5, "x")}
        assert all(sum(x.last - x.first for x in r.removed) == r.n_removed for r in found)


def test_structured_words_do_not_collide():
    """Words of two letters in an order that makes polynomials modulo 2**64 vanish."""
    import numpy as np

    turn = lambda n: "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    a = turn(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    h = spans.Words(np.array([0, len(data)]), data).digests()
    assert h[0, 0] != h[1, 0] and h[0, 1] != h[1, 1]
