"""Contaminated pairs against plain loops over all diagonals and all stretches: items of 1 to 20 tokens, one word changed anywhere."""

import random
from math import ceil

from geomill.llm import decontam


def by_loops(docs, items):
    found = set()
    for i, text in docs:
        t = (text or "").lower().split()
        for j, item in items:
            w = (item or "").lower().split()
            n = len(w)
            masks = ["1" * n] if n < 8 else list(decontam.MASKS) + (list(decontam.SHORT_MASKS) if n < 13 else [])
            need = n if n < 8 else min(13, ceil(0.75 * n))
            for s in range(-n, len(t)) if n else ():
                same = [p >= 0 and p < len(t) and t[p] == w[p - s] for p in range(s, s + n)]
                seeded = any(all(same[k + x] for x, bit in enumerate(m) if bit == "1") and s + k >= 0 and s + k + len(m) <= len(t) for m in masks for k in range(n - len(m) + 1))
                if seeded and any(sum(same[a:b]) >= need and sum(same[a:b]) >= 0.75 * (b - a) for a in range(n) for b in range(a + 1, n + 1)):
                    found.add((i, j))
                    break
    return found


def test_every_single_substitution(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in range(1, 21)] + [(30, ""), (31, None), (None, "w1 w2 w3"), (5, " ".join(word() for _ in range(9)))]
    items += items[3:5]
    docs = [(None, "w1 w2 w3"), (None, items[11][1]), (0, None), (1, " ")]
    for n, text in items[:20]:
        w = text.split()
        for at in range(n):
            docs.append((1000 * n + at, " ".join([word(), *w[:at], "other", *w[at + 1 :], word()]).upper()))
        docs.append((100 + n, f"{word()} {text} {word()}"))
        docs.append((200 + n, " ".join(w[2:])))  # at the edge of a text
        docs.append((300 + n, " ".join(w[: n // 2] + w[n // 2 + 1 :])))  # a word left out
    docs += docs[-4:]
    docs.append((7, " ".join(word() for _ in range(20_000)) + " " + items[19][1]))
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, item_id int, row string").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    rows = decontam.overlaps(frame, bench).collect()
    assert len(rows) == len(set(rows))
    named = [(i, t) for i, t in items if i is not None]
    want = by_loops([d for d in docs if d[0] != 7], named)
    assert {(r.doc_id, r.item_id) for r in rows if r.doc_id != 7} == want
    assert (7, 20) in {(r.doc_id, r.item_id) for r in rows} and (None, 12) in want
