"""Repetitive texts and items: few rows, the same finds as loops over all diagonals; recall at lower identities."""

import random
import time

import numpy as np
from test_decontam_brute_force import by_loops

from geomill.llm import decontam


def test_progressions_hold_all_places():
    rng = np.random.default_rng(2)
    for _ in range(300):
        group = np.sort(rng.integers(0, 4, 40))
        place = np.zeros(40, np.int64)
        for g in range(4):
            n = int((group == g).sum())
            place[group == g] = np.cumsum(rng.choice((1, 2, 2, 2, 2, 2, 7), n)) if n else 0
        first, step, n = decontam.progressions(group, place)
        held = {(int(group[k]), int(place[k] + x * s)) for k, s, m in zip(first, step, n, strict=True) for x in range(m)}
        assert held == set(zip(group.tolist(), place.tolist(), strict=True))
        assert all((s == 0) == (m == 1) for s, m in zip(step, n, strict=True))
    assert [x.tolist() for x in decontam.progressions(np.zeros(50, int), np.arange(50))] == [[0], [1], [50]]


def test_repetitive_texts_equal_loops(spark):
    rng = random.Random(5)
    phrase = lambda n: [f"p{rng.randrange(3)}" for _ in range(n)]
    docs, items = [], [(None, "p0")]
    for k in range(12):
        own = phrase(rng.randrange(1, 6))
        docs.append((k, " ".join(phrase(5) + own * 15 + ["z"] + own * 4)))
        items.append((k, " ".join(own * rng.randrange(2, 12) + phrase(3))))
        line = phrase(9)
        docs.append((100 + k, " ".join((line + ["a"]) * 7)))
        items.append((100 + k, " ".join((line + ["b", "c"]) * 5)))
    docs += [docs[0], (None, docs[1][1]), (200, ""), (201, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.overlaps(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == by_loops(docs, items[1:])
    texts = dict(docs[:-4])
    for r in rows:
        assert r.stretch_first <= r.doc_first < r.doc_last <= r.stretch_last <= len((texts.get(r.doc_id) or docs[1][1]).split())
    spans = sorted((r.doc_id, r.item_id, r.stretch_first, r.stretch_last) for r in rows if r.doc_id is not None)
    assert all(a[:2] != b[:2] or a[3] <= b[2] for a, b in zip(spans, spans[1:]))


def test_one_word_again_and_again(spark):
    frame = spark.createDataFrame([(1, "a " * 20_000), (2, "b c " * 9_000), (3, "c d " * 12)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a " * 400), (8, "c b " * 200)], "item_id long, text string")
    decontam.overlaps(frame.limit(1), bench).collect()  # warms up
    began = time.time()
    rows = decontam.overlaps(frame, bench).collect()
    assert time.time() - began < 30
    got = sorted((r.doc_id, r.item_id, r.doc_first, r.doc_last, r.item_first, r.matched, r.stretch_first, r.stretch_last) for r in rows)
    assert got == [(1, 7, 0, 400, 0, 400, 0, 20_000), (2, 8, 1, 401, 0, 400, 0, 18_000)]


def test_hot_hashes_beyond_the_broadcast_are_dealt(spark, monkeypatch):
    docs = [(k, f"x{k} " + " ".join(f"w{j}" for j in range(30))) for k in range(60)]
    items = [(k, " ".join(f"w{j}" for j in range(20)) + f" y{k}") for k in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontam.overlaps(frame, bench).collect())
    monkeypatch.setattr(decontam, "FEW_ROWS", 0)
    assert sorted(decontam.overlaps(frame, bench).collect()) == want
    assert len(want) == 300


def test_recall_by_identity(spark):
    rng = random.Random(11)
    items, docs, planted = [], [], {}
    for n in (24, 40, 80):
        for identity in (0.75, 0.8, 0.85, 0.9):
            for _ in range(60):
                k = len(items)
                words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
                items.append((k, " ".join(words)))
                for at in rng.sample(range(n), n - -(-n * identity // 1).__int__()):
                    words[at] = "new"
                docs.append((k, "before it " + " ".join(words) + " after it"))
                planted.setdefault((n, identity), set()).add(k)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id for r in decontam.overlaps(frame, bench).collect() if r.doc_id == r.item_id}
    recall = {key: len(ids & found) / len(ids) for key, ids in planted.items()}
    print(recall)
    assert all(r >= 0.9 for r in recall.values())
