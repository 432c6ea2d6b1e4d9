"""Passages with gaps, and short items with a changed word."""

import numpy as np

from geomill.llm import decontam


def test_fullest_stretch_equals_brute_force():
    rng = np.random.default_rng(4)
    for k in range(400):
        same = rng.random(rng.integers(1, 24)) < (0.5, 0.7, 0.8)[k % 3]
        runs = [(i, j) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 4 * same[i:j].sum() >= 3 * (j - i)]
        want = max(((int(same[i:j].sum()), i - j, -i) for i, j in runs), default=(0, 0, 0))
        a, b = decontam.fullest_stretch(same, 0.75)
        assert (int(same[a:b].sum()), a - b, -a) == want
        found = decontam.passages(same, 4, 0.75)
        assert bool(found) == (want[0] >= 4)
        assert all(same[i:j].sum() >= max(4, 0.75 * (j - i)) for i, j in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_passages_with_gaps_are_found(spark):
    item = [f"t{k}" for k in range(28)]
    long = [f"l{k}" for k in range(92)]
    broken = lambda w, gaps: " ".join("other" if any(g <= k < g + 4 for g in gaps) else x for k, x in enumerate(w))
    data = [(1, "a b " + broken(item, [12]) + " c"), (2, broken(long, range(12, 92, 16))), (3, broken(item, [5, 14, 22]))]
    twice = long[:13] + [f"x{k}" for k in range(66)] + long[79:]  # two passages on one diagonal
    frame = spark.createDataFrame([*data, (4, " ".join(twice))], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(long))], "item_id long, text string")
    out = sorted((r.doc_id, r.item_id, r.doc_first, r.doc_last, r.matched) for r in decontam.overlaps(frame, bench).collect())
    assert out == [(1, 0, 2, 30, 24), (2, 1, 0, 92, 72), (4, 1, 0, 13, 13), (4, 1, 79, 92, 13)]


def test_short_items_with_a_changed_word(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(8, 18)}
    data = [(100 * n + at, "so " + " ".join("new" if k == at else x for k, x in enumerate(w)) + " end") for n, w in items.items() for at in range(n)]
    data.append((1, " ".join(f"i12w{k}" if k < 8 else "no" for k in range(12))))  # 8 of 12 tokens
    frame = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.matched) for r in decontam.contaminated(decontam.overlaps(frame, bench)).collect()}
    need = {n: min(13, -(-3 * n // 4)) for n in items}
    assert {(d, n) for d, n, _ in found} == {(d, d // 100) for d, _ in data if d > 1}
    assert all(m >= need[n] for _, n, m in found)
