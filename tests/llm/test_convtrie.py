"""The prefix trie of conversations against a plain trie."""

import random
import re
import zlib
from hashlib import sha256

import pytest
from geomill.llm import convtrie
from geomill.llm.queries import table


def _plain(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    nodes, ends = {}, {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        seq = own.get(base, [])[:h] + mine[h:]
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    n_children, leaves, saved = {}, {}, {}
    for key in nodes:
        if key:
            n_children[key[:-1]] = n_children.get(key[:-1], 0) + 1
    for key, members in nodes.items():
        value = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            saved[key[:d]] = saved.get(key[:d], 0) + value
            leaves[key[:d]] = leaves.get(key[:d], 0) + (key not in n_children)
    return sorted(
        (min(m), len(key), min(nodes[key[:-1]]) if key else None, len(m), n_children.get(key, 0), leaves[key], saved[key], sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest())
        for key, m in nodes.items()
    )


def _check(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], "conv_id long, turn long, role string, text string, head string, depth int").repartition(partitions)
    got = convtrie.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    key = lambda r: (r[0], r[1], r[2] is not None, *r[3:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_plain(rows), key=key)


def _drawn(seed, convs, turns, words):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        c = c if draw.random() < 0.9 else -c
        for t in range(draw.randrange(1, turns)):
            text = draw.choice(words) if draw.random() < 0.9 else None
            rows.append((c, draw.choice((t, t, t, None)), draw.choice(("user", "assistant", None)), text))
    return rows


@pytest.mark.parametrize("container, band", [(5000, 256), (3, 256), (4, 2), (1, 3)])
def test_like_a_plain_trie(spark, monkeypatch, container, band):
    monkeypatch.setattr(convtrie, "CONTAINER", container)
    monkeypatch.setattr(convtrie, "BAND", band)
    monkeypatch.setattr(convtrie, "BLOCK", 3)
    monkeypatch.setattr(convtrie, "JOINED", 2)
    _check(spark, _drawn(container, 160, 6, ["a b", "c", "", " d\te\nf g ", "a b c"]))


def test_copies_prefixes_and_turnless(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "CONTAINER", 10)
    rows = [(c, t, "user", f"same {t}") for c in range(300, 700) for t in range(5)]  # many copies
    rows += [(c, 0, "user", "only one") for c in range(10_001, 10_019)]  # some lose their one turn and have no base
    rows += [(5, 0, "user", "x")] * 4 + [(None, 0, "user", "nobody's"), (20, None, None, None), (25, 1, "assistant", "y z")]
    rows += [(9_223_372_036_854_775_807, 0, "user", "far"), (-9_223_372_036_854_775_808, 1, "user", "far")]
    _check(spark, rows)


def test_long_conversation_and_text(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "BAND", 64)
    monkeypatch.setattr(convtrie, "BLOCK", 100)
    rows = [(c, t, "user", f"t{t % 7} {'w ' * (t % 3)}") for c in (40, 41, 1000) for t in range(700)] + [(2, 0, "user", "long " * 200_000), (3, 0, "user", "long " * 200_000)]
    _check(spark, rows)


def test_empty(spark):
    assert convtrie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert convtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")).collect() == []


def test_given_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert sorted(map(str, map(tuple, convtrie.prefix_trie(df).collect()))) == sorted(map(str, _plain(rows)))
