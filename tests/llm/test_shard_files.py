"""Placement against a filling written anew, and shards read back."""

import hashlib

from geomill.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot double, shard_name long, n int"


def filled(names, size):
    """Shards take turns; each claims the first place of its own order that is still free."""
    number = lambda salt, name: int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")
    orders = [[(number("offset", n) + k * (1 + number("skip", n) % (size - 1))) % size for k in range(size)] for n in names]
    owner, turn = {}, 0
    while len(owner) < size:
        k = turn % len(names)
        owner[next(x for x in orders[k] if x not in owner)] = k
        turn += 1
    return [owner[x] for x in range(size)]


def test_table_equals_a_plain_filling():
    names = [f"s{k}" for k in range(7)]
    assert sharding.lookup_table(names, 211) == filled(names, 211)
    assert all(sorted(o) == list(range(211)) for o in [[(3 + k * 5) % 211 for k in range(211)]])
    before, after = filled(names, 211), filled(names[:-1], 211)
    assert sum(a != b for a, b in zip(before, after, strict=True) if a != 6) <= 211 // 4


def test_shards_are_read_back_whole(spark, tmp_path):
    long = "lang é " * 200_000
    rows = [(None, "x", "a", 1.0, 2, 1), (None, None, "a", 1.0, 2, 1), (5, "", None, None, None, None), (5, "", None, None, None, None), (6, long, "b", 0.5, 1, 9)]
    rows += [(k, f"t{k}", "c", 0.0, 0, k) for k in range(300)]
    names, size = [f"s{k}" for k in range(5)], 101
    given = spark.createDataFrame(rows, SCHEMA)
    back = sharding.write_shards(given, f"file://{tmp_path}/a", ["doc_id"], names, size, rows_per_file=20)
    assert back.columns == ["doc_id", "text", "n", "slot", "shard_name", "shard"]
    table, want = filled(names, size), []
    for i, t, _, _, _, n in rows:
        slot = int(hashlib.md5(("n" if i is None else f"v{i}").encode()).hexdigest()[:15], 16) % size
        want.append((i, t, n, slot, names[table[slot]], table[slot]))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in back.collect()), key=key) == sorted(want, key=key)
    assert sharding.write_shards(given.limit(0), f"file://{tmp_path}/b", ["doc_id"], names, size).collect() == []


def test_tasks_grow_with_a_shards_bytes(spark, tmp_path):
    rows = [(k, "y" * 100, "hot", None, None, k) for k in range(400)] + [(k, None, str(k), None, None, k) for k in range(100)]
    given = spark.createDataFrame(rows, SCHEMA)
    names = [f"s{k}" for k in range(5)]
    placed = sharding.shard(given, ["text"], names, 101)
    hot = placed.where("n = 399").first().shard
    assert sharding.writers(placed, 5, 5_000)[hot] >= 400 * 100 // 5_000 and sum(sharding.writers(placed, 5)) == 5
    back = sharding.write_shards(given, f"file://{tmp_path}/c", ["text"], names, 101, task_bytes=5_000)
    assert sorted(r.n for r in back.collect()) == sorted(r[5] for r in rows)
    files = [f for f in back.inputFiles() if f"shard={hot}/" in f]
    assert len(files) > 3
