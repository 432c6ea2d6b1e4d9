"""Log weights against plain loops; exact draws with ties, repeated rows and null ids."""

import math
import random

import numpy as np

from geomill.llm import quality, spans


def features(text, buckets):
    """The set of (family, bucket) of a text, word by word."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text])], names=["id", "text"])
    out = set()
    for _, _, families in quality._features(batch, buckets):
        for base, (values, _) in enumerate(families):
            out |= {base * buckets + int(v) for v in values}
    return out


def test_log_weights_equal_plain_loops(spark):
    rng, buckets = random.Random(4), 1 << 10
    word = lambda: f"w{rng.randrange(80)}"
    kinds = [rng.choice((0, 0, 0, 1, 2)) for _ in range(300)]
    texts = [" ".join([word() for _ in range(rng.randrange(8, 40))] + [["fine", "##", "vile"][k]] * rng.randrange(1, 3)) for k in kinds]
    texts += [texts[7]] * 40  # copies count once
    kinds += [kinds[7]] * 40
    labels = [(i, int(kinds[i] != 1), int(kinds[i] == 2)) for i in range(0, 300, 2)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.log_weight for r in quality.importance_sample(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=buckets).collect()}

    sets = [features(t, buckets) for t in texts]
    def shares(weights):  # weights: document -> part of it
        n, count = sum(weights.values()), {}
        for i, w in weights.items():
            for f in sets[i]:
                count[f] = count.get(f, 0) + w
        return n, count

    def ratios(part, target):
        (n, count), (m, good), out = part, target, {}
        for f in set(count) | set(good):
            a, b = count.get(f, 0), good.get(f, 0)
            ratio = math.log((a + 0.5) / (n + 1)) - math.log((b + 0.5) / (m + 1))
            both = (a + b + 1) / (n + m + 2)
            spread = math.sqrt(both * (1 - both) * (1 / (n + 1) + 1 / (m + 1)))
            if abs(a / (n + 1e-9) - b / (m + 1e-9)) >= 4 * spread and (a >= max(4, 0.005 * n) or b >= max(4, 0.005 * m)) and abs(ratio) >= 2:
                out[f] = ratio
        return out

    def terms(i, tables, share):
        return [sum(t.get(f, 0) for f in sets[i]) + math.log(max(s, 1e-12)) for t, s in zip(tables, share)]

    labelled = {k: {i: 1 for i, _, _ in labels if kinds[i] == k} for k in range(3)}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t, []).append(i)
    target = shares(labelled[0])
    tables = [ratios(shares(labelled[k]), target) for k in range(3)]
    share = [len(labelled[k]) / len(labels) for k in range(3)]
    parts = [{} for _ in range(3)]
    for i, t in enumerate(texts):
        z = terms(i, tables, share)
        each = [math.exp(x - max(z)) for x in z]
        for k in range(3):
            parts[k][i] = round(each[k] / sum(each) * 1024 / len(groups[t])) / 1024
    raw = [shares(p) for p in parts]
    tables, share = [ratios(r, target) for r in raw], [r[0] / sum(x[0] for x in raw) for r in raw]
    for i in range(len(texts)):
        z = terms(i, tables, share)
        want = -(max(z) + math.log(sum(math.exp(x - max(z)) for x in z)))
        assert abs(out[i] - want) < 2e-3 * max(1, abs(want)), (i, out[i], want)  # ratios are kept in single precision
    assert min(out[i] for i in range(300) if kinds[i] == 0) > max(out[i] for i in range(300) if kinds[i] == 2)


def test_top_k_takes_exactly_k(spark):
    rng = random.Random(1)
    data = [(rng.choice([None, 1, 2, -(2**62), 2**62, 2**53 + 1]), float(rng.choice([0.1, 0.1, 7, -1e300, 1e-300, 0.1 + 2**-50]))) for _ in range(400)]
    frame = spark.createDataFrame(data, "doc_id long, key double").repartition(3)
    order = sorted(data, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    for k in (1, 2, 57, 200, 399):
        got = [(r.doc_id, r.key) for r in quality.top_k(frame, k, bins=4).where("selected").collect()]
        assert sorted(got, key=str) == sorted(order[:k], key=str)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b"), (None, "c d"), (-1, "a b"), (5, "same"), (5, "same"), (5, "same")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.importance_sample(frame, none).collect()
    assert len({r.key for r in out}) == 4 and {r.log_weight for r in out} == {0.0}
    for k in range(7):
        assert quality.importance_sample(frame, none, k=k).where("selected").count() == k


def test_first_runs_equal_loops():
    texts = ["", "one", "a b c d e f g h", "a b c d e f g h i j", "x " * 50]
    import pyarrow as pa

    found = quality._first_runs(pa.array(texts))
    for r, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        h = spans.Words(np.array([0, len(data)]), data).hashes()
        runs = spans.window_hashes(h, min(8, len(h))) if len(h) else np.zeros(1, np.uint64)
        assert found[r, 0] == spans.mix(runs).min()


def test_conflicting_labels_and_repeated_ids_have_one_result(spark):
    docs = [(k, f"plain words about {k} and more of them {'vile' if k % 3 == 2 else 'fine'}") for k in range(60)] + [(4, "another text"), (4, "a third text")]
    labels = [(k, 1, int(k % 3 == 2)) for k in range(60)] + [(4, 1, 1), (5, 0, 0), (6, None, 1), (None, 1, 1), (7, 1, None)]
    found = []
    for seed in range(3):
        random.Random(seed).shuffle(docs)
        random.Random(seed).shuffle(labels)
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(1 + seed)
        named = frame.withColumnRenamed("doc_id", "id")
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3 - seed)
        counts, share = quality.label_counts(named, known, buckets=1 << 8)
        found.append((counts.tolist(), share.tolist()))
    assert found[0] == found[1] == found[2]
    assert found[0][1] == [39, 0, 21]  # 20 and 4, which has a toxic label too; of 5's labels the toxic one holds
