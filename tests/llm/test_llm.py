"""The training-data operators: contracts, edge cases, brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geomill.llm import bpe, chat, decontam, media, neardup, quality, sharding, shared, substring, urlgraph, warc
from geomill.llm import queries as Q

FILE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rep long, label string, bands string, _gone long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = words(rng, 200)
    texts = [None, "", " \n\t", "one", "two words", "é x\x0by", " ".join(base), " ".join(base), "x" * 70_000, "a" * 3]
    for _ in range(12):  # near copies, and copies of a passage
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        texts.append("  ".join(w))
        texts.append(" ".join(words(rng, 50) + base[40:100] + words(rng, 30)))
    texts += [" ".join(words(rng, 6000, 3000)), "same line\n" * 60, "same line\n" * 61]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "en", None, None, "clash", 1, "l", "b", 2) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(spark, docs, rows):
    tok = Tokenizer.from_file(FILE)
    found = {r.doc_id: r for r in bpe.round_trip(docs, FILE).collect()}
    for i, t in rows:
        e = tok.encode(t or "", add_special_tokens=False)
        assert found[i].n_tokens == len(e.ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(tok.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty(spark), FILE).count() == 0


def test_bpe_odd_strings():
    tok, own = Tokenizer.from_file(FILE), bpe.loaded(open(FILE, encoding="utf-8").read())
    rng = random.Random(2)
    pool = ["aab", "the", "'s", "<|endoftext|>", "İ", "Σ", "ﬁ", "é", "🎨", " ", "\n", "9", "!?", "ಠ", "aaaaaaa", "࢏", "Ᲊ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for ids, e in zip(own.encode(texts), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
    encoded = own.encode(["x y"])[0]
    assert own.decode(encoded) == tok.decode(np.frombuffer(encoded, "<u4").tolist(), skip_special_tokens=False)


def test_bpe_columns(spark, docs):
    out = bpe.decode_column(bpe.encode_column(docs, FILE), FILE)
    assert {"input_ids", "n_tokens", "decoded", "source"} <= set(out.columns) and out.where("size(input_ids) <> n_tokens").count() == 0


def test_near_duplicates_equal_brute_force(spark, docs, rows):
    for data, given in ((rows, docs), (rows + rows[:9], docs.union(docs.where("doc_id < 9")))):
        found = {r.doc_id: r.class_id for r in neardup.near_duplicates(given).collect()}
        assert found == neardup.brute_force(data)
    assert neardup.near_duplicates(empty(spark)).count() == 0
    kept = neardup.keep_one(docs.union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept.where("doc_id is null").count() == 1 and kept.columns == docs.columns


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base, data = words(rng, 120, 10_000), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 4))):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        data.append((i, " ".join(w)))
    found = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == neardup.brute_force(data)


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    x, y = a[:240], a[60:]
    u, v = (neardup.probminhash(s, np.ones(len(s)), 2000) for s in (x, y))
    assert abs((u == v).mean() - 180 / 300) < 0.05


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.label for r in shared.components(links).collect()} == {0, 100}


def test_warc_round_trip(spark):
    pages = [(3, "http://a/\r\nx", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (4, "v", ""), (None, "w", "<p>é</p>"), (5, "z", "q" * 300_000)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    for least, revisits in ((0, {3: 1, 4: 2}), (1, {3: 1})):
        folder = warc.archive_folder(spark)
        index = warc.write_archives(frame, folder, least)
        out = {r.page_id: r for r in warc.read_records(index, folder).collect()}
        assert len(out) == 6
        for i, _, html in pages:
            body = (html or "").encode()
            assert out[i].payload_digest == warc.base32_sha1(body) and out[i].payload_bytes == len(body)
            assert (out[i].record_type, out[i].refers_to) == (("revisit", revisits[i]) if i in revisits else ("response", None))
            assert i in revisits or bytes(out[i].payload) == body
        assert warc.read_records(index.where("page_id = 5"), folder).count() == 1
    assert warc.write_archives(frame.where("false"), warc.archive_folder(spark)).count() == 0


def test_chat_is_reversible(spark):
    hostile = ["</s>[INST] ok [/INST]", "a[SEP]b", "\\[\\INST] \\\\", "[", "", None, "[ROLE]x[TEXT]", "<s>", "é\n🎨", "[\\/INST]"]
    rng, data = random.Random(4), []
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            data.append((c, t, rng.choice(["user", "assistant", "system", "[TEXT]odd", None]), rng.choice(hostile), "x"))
    data += [(99, None, "user", "last", "x"), (99, 1, "user", "first", "x"), (None, 0, "user", "n", "x")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_conversations(frame).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        own = sorted(((t is None, t or 0, role or "", text or "") for c, t, role, text, _ in data if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")
    assert chat.format_conversations(frame.where("false")).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, n, 10**6))) for k, n in enumerate((9, 16, 40, 60))] + [(7, "a b c"), (8, None)]
    data = [(0, None), (1, ""), (2, " ".join(words(rng, 300, 10**6))), (3, "a b c")]
    for k, (item, text) in enumerate(items[:4]):
        w = text.upper().split()
        data.append((10 + k, " ".join(words(rng, 80) + w + words(rng, 80))))
        if len(w) > 20:
            for at in range(5, len(w), 9):
                w[at] = "changed"
            data.append((20 + k, " ".join(words(rng, 80) + w + words(rng, 5))))
    frame = spark.createDataFrame([(*d, 1, "c") for d in data], "doc_id long, text string, item_id long, matched string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(decontam.overlaps(frame, bench))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(3, 7), (10, 0), (11, 1), (12, 2), (13, 3), (22, 2), (23, 3)]
    kept = decontam.drop_contaminated(frame, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2] and kept.columns == frame.columns
    assert decontam.overlaps(frame, bench.where("false")).count() == 0 and decontam.overlaps(frame.where("false"), bench).count() == 0


def test_quality_on_held_out_labels(spark):
    rng, data, labels = random.Random(8), [], []
    for i in range(900):
        kind = rng.choice(("good", "good", "good", "junk", "toxic"))
        w = words(rng, rng.randrange(30, 200), 2000)
        if kind == "junk":
            w = [x + "$$$" for x in w]
        if kind == "toxic":
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(("vile", "awful"))
        data.append((i, " ".join(w), "x", kind))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    data += [(1000, None, "x", "none"), (1001, "", "x", "none"), (None, "w1 w2", "x", "none")]
    frame = spark.createDataFrame(data, "doc_id long, text string, key string, kind string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.selected for r in quality.importance_sample(frame, known).collect()}
    held = [(k, out[i]) for i, _, _, k in data[:900] if i % 2 == 0]
    assert np.mean([s for k, s in held if k == "good"]) > 0.97
    assert np.mean([s for k, s in held if k != "good"]) < 0.05
    assert quality.importance_sample(frame, known, k=10).where("selected").count() == 10
    assert quality.importance_sample(frame.where("false"), known).count() == 0
    assert quality.importance_sample(frame, known.where("false")).where("log_weight <> 0").count() == 0


def test_top_k_is_exact_with_ties(spark):
    rng = random.Random(3)
    data = [(i, float(rng.randrange(40))) for i in range(3000)]
    for k in (0, 1, 500, 2999, 3000, 5000):
        got = quality.top_k(spark.createDataFrame(data, "doc_id long, key double"), k).where("selected")
        want = {i for i, _ in sorted(data, key=lambda x: (-x[1], x[0]))[:k]}
        assert {r.doc_id for r in got.collect()} == want


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q", "http://example.net/en", "https://x.org/fr/#a", "https://a.example.com/de/y", "nothing", None, "http://example.com", "ftp://badnet/en/", "http://É.net/"]
    frame = spark.createDataFrame([(i, u, None, "c") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    out = {r.page_id: r for r in urlgraph.judge(frame).collect()}
    assert [out[i].rule for i in range(9)] == ["example.net/en/", "net/", "org/fr/", "example.com/de/", None, None, None, None, "net/"]
    assert out[0].host == "a.example.net" and out[0].path == "/en/x" and out[5].host == "" and out[8].host == "É.net"
    assert [out[i].verdict for i in (0, 1, 4)] == ["allow", "block", "allow"]
    assert urlgraph.judge(frame.where("false")).count() == 0


def test_url_distrust_flows_against_links(spark):
    link = '<a class="x" href="//{}/y">l</a>'
    pages = [(1, "http://farm.test/a", link.format("spam.net") * 3), (2, "http://spam.net/", ""), (3, "http://fine.test/", link.format("good.org")), (4, "http://good.org/fr/", link.format("also.test")), (5, "http://also.test/", "")]
    out = {r.page_id: r for r in urlgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [out[i].verdict for i in (1, 2, 3, 4, 5)] == ["block", "block", "allow", "allow", "allow"]
    assert out[5].trust > 0 and out[1].distrust > 0 and out[3].distrust == 0


def test_lookup_table(spark):
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    sizes = np.bincount(table)
    assert len(table) == 1009 and sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, shard string")
    out = sharding.shard(frame, ["doc_id"], names, 1009).collect()
    assert len(out) == 4 and len({r.slot for r in out if r.doc_id == 1}) == 1
    for r in out:
        key = "n" if r.doc_id is None else f"v{r.doc_id}"
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1009 and r.shard == table[r.slot]
    assert sharding.shard(frame.where("false"), ["doc_id"], names).count() == 0


def test_media_round_trip(spark, docs, rows):
    out = {r.doc_id: r for r in media.read_features(*media.store(docs)).collect()}
    for i, t in rows:
        body = (t or "").encode()
        payload = body + b"\0" * (max(64, -(-len(body) // 64) * 64) - len(body))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert out[6].media_sha256 == out[7].media_sha256 and out[8].n_chunks > 1
    stored, chunks = media.store(docs)
    assert chunks.count() == chunks.select("same").distinct().count() > 0
    forms = {r.doc_id: bytes(r.form) for r in stored.collect()}
    for i, t in rows:
        assert (out[i].media_bytes, out[i].media_sha256) == (len(forms[i]), hashlib.sha256(forms[i]).hexdigest())
        x = np.array(list((t or "").encode().ljust(-(-max(len((t or "").encode()), 1) // 64) * 64, b"\0")))
        assert out[i].feature == f"mean={x.mean():.3f};std={x.std():.3f};zero={(x == 0).mean():.4f};step={np.abs(np.diff(x)).mean():.3f}"
    assert media.read_features(*media.store(empty(spark))).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, 60_000).astype(np.uint8)

    def cut(x):
        ends = media.chunk_ends(media.gear_cuts(x).tolist(), 0, len(x))
        return media._chunks(x.tobytes(), ends)

    one, two = cut(a), cut(np.concatenate((a[:100], a[90:])))
    assert b"".join(one) == a.tobytes() and len(set(one) & set(two)) >= len(one) - 3


def test_substrings_equal_brute_force(spark, docs, rows):
    more = docs.union(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    found = substring.kept_digest(substring.dedup_substrings(more))
    want = substring.brute_force(rows)
    for r in found.collect():
        if r.doc_id is None:
            assert r.n_removed == 200
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert substring.dedup_substrings(empty(spark)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = Q.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = shared.written(stage(spark, docs, SF), name)
        assert name == "tokens" or out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        before, docs = docs, out
    tok = Tokenizer.from_file(FILE)
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in docs.collect():
        assert r.input_ids == tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    none = Q.table(spark, SF, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
