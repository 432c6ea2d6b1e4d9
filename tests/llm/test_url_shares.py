"""Verdicts of hosts that share a blocked host with many others, and converged ranks."""

import numpy as np

from geomill.llm import urlgraph

LINK = '<a href="//{}/y">l</a>'


def test_many_linkers_of_one_blocked_host(spark):
    pages = [(0, "http://good.org/fr/", LINK.format("fine.test")), (1, "http://fine.test/", LINK.format("spam2.net") + LINK.format("good.org") * 9)]
    pages += [(2, "http://mixed.test/", LINK.format("spam10.net") + LINK.format("fine.test") * 9), (3, "http://second.test/", LINK.format("f1000x7.test"))]
    for k in (2, 10, 1000):
        pages.append((10 * k, f"http://spam{k}.net/", ""))
        pages += [(100_000 * k + j, f"http://f{k}x{j}.test/", LINK.format(f"spam{k}.net")) for j in range(k)]
    out = {r.page_id: r for r in urlgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [out[i].verdict for i in (0, 1, 2, 3)] == ["allow", "allow", "allow", "block"]
    assert all(r.verdict == "block" for i, r in out.items() if i >= 20)
    assert all(abs(out[i].distrust - 0.85) < 1e-3 for i in (100_000 * 2, 100_000 * 10, 100_000 * 1000)) and abs(out[3].distrust - 0.85**2) < 1e-3


def test_three_pages_in_circles_stop(spark):
    """Hosts that only link to each other, and one of them to a blocked host: rounds are bounded by the damping."""
    pages = [(1, "http://a.test/", LINK.format("b.test") * 9 + LINK.format("bad.net")), (2, "http://b.test/", LINK.format("a.test")), (3, "http://bad.net/", "<a " * 20_000)]
    out = {r.page_id: r for r in urlgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    a = 0.85 * 0.1 / (1 - 0.85 * 0.9 * 0.85)
    assert abs(out[1].distrust - a) < 1e-3 and abs(out[2].distrust - 0.85 * a) < 1e-3 and out[1].verdict == "block"


def test_hubs_give_the_same_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = [(f"h{a}", f"h{b}", 1 + int(a) % 3) for a, b in {(int(x), int(y)) for x, y in rng.integers(0, 30, (150, 2)) if x != y}] + [(f"x{k}", "h1", 1) for k in range(200)]
    frame = spark.createDataFrame(edges, "src string, dst string, w long")
    seeds, ends = (spark.createDataFrame([(x,) for x in names], "host string") for names in (("h1", "h2"), ("h3",)))
    plain = {r.host: r.share for r in urlgraph.normalised_rank(frame, seeds, ends).collect()}
    monkeypatch.setattr(urlgraph, "frequent", lambda rows, key: ["h1", "h4", "h5"])
    assert plain == {r.host: r.share for r in urlgraph.normalised_rank(frame, seeds, ends).collect()} and len(plain) > 200


def test_scores_equal_each_hosts_own_walk(spark):
    rng = np.random.default_rng(3)
    w = rng.integers(0, 3, (12, 12)) * (rng.random((12, 12)) < 0.3)
    np.fill_diagonal(w, 0)
    edges = [(f"h{a}", f"h{b}", int(w[a, b])) for a in range(12) for b in range(12) if w[a, b]]
    frame = spark.createDataFrame(edges, "src string, dst string, w long")
    seeds, ends = (spark.createDataFrame([(x,) for x in names], "host string") for names in (("h0", "h5"), ("h7",)))
    found = {r.host: r.share for r in urlgraph.normalised_rank(frame, seeds, ends, tolerance=1e-6).collect()}
    p = 0.85 * w / np.maximum(w.sum(1, keepdims=True), 1)
    fixed = np.isin(np.arange(12), (0, 5))
    p[fixed] = 0
    p[7] = 0
    want = np.linalg.solve(np.eye(12) - p, fixed.astype(float))
    walks = 0.15 * np.linalg.inv(np.eye(12) - p)  # row h: the personalised PageRank of h, which ends at seeds
    assert np.allclose(want, walks[:, fixed].sum(1) / 0.15)
    assert all(abs(found.get(f"h{k}", 0.0) - want[k]) < 1e-5 for k in range(12))


def test_ports_belong_to_hosts(spark):
    pages = [(1, "http://one.test/", LINK.format("Spam.net:8080")), (2, "http://spam.net:8080/", LINK.format("x.org")), (3, "http://x.org/fr/", ""), (3, "http://x.org/fr/", ""), (4, None, LINK.format("spam.net")), (5, "http://l.test/" + "p" * 9000, None)]
    rules = [("block", "net:8080", "/"), ("allow", "org", "/fr/")]
    frame = spark.createDataFrame([(*p, 1, "u") for p in pages], "page_id long, url string, html string, n int, of string")
    out = sorted((r.page_id, r.host, r.verdict, r.distrust > 0) for r in urlgraph.judge(frame, rules).collect())
    assert out == [(1, "one.test", "block", True), (2, "spam.net:8080", "block", True), (3, "x.org", "allow", False), (3, "x.org", "allow", False), (4, "", "allow", False), (5, "l.test", "allow", False)]


def test_link_graph_query_equals_dense_iteration(spark):
    """The registered query on pages with links against dense matrices."""
    from geomill.llm import queries

    folder = "/root/testdata/sf0.001"
    out = queries.url_link_graph(spark, folder).collect()
    hosts = sorted({r.host for r in out})
    place = {h: k for k, h in enumerate(hosts)}
    n = max(r[0] for r in spark.read.parquet(f"{folder}/supplier.parquet").select("s_suppkey").collect())
    ends = (".net", ".org", ".test", ".example.com", ".test:8080")
    name = lambda k: f"s{k}{ends[k % 5]}"
    w, good, pages = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts)), np.zeros(len(hosts))
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_linenumber").collect():
        a, b = name(r[0]), name(r[1] * 7 % n + 1)
        pages[place[a]] += 1
        good[place[a]] += a.endswith(".org") and r[2] % 2 == 0
        if a != b and b in place:
            w[place[a], place[b]] += 1
    bad, good = np.array([h.endswith(".net") for h in hosts]), good * 2 > pages

    def share(m, seeds, stops):
        p = 0.85 * m / np.maximum(m.sum(1, keepdims=True), 1)
        p[seeds | stops] = 0
        return np.linalg.solve(np.eye(len(m)) - p, seeds.astype(float))

    risk, credit = share(w, bad, good), share(w.T, good, bad)
    assert bad.any() and len({r.verdict for r in out if r.rule is None}) >= 1 and len(out) == int(pages.sum())
    for r in out:
        k = place[r.host]
        if r.rule is None and abs(risk[k] - credit[k]) > 1e-3 and abs(risk[k] - urlgraph.THRESHOLD) > 1e-3:
            assert r.verdict == ("block" if risk[k] > credit[k] and risk[k] >= urlgraph.THRESHOLD else "allow"), r
