"""URL verdicts from rules and, where no rule fits, from link-graph propagation. DataFrame operations only.

Distrust starts at hosts that a rule blocks as a whole and flows against links, to those that point there; trust starts at
hosts whose pages are mostly allowed by rules and flows along links. Both are personalised PageRanks with damping, in which
seeds keep their score and a walk ends at either kind of seed. They are normalised per host: what a host gets from a neighbour
is divided by the host's own links and not by the neighbour's. So a host's distrust is what its own random walk, which goes on
with probability DAMPING and stops at seeds, collects at blocked ones (the sum over them of the host's personalised PageRank,
over 1 - DAMPING), and it doesn't shrink with the number of others that link to the same blocked host. A host is
blocked if its distrust exceeds its trust and reaches THRESHOLD.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .shared import HOT, frequent, lookup, written

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, THRESHOLD = 0.85, 0.2
#: Scores are iterated until none changes by more than this part of a seed's.
TOLERANCE, MOST_ROUNDS = 1e-4, 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else null."""
    rule = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    return (rule, action) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, counted over all pages; `pages` has host and html.

    A host is what `host_of` gives, port included, on both sides. Relative links stay on their page's host and join no hosts.
    """
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    dst = F.translate("to", UPPER, LOWER)
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def normalised_rank(edges: DataFrame, seeds: DataFrame, ends: DataFrame, damping: float = DAMPING, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, share): 1 for seeds (host), 0 for other `ends`, else `damping` times the mean share of the hosts that it links
    to, by link weight: the seeds' score, propagated against edges (src, dst, w).

    A host all of whose links go to seeds has `damping`, whatever else links there; hosts without a share have no row or 0.
    Each round is one job: a join with the scores, in which hosts that hold over 1/HOT of all edges are looked up by broadcast, an
    aggregate and a written table, whose largest change is observed on the way. Edges lie sorted by `src`, so while the scores are
    small enough for Spark to broadcast them, sums are made where the edges are and a round shuffles a row a host. It ends when that is at most `tolerance`;
    changes shrink by `damping` a round, so that comes after log(tolerance) / log(damping) rounds at the latest.
    """
    named = seeds.select("host").distinct()
    out = edges.groupBy("src").agg(F.sum("w").alias("out")).withColumnRenamed("src", "_src")
    flow = lookup(edges, "src", out, "_src", frequent(edges, "src"))
    flow = flow.join(named.union(ends.select("host")).distinct(), F.col("src") == F.col("host"), "left_anti")
    flow = flow.select("src", "dst", (F.lit(damping) * F.col("w") / F.col("out")).alias("p"))
    flow = written(flow.repartitionByRange("src", "dst").sortWithinPartitions("src"), "edges")
    fixed = written(named.select("host", F.lit(1.0).alias("share")), "shares")
    shares, hubs = fixed, frequent(flow, "dst")
    if flow.isEmpty():
        return shares
    for _ in range(rounds):
        got = lookup(flow, "dst", shares, "host", hubs, merge=False).groupBy("src").agg(F.round(F.sum(F.col("p") * F.col("share")), 12).alias("share"))
        new = got.join(shares.select(F.col("host").alias("_src"), F.col("share").alias("before")), F.col("src") == F.col("_src"), "left")
        new = new.select(F.col("src").alias("host"), "share", F.coalesce("before", F.lit(0.0)).alias("before"))
        change = Observation()
        new = written(new.observe(change, F.max(F.abs(F.col("share") - F.col("before"))).alias("most")), "shares")
        shares = fixed.union(new.select("host", "share"))
        if (change.get["most"] or 0.0) <= tolerance:
            break
    return shares


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = THRESHOLD,
    rounds: int = MOST_ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of `pages`.

    Null urls and urls without `://` have an empty host and path; null html has no links. Repeated rows count as pages of
    their own. Extra columns are not read. `rules` is a short list (action, host, path prefix), part of the query.
    """
    rules = RULES if rules is None else rules
    q = lambda c: F.col(f"`{c}`")
    judged = pages.select(q(id_col).alias("page_id"), host_of(q(url_col)).alias("host"), path_of(q(url_col)).alias("path"), q(html_col).alias("html"))
    rule, action = match(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), action.alias("action"))
    root = match(F.col("host"), F.lit("/"), rules)[1]
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "allow").alias("good"))
    hosts = written(hosts.select("host", "n", (root == "block").alias("bad"), (F.col("good") * 2 > F.col("n")).alias("good")), "hosts")
    often = [r["host"] for r in hosts.where(F.col("n") * HOT > F.lit(hosts.agg(F.sum("n")).first()[0])).select("host").collect()]
    edges = written(host_edges(judged), "links")
    good, bad = hosts.where("good").select("host"), hosts.where("bad").select("host")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    scores = None
    for seeds, ends, links, name in ((good, bad, back, "trust"), (bad, good, edges, "distrust")):
        found = normalised_rank(links, seeds, ends, rounds=rounds, tolerance=tolerance).withColumnRenamed("share", name)
        scores = found if scores is None else scores.join(found, "host", "full_outer")
    # pages of frequent hosts, and those without a host, find their scores by broadcast
    scores = written(scores.withColumnRenamed("host", "of"), "scores")
    tail = lookup(judged.select("page_id", "host", "path", "rule", "action"), "host", scores, "of", [*often, ""], "left", merge=False)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    trust, distrust = F.round(zero("trust"), 9), F.round(zero("distrust"), 9)
    verdict = F.coalesce("action", F.when((distrust > trust) & (distrust >= threshold), "block").otherwise("allow"))
    return tail.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
