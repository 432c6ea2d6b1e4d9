"""Near-duplicate classes with ProbMinHash sketches of word shingles, banding and exact verification.

Sketch: every shingle is an element that arrives at the times of a Poisson process whose rate is its weight; each arrival
picks one register and keeps it if it is the earliest there. Once no pending arrival can beat the latest register, the
sketch is complete (early termination). Registers of two documents agree with the probability Jaccard of their weights.
All weights are 1, however often a text repeats a shingle, so this is the set similarity that is verified.

Bands of registers give candidate buckets. Pairs inside a bucket are not all built: every member meets the bucket's
smallest document (its pivot), survivors of the exact check become links, links become components. Where a pivot's group
then still holds several components, the pairs across them are compared too: all of them in a group of at most
SMALL_GROUP members, and in a larger one those that an exact filter on differences from the group's common set leaves
(`_large_pairs`). So no link between different texts of a group is lost, and no group is expanded into all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .shared import HOT, components, lookup, text_of, written

SHINGLE, SIMILARITY = 5, 0.8
SMALL_GROUP = 24
#: Members of a large group that meet one copy of its common set.
SHARE = 256
REGISTERS, ROWS = 120, 5  # 24 bands of 5: a pair at 0.8 is missed with probability 7e-5


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter, non-empty text is one shingle."""
    return spans.window_hashes(hashes, min(width, len(hashes))) if len(hashes) else hashes


def probminhash(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The element that arrives first at each register."""
    first = np.full(registers, np.inf)
    times, places, owners = [], [], []
    live, rate, now, step = elements, weights, np.zeros(len(elements)), 0
    while len(live):
        step += 1
        r = spans.mix(live + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        now = now - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        keep = now < first.max()
        live, rate, now, r = live[keep], rate[keep], now[keep], r[keep]
        place = (spans.mix(r ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(registers)).astype(np.int64)
        better = now < first[place]
        if better.any():
            t, k, o = now[better], place[better], live[better]
            np.minimum.at(first, k, t)
            times.append(t), places.append(k), owners.append(o)
    t, k, o = np.concatenate(times), np.concatenate(places), np.concatenate(owners)
    out = np.zeros(registers, np.uint64)
    late_first = np.argsort(-t, kind="stable")
    out[k[late_first]] = o[late_first]
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    grid = sketch.reshape(-1, rows)
    h = np.arange(len(grid), dtype=np.uint64)
    for column in grid.T:
        h = spans.mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def _each_text(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    offsets, data = spans.buffers(batch.column(1))
    for first, last in spans.slices(offsets):
        at = offsets[first : last + 1]
        body = data[at[0] : at[-1]]
        words = spans.Words(at - at[0], body)
        hashes = words.hashes()
        for r in range(last - first):
            yield first + r, body[at[r] - at[0] : at[r + 1] - at[0]].tobytes(), hashes[words.of_row[r] : words.of_row[r + 1]]


def _sketches(batches, width: int, registers: int, rows: int):
    for batch in batches:
        keys, sizes, found = [], [], []
        for _, body, hashes in _each_text(batch):
            keys.append(hashlib.blake2b(body, digest_size=16).digest())
            own = np.unique(shingles(hashes, width))
            sizes.append(len(own))
            found.append(bands(probminhash(own, np.ones(len(own)), registers), rows) if len(own) else np.zeros(0, np.int64))
        at = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        values = np.concatenate(found) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, values)], names=["id", "copy", "size", "bands"]
        )


def _shingle_sets(batches, width: int):
    for batch in batches:
        sets = [np.unique(shingles(hashes, width)).tobytes() for _, _, hashes in _each_text(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "grams"])


def _jaccard(batches):
    for batch in batches:
        score = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            score.append(common / (len(both) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "similarity"])


def verify(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose shingle sets have a Jaccard similarity of at least `similarity`."""
    left = grams.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = grams.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    met = pairs.hint("merge").join(left.hint("merge"), "a").hint("merge").join(right.hint("merge"), "b").select("a", "b", "x", "y")
    return met.mapInArrow(_jaccard, "a long, b long, similarity double").where(F.col("similarity") >= similarity)


def _explode(batches):
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        for k in range(0, len(flat), 1 << 18):
            at = pa.array(rows[k : k + (1 << 18)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(flat[k : k + (1 << 18)])], names=["p", "id", "gram"])


def _differences(batches):
    """(p, id, size, diff, gram): the grams in which a member and its group's common set differ."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            found = []
            for own, common in zip(part.column(2), part.column(3).to_pylist(), strict=True):
                found.append(np.setxor1d(np.frombuffer(own.as_buffer(), np.int64), np.array(common or [], np.int64), assume_unique=True))
            sizes = np.array([len(x.as_buffer()) // 8 for x in part.column(2)], np.int64)
            count = np.array([len(f) for f in found], np.int64)
            shown = np.maximum(count, 1)  # a member without differences has one row with a null gram
            at = np.repeat(np.arange(part.num_rows), shown)
            flat = np.concatenate([f if len(f) else np.zeros(1, np.int64) for f in found])
            none = np.repeat(count == 0, shown)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(sizes[at]), pa.array(count[at]), pa.array(flat, pa.int64(), mask=none)],
                names=["p", "id", "size", "diff", "gram"],
            )


def _small_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components in the same small group."""
    other = members.select("p", F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("label").alias("label_b"))
    met = members.withColumnRenamed("id", "a").join(other, "p").where("a < b and label <> label_b")
    return met.where(F.least("size", "size_b") >= F.lit(similarity) * F.greatest("size", "size_b")).select("a", "b")


def _large_differences(members: DataFrame, grams: DataFrame) -> DataFrame:
    """(p, id, size, diff, gram): where each member of a large group differs from the group's common set.

    A group's common set R has the grams of over half of its members; D(x) are the grams in which x and R differ. Members meet
    a copy of R in shares of about SHARE, so a large group's members don't go to one task.
    """
    shares = lambda n: F.ceil(F.col(n) / SHARE)
    own = members.join(grams.hint("merge"), "id").select("p", "id", "grams", F.pmod(F.xxhash64("id"), shares("n")).alias("share"))
    counted = own.select("p", "id", "grams").mapInArrow(_explode, "p long, id long, gram long").groupBy("p", "gram").agg(F.count("*").alias("n"))
    sizes = members.groupBy("p").agg(F.count("*").alias("m"))
    common = counted.join(sizes, "p").where("2 * n > m").groupBy("p", "m").agg(F.collect_list("gram").alias("common"))
    common = common.select("p", "common", F.explode(F.sequence(F.lit(0).cast("long"), shares("m") - 1)).alias("share"))
    rows = own.join(common.hint("merge"), ["p", "share"], "left").select("p", "id", "grams", "common")
    return written(rows.mapInArrow(_differences, "p long, id long, size long, diff long, gram long"), "differences")


def _central_pairs(diff: DataFrame, similarity: float) -> DataFrame:
    """Every member with the member of its group that has the largest f |y| - |D(y)|, the one closest to the common set."""
    f = (1 - similarity) / (1 + similarity)
    each = diff.select("p", "id", "size", (F.lit(f) * F.col("size") - F.col("diff")).alias("slack")).distinct()
    top = each.groupBy("p").agg(F.max(F.struct("slack", "id", "size")).alias("top"))
    near = each.join(top, "p").where("id <> top.id").where(F.least("size", "top.size") >= F.lit(similarity) * F.greatest("size", "top.size"))
    return near.select(F.least("id", "top.id").alias("a"), F.greatest("id", "top.id").alias("b"))


def _large_pairs(diff: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components in the same large group that may be similar; no similar pair is missed.

    x and y are similar exactly if |x ^ y| <= f (|x| + |y|), f = (1 - s) / (1 + s), and
    |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|. Either the sizes of D(x) and D(y) alone suffice; then both are similar to
    the group's central member and have its label already. Or D(x) and D(y) share at least |D(x)| - |x| (1 - s) / s grams,
    so they share one in their prefixes, which leave out that many of the grams that are most frequent in the group.
    """
    often = diff.where("gram is not null").groupBy("p", "gram").agg(F.count("*").alias("often"))
    ordered = Window.partitionBy("p", "id").orderBy("often", "gram")
    length = F.col("diff") - F.greatest(F.lit(1.0), F.ceil(F.col("diff") - F.lit((1 - similarity) / similarity) * F.col("size") - F.lit(1e-6))) + 1
    prefix = diff.join(often, ["p", "gram"]).withColumn("at", F.row_number().over(ordered)).where((F.col("at") <= length) & (F.col("often") > 1))
    prefix = prefix.join(labels, prefix.id == labels.node, "left").select("p", "gram", "id", "size", "diff", "at", F.coalesce("label", "id").alias("label"))
    spread = prefix.groupBy("p", "gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("p", "gram")
    prefix = written(prefix.join(spread, ["p", "gram"]), "prefixes")
    other = prefix.select("p", "gram", *(F.col(c).alias(f"{c}_b") for c in ("id", "size", "diff", "at", "label")))
    f = (1 - similarity) / (1 + similarity)
    shared = F.ceil((F.col("diff") + F.col("diff_b") - F.lit(f) * (F.col("size") + F.col("size_b"))) / 2 - F.lit(1e-6))
    met = prefix.join(other, ["p", "gram"]).where(
        (F.col("id") < F.col("id_b"))
        & (F.col("label") != F.col("label_b"))
        & (F.least("size", "size_b") >= F.lit(similarity) * F.greatest("size", "size_b"))
        & (F.col("diff") - F.col("at") + 1 >= shared)  # the first shared gram of a similar pair leaves room for the others
        & (F.col("diff_b") - F.col("at_b") + 1 >= shared)
    )
    return met.select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def _representatives(sketch: DataFrame) -> DataFrame:
    """(id, rep, size, bands): the smallest id with the same text; only representatives keep their bands."""
    copies = written(sketch.groupBy(F.col("copy").alias("same")).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
    often = copies.where(F.col("n") * HOT > F.lit(sketch.count()))
    found = lookup(sketch, "copy", copies.select("same", "rep"), "same", [r[0] for r in often.select("same").collect()], "left")
    every = found.select("id", F.coalesce("rep", "id").alias("rep"), "size", "bands")
    return every.withColumn("bands", F.when(F.col("id") == F.col("rep"), F.col("bands")))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    similarity: float = SIMILARITY,
    registers: int = REGISTERS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, class_id) for every document; class_id is the smallest id of its class.

    Two documents are linked if their texts are equal or their sets of `width`-word shingles have a Jaccard similarity of
    at least `similarity`; classes are the connected components. Null text: empty. Empty texts are copies of each other. A
    text of fewer than `width` words is one shingle. Rows with a null id have no name in the result and are left out; repeated rows count once.
    """
    named = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(f"`{text_col}`").alias("text"))
    sketch = written(
        named.mapInArrow(lambda b: _sketches(b, width, registers, rows), "id long, copy binary, size long, bands array<long>"), "sketch"
    )
    member = written(_representatives(sketch), "member")
    dealt = member.where("id = rep and size > 0").dropDuplicates(["id"]).select("id", "size", F.explode("bands").alias("band"))
    pivots = dealt.groupBy(F.col("band").alias("bucket")).agg(F.min(F.struct("id", "size")).alias("p"), F.count("*").alias("n")).where("n > 1")
    pivots = written(pivots.select("bucket", F.col("p.id").alias("p"), F.col("p.size").alias("p_size"), "n"), "pivots")
    often = pivots.where(F.col("n") * HOT > F.lit(dealt.count()))
    # a group: a pivot and all that share a bucket of which it is the smallest document
    group = lookup(dealt, "band", pivots, "bucket", [r[0] for r in often.select("bucket").collect()]).select("id", "size", "p", "p_size").distinct()
    group = written(group, "groups")
    first = group.where((F.col("id") != F.col("p")) & (F.least("size", "p_size") >= F.lit(similarity) * F.greatest("size", "p_size")))
    wanted = group.select("id").distinct()
    read = named.join(wanted.hint("merge"), "id", "left_semi")
    grams = written(read.mapInArrow(lambda b: _shingle_sets(b, width), "id long, grams binary").dropDuplicates(["id"]), "grams")
    links = written(verify(first.select(F.col("p").alias("a"), F.col("id").alias("b")), grams, similarity), "links")
    labels = components(links)

    # groups that still hold several components: the pairs across them that may be similar
    tagged = written(group.join(labels, group.id == labels.node, "left").select("p", "id", "size", F.coalesce("label", "id").alias("label")), "tagged")
    mixed = tagged.groupBy("p").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("p", "n")
    rest = written(tagged.join(mixed, "p"), "mixed")
    tried = first.select(F.col("p").alias("a"), F.col("id").alias("b"))
    pairs = _small_pairs(rest.where(F.col("n") <= SMALL_GROUP), similarity)
    large = rest.where(F.col("n") > SMALL_GROUP)
    if not large.isEmpty():
        diff = _large_differences(large, grams)
        links = written(links.union(verify(_central_pairs(diff, similarity).distinct(), grams, similarity)), "links")
        pairs = pairs.union(_large_pairs(diff, components(links), similarity))
    more = written(verify(pairs.distinct().join(tried, ["a", "b"], "left_anti"), grams, similarity), "links")
    labels = components(links.select("a", "b").union(more.select("a", "b")))
    return (
        member.select("id", "rep")
        .distinct()
        .join(labels, F.col("rep") == F.col("node"), "left")
        .select(F.col("id").alias("doc_id"), F.coalesce("label", "rep").alias("class_id"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without all but the first document of each class; rows with a null id stay."""
    classes = near_duplicates(docs, id_col, text_col, **options)
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")


def brute_force(rows: list[tuple[int, str | None]], width: int = SHINGLE, similarity: float = SIMILARITY) -> dict[int, int]:
    """Class ids by comparing all pairs, for tests."""
    import re

    sets, texts = {}, {i: t or "" for i, t in rows}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if texts[a] == texts[b] or (x and y and len(x & y) >= similarity * len(x | y)):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}
