"""Quality selection by importance resampling with hashed n-gram models.

Both models say for each hashed n-gram (words, pairs of words, pairs of the words' looks) in which share of documents it
stands, and a document counts every n-gram once. The target model comes from the good rows of a bounded sample of labels.
The raw model is counted over all documents: a mixture of three components, in which each document counts by how much it
looks good, low in quality or toxic to models of the same labels; together the components hold every document, so the raw
model follows the corpus and not the labels. Copies of texts that hold over 1 / COPIES of all rows share one document's count.

The importance weight of a document is target / raw; documents are drawn by Gumbel top-k: the k largest of log weight plus
Gumbel noise that only depends on the id. Unless it is given, k is the number of documents whose log weight is at least
WANTED, counted over the whole corpus.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .shared import frequent_counts, text_of, written

BUCKETS = 1 << 18
SAMPLE = 20_000  # most labelled documents that the models are fitted on
KINDS = ("good", "junk", "toxic")
#: An n-gram speaks for or against a component only if the two shares differ by EVIDENCE standard errors and by a factor of
#: exp(EFFECT), and at least LEAST documents and this SHARE of either side have it; else its log ratio is noise and shrinks to 0.
EVIDENCE, EFFECT, LEAST, SHARE = 4.0, 2.0, 4, 0.005
#: Copies are frequent if they hold more than 1 / COPIES of all rows; a document is counted in this many parts.
COPIES, PARTS = 10_000, 1024
FAMILIES = 3
WANTED = -4.0  # the least log weight that counts towards k


_CLASS = np.full(256, 5, np.uint64)  # of a word's first and last byte: letter, capital, digit, stop, or the byte itself
_CLASS[33:127] = np.arange(33, 127)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[44, 46]] = 0, 1, 2, 3


def _shapes(words: spans.Words, hashes: np.ndarray) -> np.ndarray:
    """A number for the look of each word: its edges, its length, and whether it repeats the word before."""
    same = np.zeros(len(words), np.uint64)
    same[1:] = hashes[1:] == hashes[:-1]
    size = np.minimum(words.ends - words.starts, 24).astype(np.uint64) // np.uint64(4)
    return ((_CLASS[words.data[words.starts]] * np.uint64(256) + _CLASS[words.data[words.ends - 1]]) * np.uint64(8) + size) * np.uint64(2) + same


def _features(batch: pa.RecordBatch, buckets: int):
    """(first row, last row, [(feature buckets, ranges by row)] by family): words, pairs of neighbours, pairs of their looks."""
    offsets, data = spans.buffers(batch.column(1))
    for first, last in spans.slices(offsets):
        at = offsets[first : last + 1]
        words = spans.Words(at - at[0], data[at[0] : at[-1]])
        h = words.hashes()
        looks = _shapes(words, h)
        one = (h % np.uint64(buckets)).astype(np.int64)
        starts = spans.inside(words.of_row, 2)
        pair = lambda x: (spans.mix(x[starts] * np.uint64(0x9E3779B97F4A7C15) + x[starts + 1]) % np.uint64(buckets)).astype(np.int64)  # noqa: B023, E731
        pairs = np.concatenate(([0], np.cumsum(np.maximum(np.diff(words.of_row) - 1, 0))))
        yield first, last, [(one, words.of_row), (pair(h), pairs), (pair(looks), pairs)]


def _sets(families, buckets: int):
    """(rows, feature numbers) of a slice: every feature of a row once; rows count from 0."""
    for base, (values, ends) in zip(range(0, FAMILIES * buckets, buckets), families, strict=True):
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        each = np.unique(row * buckets + values)
        yield each // buckets, each % buckets + base


_COUNTS = [f"n{k}" for k in range(len(KINDS))]
_COUNTED = ", ".join(("bucket int", *(f"{c} long" for c in _COUNTS)))


def _emitted(total: np.ndarray) -> pa.RecordBatch:
    bucket = np.flatnonzero(total.any(axis=0))
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *(pa.array(n[bucket]) for n in total)], names=["bucket", *_COUNTS])


def _counts(batches, kinds: dict[int, int], buckets: int):
    """Feature counts of the labelled documents, by kind: one row per bucket and task; the last bucket counts documents."""
    total = np.zeros((len(KINDS), FAMILIES * buckets + 1), np.int64)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        own = [i for i, x in enumerate(ids) if x in kinds]
        if not own:
            continue
        part = batch.take(pa.array(own))
        labels = np.array([kinds[ids[i]] for i in own])
        total[:, -1] += np.bincount(labels, minlength=len(KINDS))
        for first, _, families in _features(part, buckets):
            for rows, found in _sets(families, buckets):
                np.add.at(total, (labels[first + rows], found), 1)
    yield _emitted(total)


def _first_runs(column, width: int = 8, draws: int = 4) -> np.ndarray:
    """The smallest hashes of each text's word runs under a few orders; near copies share most of them."""
    offsets, data = spans.buffers(column)
    found = np.zeros((len(offsets) - 1, draws), np.uint64)
    for first, last in spans.slices(offsets):
        at = offsets[first : last + 1]
        words = spans.Words(at - at[0], data[at[0] : at[-1]])
        h, sizes = words.hashes(), np.diff(words.of_row)
        runs = spans.window_hashes(h, width)[spans.inside(words.of_row, width)]
        long = np.flatnonzero(sizes >= width)
        ends = np.concatenate(([0], np.cumsum(sizes[long] - width + 1)))
        whole = np.zeros(last - first, np.uint64)  # a shorter text is one run
        for r in np.flatnonzero((sizes > 0) & (sizes < width)):
            whole[r] = spans.window_hashes(h[words.of_row[r] : words.of_row[r + 1]], int(sizes[r]))[0]
        for d in range(draws):
            order = np.uint64(d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            own = spans.mix(whole ^ order)
            if len(long):
                own[long] = np.minimum.reduceat(spans.mix(runs ^ order), ends[:-1])
            found[first:last, d] = own
    return found


_RUNS = "id long, m0 long, m1 long, m2 long, m3 long"


def _signatures(batches):
    for batch in batches:
        found = _first_runs(batch.column(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, d]) for d in range(found.shape[1]))], names=["id", "m0", "m1", "m2", "m3"])


def _raw_counts(batches, model: Model, copies: dict[int, int], buckets: int):
    """Feature counts of all documents in 1 / PARTS, by component: integers, so their sums don't hang on an order."""
    total = np.zeros((len(KINDS), FAMILIES * buckets + 1), np.int64)
    for batch in batches:
        often = np.array([max(copies.get(m, 1) for m in row) for row in _first_runs(batch.column(1)).view(np.int64).tolist()])
        for first, last, families in _features(batch, buckets):
            sets = list(_sets(families, buckets))
            share = model.posteriors(_sums(sets, last - first, model.ratios))
            parts = np.rint(share * PARTS / often[first:last])  # of a document, by component
            total[:, -1] += parts.sum(axis=1).astype(np.int64)
            for rows, found in sets:
                for kind in range(len(KINDS)):
                    some = parts[kind, rows] > 0
                    total[kind] += np.bincount(found[some], parts[kind, rows[some]], minlength=total.shape[1]).astype(np.int64)
    yield _emitted(total)


def _sums(sets, n: int, ratios: np.ndarray) -> np.ndarray:
    """Each row's summed log ratios, by component."""
    out = np.zeros((len(ratios), n))
    for rows, found in sets:
        for kind, ratio in enumerate(ratios):
            out[kind] += np.bincount(rows, ratio[found], minlength=n)
    return out


class Model:
    """A target model and a mixture, from shares of documents that have a feature.

    `target` and each row of `parts` have counts of documents by feature and, last, the number of documents. Features whose
    shares in a component and the target don't differ clearly (see EVIDENCE) get a log ratio of 0: their noise would
    otherwise add up over long texts.
    """

    def __init__(self, target: np.ndarray, parts: np.ndarray, evidence: float = EVIDENCE, effect: float = EFFECT):
        sizes = parts[:, -1].astype(np.float64)
        self.shares = sizes / sizes.sum() if sizes.sum() else np.eye(len(parts))[0]
        good, n_good = target[:-1].astype(np.float64), float(target[-1])
        ratios = []
        for part, size in zip(parts[:, :-1].astype(np.float64), sizes, strict=True):
            ratio = np.log((part + 0.5) / (size + 1)) - np.log((good + 0.5) / (n_good + 1))
            both = (good + part + 1) / (n_good + size + 2)
            spread = np.sqrt(both * (1 - both) * (1 / (n_good + 1) + 1 / (size + 1)))
            sure = np.abs(part / (size + 1e-9) - good / (n_good + 1e-9)) >= evidence * spread
            common = (part >= max(LEAST, SHARE * size)) | (good >= max(LEAST, SHARE * n_good))
            ratios.append(np.where(sure & common & (np.abs(ratio) >= effect), ratio, 0.0))
        self.ratios = np.array(ratios, np.float32)

    def _terms(self, sums: np.ndarray) -> np.ndarray:
        return sums + np.log(np.maximum(self.shares, 1e-12))[:, None]

    def posteriors(self, sums: np.ndarray) -> np.ndarray:
        """How much each document belongs to each component, from its summed log ratios."""
        terms = self._terms(sums)
        each = np.exp(terms - terms.max(axis=0))
        return each / each.sum(axis=0)

    def log_weights(self, sums: np.ndarray) -> np.ndarray:
        """log target / raw."""
        terms = self._terms(sums)
        top = terms.max(axis=0)
        return -(top + np.log(np.exp(terms - top).sum(axis=0)))


def _summed(counted: DataFrame) -> DataFrame:
    """One row for each feature, whatever the corpus holds."""
    return counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in counted.columns if c != "bucket"))


def _fitted(counts: DataFrame, parts: int, buckets: int) -> Model:
    """The model of the table counts(bucket, good, n0, n1, n2); n0 to n2 count in 1 / `parts`.

    Only features that LEAST documents and SHARE of the target or of a component have can speak at all, so the driver gets these
    and the sizes, and not the table of all features.
    """
    last, names = FAMILIES * buckets, ["good", *_COUNTS]
    units = dict(zip(names, (1, *(parts for _ in KINDS)), strict=True))
    sizes = counts.where(F.col("bucket") == last).select(*names).first() or dict.fromkeys(names, 0)
    heard = [F.col(c) >= F.lit(int(max(LEAST * units[c], SHARE * sizes[c]))) for c in names]  # rounded down: Model decides
    found = counts.where((F.col("bucket") < last) & functools.reduce(Column.__or__, heard)).toArrow()
    every = {c: np.append(found[c].to_numpy(), sizes[c]) for c in names}
    model = Model(every["good"], np.array([every[c] for c in _COUNTS]) / parts)
    ratios = np.zeros((len(KINDS), last), np.float32)
    ratios[:, found["bucket"].to_numpy()] = model.ratios
    model.ratios = ratios
    return model


def label_counts(named: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(counts by kind and feature, labelled rows by kind) of `label_table`, as arrays."""
    counted, share = label_table(named, labels, sample, buckets)
    out = np.zeros((len(KINDS), FAMILIES * buckets + 1), np.int64)
    if counted is not None:
        summed = counted.toArrow()
        for k, c in enumerate(_COUNTS):
            out[k, summed["bucket"].to_numpy()] = summed[c].to_numpy()
    return out, share


def label_table(named: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[DataFrame | None, np.ndarray]:
    """(counts by feature, labelled rows by kind), from at most `sample` labelled ids, those with the smallest hashes of their id.

    An id with several labels that differ has the worst of them: toxic, else low in quality. Documents that share an id share
    its label and all count, but only the one with the least signature says whether it is a copy.
    """
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("id"), kind.alias("kind")).groupBy("id").agg(F.max("kind").alias("kind"))
    rows = known.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    kinds = dict(zip(rows["id"].tolist(), rows["kind"].tolist(), strict=True))
    share = np.bincount(rows["kind"].to_numpy(dtype=np.int64), minlength=len(KINDS))
    if not kinds:
        return None, share
    picked = F.broadcast(named.sparkSession.createDataFrame([(i,) for i in kinds], "picked long"))  # at most `sample` rows
    found = named.join(picked, named.id == picked.picked, "left_semi").select("id", "text")
    least = F.min(F.struct("m0", "m1", "m2", "m3")).alias("m")  # at most `sample` rows, however many documents share an id
    first = found.mapInArrow(_signatures, _RUNS).groupBy("id").agg(least).select("id", "m.*").toPandas().sort_values("id")
    copies = first["m0"].duplicated() | first["m1"].duplicated() | first["m2"].duplicated() | first["m3"].duplicated()
    kinds = {i: kinds[i] for i in first["id"][~copies].tolist()}  # else a group of copies counts as if its words were common
    return written(_summed(found.mapInArrow(lambda b: _counts(b, kinds, buckets), _COUNTED)), "label-counts"), share


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """The target model from labels and the raw model from all of `docs`."""
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(f"`{text_col}`").alias("text"))
    counted, share = label_table(named, labels, sample, buckets)
    if counted is None:
        none = np.zeros((len(KINDS), FAMILIES * buckets + 1))
        return Model(none[0], none)
    start = _fitted(counted.withColumn("good", F.col("n0")), 1, buckets)
    start.shares = share / share.sum()
    runs = written(named.mapInArrow(_signatures, _RUNS).select(F.explode(F.array("m0", "m1", "m2", "m3")).alias("m")), "runs")
    copies = {r["m"]: max(1, r["n"]) for r in frequent_counts(runs, "m", 4 * COPIES).where("n > 1").collect()}  # fewer than 4 * COPIES rows
    shared = named.sparkSession.sparkContext.broadcast((start, copies))
    raw = named.mapInArrow(lambda b: _raw_counts(b, *shared.value, buckets), _COUNTED).withColumn("good", F.lit(0).cast("long"))
    good = counted.select("bucket", *(F.lit(0).cast("long").alias(c) for c in _COUNTS), F.col("n0").alias("good"))
    return _fitted(written(_summed(raw.unionByName(good)), "counts"), PARTS, buckets)


def _scores(batches, model: Model, buckets: int):
    for batch in batches:
        weight, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for first, last, families in _features(batch, buckets):
            words[first:last] = np.diff(families[0][1])
            weight[first:last] = model.log_weights(_sums(list(_sets(families, buckets)), last - first, model.ratios))
        weight = np.round(weight, 6)
        draw = batch.column(2).to_numpy().view(np.uint64)
        u = ((spans.mix(draw * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        gumbel = np.round(-np.log(-np.log(u)), 6)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words), pa.array(weight), pa.array(np.round(weight + gumbel, 6))], names=["doc_id", "n_words", "log_weight", "key"]
        )


def _border(rows: DataFrame, c: str, need: int, bins: int) -> tuple[object, int, bool]:
    """(v, n, all): the `need` smallest values of column `c` are the n below v and some, or all, of those that equal v.

    Counts by bins of the values find the one bin that holds the border, and this bin is split again until it has one
    value. The driver sees at most `bins` counts at a time.
    """
    low, high = rows.agg(F.min(c), F.max(c)).first()
    below = 0
    while True:
        part = rows.where(F.col(c).between(low, high))
        whole = isinstance(low, int) and high - low < 1 << 62
        offset = F.col(c) - F.lit(low) if whole else F.col(c).cast("double") - F.lit(float(low))
        width = max(1, -(-(high - low + 1) // bins)) if whole else (high - low) / bins
        number = F.floor(offset / F.lit(width)) if width else F.lit(0)
        number = F.when(F.col(c) == low, -1).otherwise(F.least(number, F.lit(bins - 1)).cast("long"))  # the lowest value has its own bin, so bins shrink
        found = part.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).collect()
        for row in sorted(found):
            if below + row["n"] >= need:
                break
            below += row["n"]
        low, high = row["low"], row["high"]
        if low == high:
            return low, below, below + row["n"] == need


def top_k(scored: DataFrame, k: int, key: str = "key", tie: str = "doc_id", bins: int = 256) -> DataFrame:
    """`scored` with a column selected: whether the row is among the k with the largest key.

    Ties go to the smaller `tie`, null last; rows that are equal in both are told apart by their place in the table, so
    exactly k rows are selected. `scored` should be a written table; without a global sort, no task or driver gets more
    than counts.
    """
    if k <= 0 or (total := scored.count()) <= k:
        return scored.withColumn("selected", F.lit(k > 0))
    rows = scored.withColumns({"rank0": -F.col(key), "rank1": F.col(tie).isNull().cast("int"), "rank2": F.col(tie), "rank3": F.monotonically_increasing_id()})
    names = ["rank0", "rank1", "rank2", "rank3"]
    sure, border, need = F.lit(False), F.lit(True), k
    for c in names:
        part = rows.where(border)
        if c == "rank2" and part.where(F.col(c).isNotNull()).isEmpty():
            continue
        value, below, every = _border(part, c, need, bins)
        sure = sure | (border & ((F.col(c) <= F.lit(value)) if every else (F.col(c) < F.lit(value))))
        border, need = border & (F.col(c) == F.lit(value)), need - below
        if every:
            break
    return rows.withColumn("selected", F.coalesce(sure, F.lit(False))).drop(*names)


def importance_sample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, n_words, log_weight, key, selected) for every row of `docs`.

    Null text: empty; an empty text has no features, so its weight is 1. Null labels are ignored; without
    labels every document has weight 1. A null id draws by its text. Repeated rows get the same key; each is a row of its own
    among the k. Extra columns are not read.
    """
    model = fit(docs, labels, id_col, text_col, sample, buckets)
    ids, text = F.col(f"`{id_col}`").cast("long"), text_of(f"`{text_col}`")
    named = docs.select(ids.alias("id"), text.alias("text"), F.coalesce(ids, F.xxhash64(text)).alias("draw"))
    shared = named.sparkSession.sparkContext.broadcast(model)  # 9 x BUCKETS floats
    scored = written(named.mapInArrow(lambda b: _scores(b, shared.value, buckets), "doc_id long, n_words long, log_weight double, key double"), "scores")
    if k is None:
        k = scored.where(F.col("log_weight") >= WANTED).count()
    return top_k(scored, k)
