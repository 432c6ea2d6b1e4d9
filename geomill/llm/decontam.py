"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive token positions; positions that are 0 are ignored, so a substituted token there
does not hide a shared passage. Seeds of the benchmark and of the training text are tables of hashes that Spark joins;
around each hit the two token sequences are compared on that diagonal, and every stretch that meets both limits counts.

A bit set of the benchmark's hashes, of bounded size and broadcast, keeps most training hashes from being shuffled; a false
hit only reaches the join. Documents that hit are written once with their hashes, so no other text is shuffled. A hash that
comes again and again at one distance in a text is one entry (a progression), so repetitive texts meet an item once and not
once for each pair of places. Hashes and items that a large part of the hits share are looked up by broadcast while they are
few and small, else dealt to SALTS parts.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .shared import frequent, lookup, text_of, written

#: Weight 8 in spans of 8 to 14: the first one is contiguous, the others skip different positions.
MASKS = ("11111111", "1101100110101", "11101001010011", "1011010011101")
#: For items of LEAST to SHORT - 1 tokens, which the spaced masks don't fit in: one of these fits around any one changed token of 8.
SHORT_MASKS, SHORT = ("111111", "11001111", "11110011"), 13
#: Items of fewer tokens than LEAST count only where a text has all their tokens in a row.
LEAST = 8
MIN_MATCH, MIN_IDENTITY = 13, 0.75
#: The bit set has about SPARSE bits for each seed, within these powers of two.
SPARSE, FEWEST_BITS, MOST_BITS = 1024, 16, 26
#: Benchmark rows that are broadcast for frequent hashes and items, and bytes of their texts, at most.
FEW_ROWS, FEW_BYTES = 100_000, 4 << 20
#: Parts that a frequent hash or item with more rows than that is dealt to.
SALTS = 64
#: Equal distances in a row from which on places are kept as a progression.
REGULAR = 4


def mask_table() -> list[str]:
    """All masks; a mask's place here is its number."""
    return [*MASKS, *SHORT_MASKS, *("1" * n for n in range(1, LEAST))]


def masks_of(size: int) -> list[int]:
    """The masks for items of so many tokens."""
    if size < LEAST:
        return [len(MASKS) + len(SHORT_MASKS) + size - 1] if size else []
    return list(range(len(MASKS) + (len(SHORT_MASKS) if size < SHORT else 0)))


def needed(size: int, min_match: int, min_identity: float) -> int:
    """Equal tokens that a passage shared with an item of `size` tokens has at least."""
    part = Fraction(min_identity).limit_denominator(1_000_000)
    return size if size < LEAST else max(1, min(min_match, -(-size * part.numerator // part.denominator)))


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, range by row); tokens are words in ASCII lower case."""
    offsets, data = spans.buffers(column)
    hashes, of_row = [], [0]
    for first, last in spans.slices(offsets):
        at = offsets[first : last + 1]
        words = spans.Words(at - at[0], data[at[0] : at[-1]])
        hashes.append(words.hashes(fold_case=True))
        of_row.extend((words.of_row[1:] + of_row[-1]).tolist())
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(of_row, np.int64)


def seed_hashes(tokens: np.ndarray, starts: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the tokens under a mask, at each start."""
    h = np.full(len(starts), salt, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            h = h * np.uint64(0xD6E8FEB86659FD93) + tokens[starts + j]
    return spans.mix(h)


def progressions(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first, step, n) of arithmetic progressions that hold all places of each group and no others.

    Both are sorted by group and place. Runs of REGULAR and more equal distances are one progression each, which may share an
    end with the next one; all other places stand alone, with a step of 0.
    """
    if len(place) < 2:
        return np.arange(len(place)), np.zeros(len(place), np.int64), np.ones(len(place), np.int64)
    step = np.where(group[1:] == group[:-1], np.diff(place), 0)
    turn = np.flatnonzero(np.diff(step)) + 1
    first, last = np.append(0, turn), np.append(turn, len(step))
    regular = (last - first >= REGULAR) & (step[first] > 0)
    first, last = first[regular], last[regular]
    inside = np.zeros(len(place) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    alone = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
    return np.concatenate((alone, first)), np.concatenate((np.zeros(len(alone), np.int64), step[first])), np.concatenate((np.ones(len(alone), np.int64), last - first + 1))


def _seeds(batches):
    """(hash, item, place, place_step, place_n, mask) of benchmark rows (key, text)."""
    table = mask_table()
    for batch in batches:
        tokens, of_row = _tokens(batch.column(1))
        sizes = np.diff(of_row)
        own = {n: set(masks_of(n)) for n in np.unique(sizes).tolist()}
        parts = []
        for number, mask in enumerate(table):
            starts = spans.inside(of_row, len(mask))
            row = np.searchsorted(of_row, starts, "right") - 1
            fits = np.array([number in own[n] for n in sizes.tolist()], bool)[row]
            starts, row = starts[fits], row[fits]
            if len(starts):
                parts.append((seed_hashes(tokens, starts, mask, number).view(np.int64), row, starts - of_row[row], np.full(len(starts), number)))
        h, row, place, mask = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
        o = np.lexsort((place, h, mask, row))
        h, row, place, mask = h[o], row[o], place[o], mask[o]
        k, step, n = progressions(_groups(row, mask, h), place)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[k]), batch.column(0).take(pa.array(row[k])), *(pa.array(x.astype(np.int32)) for x in (place[k], step, n, mask[k]))],
            names=["seed", "item", "place", "place_step", "place_n", "mask"],
        )


def _groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """Numbers of the groups of rows that are sorted by these keys."""
    new = np.zeros(len(sorted_keys[0]), bool)
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def _bit_set(seeds: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words): two bits are set for each seed, from the two halves of its hash; at most 2**(MOST_BITS - 6) words are gathered."""
    bits = min(max(int(seeds.count() * SPARSE).bit_length(), FEWEST_BITS), MOST_BITS)
    halves = F.array(F.col("seed"), F.shiftleft("seed", 32))
    bit = F.shiftrightunsigned("half", 64 - bits).alias("bit")
    found = seeds.select(F.explode(halves).alias("half")).select(bit).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["word"].to_numpy()] = found["set"].to_numpy().view(np.uint64)
    return bits, words


def _in_bit_set(h: np.ndarray, bits: int, words: np.ndarray) -> np.ndarray:
    """Places of the hashes whose two bits are set."""
    at = np.arange(len(h))
    for shift in (0, 32):
        bit = (h[at] << np.uint64(shift)) >> np.uint64(64 - bits)
        at = at[(words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


_HITS = pa.list_(pa.struct([(c, pa.int64()) for c in ("seed", "at", "at_step", "at_n")]))


def _suspects(batches, masks: list[int], bits: int, words: np.ndarray):
    """The rows (id, text) that have a seed of the bit set, with all such seeds and their token positions."""
    table = mask_table()
    for batch in batches:
        offsets, _ = spans.buffers(batch.column(1))
        for first, last in spans.slices(offsets):
            part = batch.slice(first, last - first)
            tokens, of_row = _tokens(part.column(1))
            seeds, places = [], []
            for number in masks:
                starts = spans.inside(of_row, len(table[number]))
                h = seed_hashes(tokens, starts, table[number], number)
                hit = _in_bit_set(h, bits, words)
                seeds.append(h[hit].view(np.int64))
                places.append(starts[hit])
            seed, place = np.concatenate(seeds), np.concatenate(places)
            if not len(seed):
                continue
            row = np.searchsorted(of_row, place, "right") - 1
            o = np.lexsort((place, seed, row))
            seed, place, row = seed[o], place[o], row[o]
            k, step, n = progressions(_groups(row, seed), place)
            o = np.argsort(row[k], kind="stable")
            k, step, n = k[o], step[o], n[o]
            rows, ends = np.unique(row[k], return_index=True)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(ends, len(k)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(x) for x in (seed[k], place[k] - of_row[row[k]], step, n)], fields=list(_HITS.value_type)),
            )
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), lists], names=["id", "text", "hits"])


def fullest_stretch(same: np.ndarray, min_identity: float) -> tuple[int, int]:
    """[first, last) of the run with the most matches among all with an identity of at least `min_identity`.

    Of equal ones the shortest, then the first. For each end the leftmost start with a prefix sum that is not larger has the
    most matches; sums are of integers, so a run at exactly the limit counts.
    """
    part = Fraction(min_identity).limit_denominator(1_000_000)
    total = np.concatenate(([0], np.cumsum(np.where(same, part.denominator - part.numerator, -part.numerator))))
    count = np.concatenate(([0], np.cumsum(same)))
    low = np.minimum.accumulate(total)
    start = np.searchsorted(-low, -total)  # the first place at which the lowest sum so far is not larger
    matched = count - count[start]
    if not matched.max():
        return 0, 0
    at = np.flatnonzero(same)
    ends = np.flatnonzero(matched == matched.max())
    first, last = at[count[start[ends]]], at[count[ends] - 1] + 1  # without differences at either end
    k = np.lexsort((first, last - first))[0]
    return int(first[k]), int(last[k])


def passages(same: np.ndarray, need: int, min_identity: float) -> list[tuple[int, int]]:
    """Disjoint runs [first, last) with at least `need` matches and the identity: the fullest one, then those beside it."""
    out, parts = [], [(0, len(same))]
    while parts:
        a, b = parts.pop()
        if np.count_nonzero(same[a:b]) < need:
            continue
        x, y = fullest_stretch(same[a:b], min_identity)
        if np.count_nonzero(same[a + x : a + y]) >= need:
            out.append((a + x, a + y))
            parts += [(a, a + x), (a + y, b)]
    return sorted(out)


_FOUND = ("doc_first", "doc_last", "item_first", "matched", "stretch_first", "stretch_last", "identity")


def stretches(found: list[tuple[int, int, int, int, float]]) -> list[tuple]:
    """Of passages (doc_first, doc_last, item_first, matched, identity) whose document tokens overlap, directly or by others,
    the best one (most matches, then identity, then the first), with the first and last token of all of them."""
    out, best, end = [], None, -1
    rank = lambda p: (p[3], p[4], -p[0], -p[2])
    for p in sorted(found):
        if best is None or p[0] >= end:
            if best is not None:
                out.append((*best[:4], begin, end, best[4]))
            best, begin, end = p, p[0], p[1]
        else:
            best, end = max(best, p, key=rank), max(end, p[1])
    return out if best is None else [*out, (*best[:4], begin, end, best[4])]


def _compare(batches, min_match: int, min_identity: float):
    """Passages on the given diagonals of rows (id, item_id, text, item_text, shifts); shifts are progressions."""
    for batch in batches:
        offsets, _ = spans.buffers(batch.column(2))
        for first, last in spans.slices(offsets):
            part = batch.slice(first, last - first)
            tokens, of_row = _tokens(part.column(2))
            others, of_item = _tokens(part.column(3))
            rows, found = [], []
            for r, shifts in enumerate(part.column(4)):
                text, item = tokens[of_row[r] : of_row[r + 1]], others[of_item[r] : of_item[r + 1]]
                need = needed(len(item), min_match, min_identity)
                firsts, steps, ns = (shifts.values.field(c).to_numpy() for c in ("first", "step", "n"))
                nth = np.arange(ns.sum()) - np.repeat(np.cumsum(ns) - ns, ns)
                diagonals = np.unique(np.repeat(firsts, ns) + nth * np.repeat(steps, ns))
                own, known, before = [], [], None
                for s in diagonals.tolist():
                    a, b = max(s, 0), min(len(item) + s, len(text))
                    same = text[a:b] == item[a - s : b - s]
                    if before is None or not np.array_equal(same, before):  # neighbours are alike where a text repeats itself
                        known = [(x, y, int(same[x:y].sum())) for x, y in passages(same, need, min_identity)]
                        before = same
                    own += [(a + x, a + y, a + x - s, m, m / (y - x)) for x, y, m in known]
                found += (kept := stretches(own))
                rows += [r] * len(kept)
            at = pa.array(rows, pa.int64())
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=["doc_id", "item_id", *_FOUND]
            )


def _met(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """`rows` joined with `table`; no task gets all rows of a frequent key, however many rows of `table` have it."""
    hot = frequent(rows, key)
    n, size = table.where(F.col(table_key).isin(hot)).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if n <= FEW_ROWS and size <= FEW_BYTES:
        return lookup(rows, key, table, table_key, hot)
    often, other = F.col(key).isin(hot), F.col(table_key).isin(hot)  # fewer than HOT keys
    salted = rows.where(often).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = table.where(other).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    split = salted.join(copies.hint("merge"), (F.col(key) == F.col(table_key)) & (F.col("_salt") == F.col("_part"))).drop("_salt", "_part")
    return split.unionByName(rows.where(~often).join(table.hint("merge"), F.col(key) == F.col(table_key)))


def _diagonals(met: DataFrame) -> DataFrame:
    """(of, item, shifts): at - place of all pairs of places, as progressions.

    Two progressions of one step, or one and a single place, give one progression; of different steps each of the item's
    places gives one.
    """
    one = F.expr("at_n = 1 or place_n = 1 or at_step = place_step")
    places = F.when(one, F.array(F.col("place_n") - 1)).otherwise(F.expr("sequence(0, place_n - 1)"))
    each = met.select("row", "item", "at", "place", "at_step", "at_n", "place_step", "place_n", F.explode(places).alias("k"))
    first = F.col("at") - F.col("place") - F.col("k") * F.col("place_step")
    step = F.when(one, F.greatest("at_step", "place_step")).otherwise(F.col("at_step"))
    n = F.when(one, F.col("at_n") + F.col("place_n") - 1).otherwise(F.col("at_n"))
    shift = F.struct(first.cast("long").alias("first"), step.cast("long").alias("step"), n.cast("long").alias("n"))
    return each.groupBy(F.col("row").alias("of"), "item").agg(F.collect_set(shift).alias("shifts"))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    min_identity: float = MIN_IDENTITY,
) -> DataFrame:
    """(doc_id, item_id, doc_first, doc_last, item_first, matched, stretch_first, stretch_last, identity): shared passages, in
    token positions.

    Tokens are words in ASCII lower case. A passage counts with at least `min_match` equal tokens (of an item of under
    18 tokens, `min_identity` of them if that is less) and an identity of at least `min_identity`; a passage inside which no
    mask fits on equal tokens is not seen. Items of fewer than LEAST tokens count where a text has all their tokens in a row.
    Items without an id or without tokens are not searched. Null text: empty. Several passages of a document and an
    item give several rows, but of passages whose document tokens overlap (a repetitive text meets an item on many diagonals)
    only the best one is a row, and `stretch_first` and `stretch_last` hold the tokens of all of them; repeated benchmark rows and repeated document rows give the same row once. Documents with a null
    id are reported with a null id. Other columns of the two tables are not read, so their names may clash.
    """
    named = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("item_text"))
    tests = written(named.where("item_id is not null and item_text is not null").distinct().withColumn("key", F.monotonically_increasing_id()), "benchmark")
    seeds = written(tests.select("key", "item_text").mapInArrow(_seeds, "seed long, item long, place int, place_step int, place_n int, mask int"), "seeds")
    masks = [r[0] for r in seeds.select("mask").distinct().orderBy("mask").collect()]  # a fixed table's numbers
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "item_id", *_FOUND[:-1])] + [T.StructField("identity", T.DoubleType())])
    if not masks:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(_bit_set(seeds))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(f"`{text_col}`").alias("text"))
    suspects = texts.mapInArrow(lambda b: _suspects(b, masks, *shared.value), "id long, text string, hits array<struct<seed: long, at: long, at_step: long, at_n: long>>")
    suspects = written(suspects.withColumn("row", F.monotonically_increasing_id()), "suspects")
    hits = suspects.select("row", F.explode("hits").alias("h")).select("row", "h.at", "h.at_step", "h.at_n", F.col("h.seed").alias("own"))
    table = seeds.select("seed", "item", "place", "place_step", "place_n", F.lit(32).alias("bytes"))
    diagonals = written(_diagonals(_met(hits, "own", table, "seed")), "diagonals")
    items = tests.select("key", "item_id", "item_text", F.octet_length("item_text").alias("bytes"))
    pairs = _met(diagonals, "item", items, "key")
    pairs = pairs.join(suspects.select("row", "id", "text"), F.col("of") == F.col("row")).select("id", "item_id", "text", "item_text", "shifts")
    return pairs.mapInArrow(lambda b: _compare(b, min_match, min_identity), schema).distinct()


def contaminated(found: DataFrame) -> DataFrame:
    """One row per document and item: its longest passage."""
    best = F.max_by(F.struct("doc_first", "doc_last", "item_first", "matched", F.round("identity", 6).alias("identity")), F.struct("matched", "identity", -F.col("doc_first"), -F.col("item_first")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b"), F.count("*").alias("n_passages")).select("doc_id", "item_id", "b.*", "n_passages")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` without the contaminated documents; rows with a null id stay."""
    gone = overlaps(docs, benchmark, id_col, **options).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
