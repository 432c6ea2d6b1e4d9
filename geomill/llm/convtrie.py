"""The prefix trie of conversations, by burst tries.

A turn is a unit of bytes: a 128-bit id of its role and text, and its number of words. A conversation is cut into bands of
BAND turns, and each band is a suffix under the trie head that the turns before it spell; a node's id is a hash of its parent's
id and its turn, so heads of all bands are known without walking the trie. Suffixes under one head form a container; equal
ones count once. A container of more than CONTAINER suffixes bursts by the next turn id: each suffix loses its first turn and
moves under the child that this turn makes a node of, until no container is oversized. What remains is dealt to shards by
head, sorted, and swept into nodes with a stack.

Sums over a subtree are sums over members too. A node belongs to its smallest member, so each conversation owns an unbroken
chain of nodes, the deepest on its path. A conversation that is on a node's path but does not own the node owns only nodes
below it. So the sum over a subtree is the sum of what its members own, without what the node's owner owns above it; a second
sweep of the containers, with these totals as weights, gives it for all nodes at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .shared import frequent, lookup, written

UNIT = 20  # bytes of a turn: 16 of its id, 4 of its number of words
BAND = 256  # turns of a suffix at most
CONTAINER = 1000  # suffixes that a container holds at most
GROUP, HEADS = 20, 3  # conversations that share their first turns, and how many at most
BLOCK = 4096  # nodes of a chain that are summed together
JOINED = 256  # ids in a chunk that is hashed on
ROOT = bytes(16)
WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, unit, number): turns with their units, numbered by conversation, turn (null first), role and text."""
    q = lambda c: F.col(f"`{c}`")
    said = conversations.where(q(conv_col).isNotNull()).select(
        q(conv_col).cast("long").alias("conv_id"), q(turn_col).alias("turn"),
        F.coalesce(q(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(q(text_col).cast("string"), F.lit("")).alias("text"),
    )
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    unit = F.unhex(F.concat(name, F.lpad(F.hex(F.regexp_count("text", F.lit(WORD))), 8, "0")))
    said = said.select("conv_id", "turn", unit.alias("unit"), F.concat("role", F.lit("\0"), "text").alias("said"))
    order = ["conv_id", F.col("turn").asc_nulls_first()]
    return number_rows(said, [*order, F.left("said", F.lit(64))], within=[*order, "said"], drop=("said", "turn"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, unit) of the rebuilt conversations, and (conv_id, size) of all of them.

    The first h turns come from the first conversation of each GROUP, h from the id's checksum; then the own turns after the
    first h follow.
    """
    own = turns.groupBy("conv_id").agg(F.min("number").alias("start"), F.count("*").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    own = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1), "base": first})
    bases = own.where(F.col("conv_id") == F.col("base")).select(F.col("base").alias("_base"), F.col("n").alias("_n"))
    heads = F.least("h", F.coalesce("_n", F.lit(0)))
    convs = own.join(bases, F.col("base") == F.col("_base"), "left").withColumn("heads", heads)
    convs = written(convs.select("conv_id", "start", "h", "base", "heads", (F.col("heads") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    starts = convs.select(F.col("conv_id").alias("_conv"), "start", "h", "heads")
    placed = lookup(turns, "conv_id", starts, "_conv", frequent(turns, "conv_id")).withColumn("pos", F.col("number") - F.col("start"))
    placed = written(placed.select("conv_id", "pos", "unit", "h", "heads"), "turns")
    after = placed.where("pos >= h").select("conv_id", (F.col("heads") + F.col("pos") - F.col("h")).alias("pos"), "unit")
    given = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("_base"), "pos", "unit")
    before = convs.where("h > 0").join(given, (F.col("base") == F.col("_base")) & (F.col("pos") < F.col("h"))).select("conv_id", "pos", "unit")
    return after.unionByName(before), convs.select("conv_id", "size")


def _fold(batches, turns: int) -> Iterator[pa.RecordBatch]:
    """The head of each suffix, and the node where its conversation ends, if it ends here. Bands of a conversation come in order."""
    node = ROOT
    for b in batches:
        heads, ends = [], []
        for band, last, seg in zip(b.column("band").to_pylist(), b.column("last").to_pylist(), b.column("seg").to_pylist(), strict=True):
            node = ROOT if band == 0 else node
            heads.append(node)
            for at in range(0, len(seg), UNIT):
                node = md5(node + seg[at : at + 16]).digest()
            ends.append(node if last else None)
        depth = pa.array([band * turns for band in b.column("band").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), depth, pa.array(heads, pa.binary()), b.column("seg"), pa.array(ends, pa.binary())], names=["conv_id", "depth", "head", "seg", "end"])


def suffixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, head, seg, end): the bands of all conversations as suffixes under their heads."""
    band = F.floor(F.col("pos") / BAND).cast("long")
    segs = turns.groupBy("conv_id", band.alias("band")).agg(F.array_sort(F.collect_list(F.struct("pos", "unit"))).alias("units"))  # at most BAND
    seg = F.unhex(F.array_join(F.transform("units", lambda u: F.hex(u["unit"])), ""))
    sizes = convs.select(F.col("conv_id").alias("_conv"), (F.floor((F.col("size") - 1) / BAND)).alias("_last"))
    segs = segs.join(sizes, F.col("conv_id") == F.col("_conv")).select("conv_id", "band", (F.col("band") == F.col("_last")).alias("last"), seg.alias("seg"), "_last")
    segs = written(segs, "bands")
    schema = "conv_id long, depth long, head binary, seg binary, end binary"
    turns_of_band = BAND
    fold = lambda batches: _fold(batches, turns_of_band)
    short = segs.where("_last = 0").drop("_last").mapInArrow(fold, schema)
    long = segs.where("_last > 0").drop("_last").repartition("conv_id").sortWithinPartitions("conv_id", "band").mapInArrow(fold, schema)
    return written(short.unionByName(long), "suffixes")


NODE = "id binary, parent binary, depth long, words long, low long, a long, b long"


def _sweep(batches) -> Iterator[pa.RecordBatch]:
    """Nodes of containers, whose suffixes come sorted by head and turns: the stack holds the nodes of the last suffix."""
    stack: list[list] = []  # id, parent, depth, words, low, a, b
    out: list[list] = []
    now, last = None, b""

    def close(keep: int) -> None:
        while len(stack) > keep:
            done = stack.pop()
            out.append(done)
            if stack:
                above = stack[-1]
                above[4] = min(above[4], done[4])
                above[5] += done[5]
                above[6] += done[6]

    def batch() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in NODE.split(", ")])

    for b in batches:
        for head, depth, seg, low, a, w in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            same = 0
            if head != now:
                close(0)
                now = head
            else:
                most = min(len(last), len(seg))
                while same < most and seg[same : same + UNIT] == last[same : same + UNIT]:
                    same += UNIT
                close(same // UNIT)
            parent = stack[-1][0] if stack else head
            for at in range(same, len(seg), UNIT):
                node = md5(parent + seg[at : at + 16]).digest()
                stack.append([node, parent, depth + at // UNIT + 1, int.from_bytes(seg[at + 16 : at + UNIT]), low, 0, 0])
                parent = node
            top = stack[-1]
            top[4] = min(top[4], low)
            top[5] += a
            top[6] += w
            last = seg
            if len(out) > 20_000:
                yield batch()
                out.clear()
    close(0)
    if out:
        yield batch()


def member_sums(rows: DataFrame) -> DataFrame:
    """Nodes (NODE) below the root of suffixes (head, depth, seg, low, a, b): the least `low` and the sums of a and b over the
    suffixes that start with a node's turns."""
    rows = written(rows.groupBy("head", "depth", "seg").agg(F.min("low").alias("low"), F.sum("a").alias("a"), F.sum("b").alias("b")), "containers")
    turn = F.substring("seg", 1, 16)
    child = F.unhex(F.md5(F.concat("head", turn)))
    words = F.conv(F.hex(F.substring("seg", 17, 4)), 16, 10).cast("long")
    settled, made = [], []
    for _ in range(BAND):  # a suffix loses a turn each time
        big = rows.groupBy("head").agg(F.count("*").alias("_n")).where(F.col("_n") > CONTAINER).select(F.col("head").alias("_head"))
        big = written(big, "oversized")
        if big.isEmpty():
            break
        marked = lookup(rows, "head", big, "_head", frequent(rows, "head"), "left")
        settled.append(marked.where("_head is null").drop("_head"))
        burst = marked.where("_head is not null").drop("_head")
        grown = burst.groupBy(child.alias("id"), F.col("head").alias("parent"), (F.col("depth") + 1).alias("depth"), words.alias("words"))
        made.append(grown.agg(F.min("low").alias("low"), F.sum("a").alias("a"), F.sum("b").alias("b")))
        rest = F.substring("seg", UNIT + 1, UNIT * BAND)
        rows = written(burst.select(child.alias("head"), (F.col("depth") + 1).alias("depth"), rest.alias("seg"), "low", "a", "b").where(F.length("seg") > 0), "containers")
    for part in settled:
        rows = rows.unionByName(part)
    swept = rows.repartition("head").sortWithinPartitions("head", "seg").select("head", "depth", "seg", "low", "a", "b").mapInArrow(_sweep, NODE)
    for part in made:
        swept = swept.unionByName(part)
    return swept


def _chunks(batches, most: int) -> Iterator[pa.RecordBatch]:
    """Up to `most` ids of one end each, joined; rows come sorted by end and id."""
    out, end, ids = [], None, []

    def close() -> None:
        if ids:
            out.append((end, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["end", "first", "ids"])

    for b in batches:
        for at, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if at != end or len(ids) == most:
                close()
                end = at
            ids.append(i)
        if out:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each end, whose chunks come in order."""
    end, state, out = None, None, []
    for b in batches:
        for at, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if at != end:
                if state is not None:
                    out.append((end, state.hexdigest()))
                end, state = at, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out])], names=["_end", "ends_sha256"])
            out.clear()
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([state.hexdigest()])], names=["_end", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(_end, ends_sha256) of (end, conv_id). Ids are joined to chunks in ranges of their order, so those of one end come from
    many tasks; only the digest itself, which has to be taken in order, is one task for each end."""
    most = JOINED
    chunks = ends.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(lambda b: _chunks(b, most), "end binary, first long, ids string")
    return chunks.repartition("end").sortWithinPartitions("end", "first").select("end", "ids").mapInArrow(_digests, "_end binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, the textless root included: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role, then text; null role or text: empty. Rows of a null conv_id belong to no
    conversation and are left out. Repeated rows are turns of their own; other columns are not read. Conversations and texts
    have any length. An empty table has no nodes. Turns are compared by 128-bit hashes.
    """
    turns, convs = rebuilt(numbered_turns(conversations, conv_col, turn_col, role_col, text_col))
    held = suffixes(turns, convs)
    root = F.lit(bytearray(ROOT))
    found = member_sums(held.select("head", "depth", "seg", F.col("conv_id").alias("low"), F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = found.select("id", "parent", "depth", "words", F.col("low").alias("conv_id"), F.col("a").alias("n_convs"))
    zero = F.lit(0).cast("long")
    nodes = written(nodes.unionByName(top.select(root.alias("id"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("words"), "conv_id", "n_convs")), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("n_children"))
    owners = nodes.select(F.col("id").alias("_parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = lookup(nodes, "parent", owners, "_parent", frequent(nodes, "parent"), "left").drop("_parent")
    nodes = nodes.join(children.hint("merge"), F.col("id") == F.col("_of"), "left").drop("_of").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = written(nodes.withColumn("saving", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    owned = nodes.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum("saving").alias("a"), F.sum((F.col("n_children") == 0).cast("long")).alias("b")).where("a > 0 or b > 0")
    owned = written(owned, "owned")
    weighted = held.select("conv_id", "head", "depth", "seg").join(owned.hint("merge"), F.col("conv_id") == F.col("_conv")).withColumnRenamed("conv_id", "low")
    sums = member_sums(weighted).select(F.col("id").alias("_id"), "a", "b")
    sums = sums.unionByName(owned.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select(root.alias("_id"), "a", "b"))

    block = F.floor(F.col("depth") / BLOCK).cast("long")
    above = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = nodes.groupBy("conv_id", block.alias("block")).agg(F.sum("saving").alias("_s")).withColumn("_before", F.sum("_s").over(above)).where("_before > 0")
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "_before")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("block", block).withColumn("_inside", F.sum("saving").over(inside))
    nodes = nodes.join(blocks, (F.col("conv_id") == F.col("_conv")) & (F.col("block") == F.col("_block")), "left")

    ends = held.where("end is not null").select("end", "conv_id").unionByName(convs.where("size = 0").select(root.alias("end"), "conv_id"))
    out = nodes.join(sums.hint("merge"), F.col("id") == F.col("_id"), "left").join(end_digests(ends).hint("merge"), F.col("id") == F.col("_end"), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("b", zero).alias("n_leaves"),
        (F.coalesce("a", zero) - F.coalesce("_inside", zero) - F.coalesce("_before", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
