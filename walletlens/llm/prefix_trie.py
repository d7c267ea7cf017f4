"""Prefix trie of conversations from padded matrices of turn ids.

A turn's id is the MD5 of its role and text. Turns are numbered within their conversation over ranges
of (conversation, turn), so a conversation with a third of all rows is spread over many tasks. Equal
sequences become one row with their number, smallest conversation and the hash of all their
conversations; only that row goes on.

Sequences are cut into blocks of ``WIDTH`` turns. A block belongs to the group of what precedes it, and equal
blocks of a group that do not end a sequence are one row. Rows are dealt in ranges of (group, turn ids), and
a task makes a matrix of its rows: the group, then a number for each turn id, padded with 0. ``numpy.lexsort``
orders it; where neighbouring rows differ in a column or in one before it (an OR accumulated over the
columns), a node of that depth starts, and ``reduceat`` over the starts gives the figures of every depth at
once. Figures are sums over rows or minima, so nodes that touch the border of a range, or lie on a sequence that
goes on in the next block, are added up by their key. A node that two neighbouring ranges both count is
taken off once, from the last row of one and the first of the other. Totals of later blocks reach their
ancestors by doubling the distance they look up, in as many rounds as the number of blocks has binary digits.

Null roles or texts are empty; turns sort by (turn, null first, then id). Rows without a conversation
id belong to none. Repeated rows are turns of their own. Turnless rebuilt conversations end at the root.
Very long texts: only their id and word count are kept. Empty table: no rows. Other columns are not read,
whatever their names.
A node's ``ends_sha256`` hashes its conversations one after the other, so the ids of one sequence stream through
one task, in constant memory. Ids and the sums that stand for sequences have 128 bits and are not proof
against texts made to collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletlens.llm.mixing import word_count
from walletlens.session import materialize

#: Turns of a block, the columns of a matrix.
WIDTH = 64
#: Rows of one matrix, about.
SHARD_ROWS = 20_000
#: Conversations share the first turns of the first of each so many, and most turns shared.
FAMILY, HEADS = 20, 4
#: Repeated rows that are written out at a time.
COPIES = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_ENDS = "length long, head_a decimal(38,0), head_b decimal(38,0), conv_id long, n long, sha string"
_INNER, _SHARED, _GROUP, _THROUGH, _EDGE = range(5)
_NODE = (
    "kind int, key binary, parent binary, up binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, shard int, last boolean, ids binary, words array<long>"
)
_NAMES = [part.split()[0] for part in _NODE.split(", ")]
_TYPES = [pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 7, pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
_ID = 16
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


# --- numbered turns ---------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, pos, id, words), one row per turn, numbered from 0 by (turn, id)."""
    said, words = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    whole = F.concat(F.length(words).cast("string"), F.lit(":"), words, said)
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.unhex(F.md5(whole.cast("binary"))).alias("id"),
        word_count(said).alias("words"),
    )
    rows = rows.groupBy("conv_id", "turn", "id").agg(F.count("*").alias("rows"), F.min("words").alias("words"))
    ranged = rows.repartitionByRange("conv_id", "turn", "id").withColumn("shard", F.spark_partition_id())
    ranged = materialize(ranged, "trie-turns")
    # Of each conversation a row per range that it is in.
    parts = ranged.groupBy("conv_id", "shard").agg(F.sum("rows").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("shard")) - F.col("rows")
    parts = parts.select("conv_id", "shard", before.alias("before")).filter("before > 0")
    within = Window.partitionBy("shard", "conv_id").orderBy("turn", "id")
    ranged = ranged.withColumn("first", F.sum("rows").over(within) - F.col("rows"))
    ranged = ranged.join(parts, ["conv_id", "shard"], "left").withColumn("first", F.col("first") + F.coalesce("before", F.lit(0)))
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(COPIES).cast("long")))
    ranged = ranged.select("conv_id", "first", "id", "words", "rows", some.alias("start"))
    one = F.explode(F.sequence(F.col("start"), F.least(F.col("rows"), F.col("start") + COPIES) - 1))
    return ranged.select("conv_id", "first", "id", "words", one.alias("copy")).select(
        "conv_id", (F.col("first") + F.col("copy")).alias("pos"), "id", "words"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and (conv_id, length) of all of them.

    Conversation c starts with the first h turns of conversation c - c % 20 and goes on with its own
    behind its first h; h is the CRC-32 of its id as text modulo 4.
    """
    turns = materialize(turns, "trie-numbered")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = lengths.select("conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", "taken", "length"), "trie-conversations")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "words")
    heads = turns.filter(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("conv_id", "base", "h"), "base").filter("pos < h").select("conv_id", "pos", "id", "words")
    # Two sums of position-bound hashes stand for a run of turns from the start.
    both = own.unionByName(heads).select(
        "*",
        F.xxhash64("pos", "id").cast("decimal(20,0)").alias("a"),
        F.xxhash64("id", "pos", F.lit("b")).cast("decimal(20,0)").alias("b"),
    )
    return materialize(both, "trie-rebuilt"), convs.select("conv_id", "length")


def _end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence from rows sorted by sequence and conversation."""
    names = [part.split()[0] for part in _ENDS.split(", ")]
    types = [pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.int64(), pa.int64(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    now, first, count, digest = None, None, 0, None
    for batch in batches:
        out = []
        for *key, conv in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if key != now:
                if now is not None:
                    out.append((*now, first, count, digest.hexdigest()))
                now, first, count, digest = key, conv, 0, hashlib.sha256()
            digest.update(f",{conv}".encode() if count else str(conv).encode())
            count += 1
        yield made(out)
    if now is not None:
        yield made([(*now, first, count, digest.hexdigest())])


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Distinct sequences: (conv_id, n, length, sha) with the smallest conversation, their number and their hash."""
    sums = turns.groupBy("conv_id").agg(F.sum("a").alias("head_a"), F.sum("b").alias("head_b"))
    zero = F.lit(0).cast("decimal(38,0)")
    keyed = convs.join(sums, "conv_id", "left").select(
        "length",
        F.coalesce(F.col("head_a").cast("decimal(38,0)"), zero).alias("head_a"),
        F.coalesce(F.col("head_b").cast("decimal(38,0)"), zero).alias("head_b"),
        "conv_id",
    )
    key = ["length", "head_a", "head_b"]
    ends = keyed.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(_end_rows, _ENDS)
    return materialize(ends.select("conv_id", "n", "length", "sha"), "trie-sequences")


def _group_key(block: Column, a: Column, b: Column) -> Column:
    """Number of the block in four bytes, then what stands for all turns before it."""
    before = F.unhex(F.md5(F.concat_ws(",", a.cast("string"), b.cast("string")).cast("binary")))
    return F.concat(F.unhex(F.lpad(F.hex(block), 8, "0")), before)


def blocks(turns: DataFrame, ends: DataFrame, width: int) -> DataFrame:
    """Rows of the matrices: (grp, ids, words, n, conv_id, sha of a sequence that ends here, next group otherwise)."""
    wanted = turns.join(ends.select("conv_id", "n", "length", "sha"), "conv_id")
    cut = wanted.groupBy("conv_id", "n", "length", "sha", F.floor(F.col("pos") / width).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("turns"),
        F.sum("a").cast("decimal(38,0)").alias("a"),
        F.sum("b").cast("decimal(38,0)").alias("b"),
    )
    upto = Window.partitionBy("conv_id").orderBy("block")
    for name in ("a", "b"):
        cut = cut.withColumn(f"to_{name}", F.sum(name).over(upto).cast("decimal(38,0)"))
    before = [(F.col(f"to_{name}") - F.col(name)).cast("decimal(38,0)") for name in ("a", "b")]
    ends_here = F.col("length") <= (F.col("block") + 1) * width
    cut = cut.select(
        _group_key(F.col("block"), *before).alias("grp"),
        F.col("turns.id").alias("ids"),
        F.col("turns.words").alias("words"),
        "n",
        "conv_id",
        F.when(ends_here, F.col("sha")).alias("sha"),
        F.when(~ends_here, _group_key(F.col("block") + 1, F.col("to_a"), F.col("to_b"))).alias("next"),
    )
    cut = materialize(cut, "trie-blocks")
    through = cut.filter("next IS NOT NULL").groupBy("next").agg(
        F.min("grp").alias("grp"),
        F.min("ids").alias("ids"),
        F.min("words").alias("words"),
        F.sum("n").alias("n"),
        F.min("conv_id").alias("conv_id"),
    )
    zero = F.lit(0).cast("decimal(38,0)")
    turnless = ends.filter("length = 0").select(
        _group_key(F.lit(0), zero, zero).alias("grp"),
        F.array().cast("array<binary>").alias("ids"),
        F.array().cast("array<long>").alias("words"),
        "n",
        "conv_id",
        "sha",
        F.lit(None).cast("binary").alias("next"),
    )
    rows = cut.filter("next IS NULL").unionByName(through.withColumn("sha", F.lit(None).cast("string")))
    return materialize(rows.unionByName(turnless), "trie-rows")


# --- the matrices -----------------------------------------------------------------------------


def _key(grp: bytes, ids: bytes) -> bytes:
    return hashlib.blake2b(grp + ids, digest_size=16).digest() if ids else grp


def _node_rows(rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([row.get(name) for row in rows], kind) for name, kind in zip(_NAMES, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


class TurnMatrix:
    """The rows of one range as a padded matrix of turn numbers behind the number of their group, in order."""

    def __init__(self, batch: pa.RecordBatch):
        given = [x or [] for x in batch.column("ids").to_pylist()]
        lengths = np.array([len(x) for x in given], np.int64)
        ids = np.frombuffer(b"".join(x for row in given for x in row), f"V{_ID}")
        groups = batch.column("grp").to_pylist()
        row = np.repeat(np.arange(len(lengths)), lengths)
        column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.deepest = int(lengths.max(initial=0))
        matrix = np.zeros((len(lengths), self.deepest + 1), np.int64)
        matrix[:, 0] = np.unique(np.array([np.void(x) for x in groups]), return_inverse=True)[1]
        matrix[row, column + 1] = np.unique(ids, return_inverse=True)[1] + 1
        words = np.zeros((len(lengths), self.deepest + 2), np.int64)
        words[row, column + 1] = batch.column("words").flatten().to_numpy()
        through = batch.column("next").is_valid().to_numpy(zero_copy_only=False)
        # Of equal rows, the one whose sequence ends comes first.
        order = np.lexsort((through, *matrix.T[::-1]))
        self.matrix, self.words, self.lengths, self.through = matrix[order], words[order], lengths[order], through[order]
        self.n, self.conv = batch.column("n").to_numpy()[order], batch.column("conv_id").to_numpy()[order]
        self.rows = len(order)
        self.given, self.groups = [given[k] for k in order], [groups[k] for k in order]
        self.block = np.array([int.from_bytes(x[:4]) for x in self.groups], np.int64)
        self.sha = batch.column("sha").take(pa.array(order))
        self.next = batch.column("next").take(pa.array(order)).to_pylist()

    def ids(self, k: int, depth: int | None = None) -> bytes:
        return b"".join(self.given[k][:depth])

    def changes(self) -> np.ndarray:
        """Whether a row differs from the one before in a column or in one before that column."""
        differs = np.ones(self.matrix.shape, bool)
        differs[1:] = self.matrix[1:] != self.matrix[:-1]
        return np.logical_or.accumulate(differs, axis=1)


def _levels(m: TurnMatrix, width: int) -> Iterator[pa.RecordBatch]:
    """The nodes of each depth, those of depth 0 standing for their group."""
    change = m.changes()
    depths = np.arange(m.deepest + 1)
    node_starts = change & (m.lengths[:, None] >= depths)
    # From each depth on: words said in every conversation, and words counted once a node.
    said = np.cumsum((m.words[:, 1:] * m.n[:, None])[:, ::-1], axis=1)[:, ::-1]
    once = np.cumsum(np.where(node_starts, m.words[:, :-1], 0)[:, ::-1], axis=1)[:, ::-1]
    leaf = np.zeros(m.rows, np.int64)
    for d in depths:
        starts = np.flatnonzero(change[:, d])
        childless = np.maximum.reduceat(m.lengths, starts) == d
        childless &= ~np.logical_or.reduceat(m.through & (m.lengths == d), starts)
        leaf[starts[childless]] = 1
    keys_above = conv_above = segment_above = None
    for d in depths:
        starts = np.flatnonzero(change[:, d])
        conv = np.minimum.reduceat(m.conv, starts)
        below = node_starts[:, d + 1] if d < m.deepest else np.zeros(m.rows, bool)
        shared = np.logical_or.reduceat(m.through, starts) | (d == 0)
        shared[0] = shared[-1] = True
        is_node = m.lengths[starts] >= d
        keys = np.full(len(starts), None, object)
        for k in np.flatnonzero(shared & is_node).tolist():
            keys[k] = _key(m.groups[starts[k]], m.ids(starts[k], d))
        nothing = np.full(len(starts), None, object)
        above = segment_above[starts] if d else None
        parent = keys_above[above] if d else nothing
        kind = np.where(shared, _GROUP if d == 0 else _SHARED, _INNER)
        if d == 0:
            kind[m.block[starts] == 0] = _SHARED
        ends = (m.lengths[starts] == d) & ~m.through[starts]
        saved = np.add.reduceat(said[:, max(d - 1, 0)], starts) - np.add.reduceat(once[:, d], starts)
        parent_conv = conv_above[above] if d else np.zeros(len(starts), np.int64)
        columns = {
            "kind": pa.array(kind.astype(np.int32)),
            "key": pa.array(keys, pa.binary()),
            "parent": pa.array(parent, pa.binary()),
            "depth": pa.array(m.block[starts] * width + d),
            "conv_id": pa.array(conv),
            "parent_conv_id": pa.array(parent_conv, mask=parent != None if d else np.ones(len(starts), bool)),  # noqa: E711
            "n_convs": pa.array(np.add.reduceat(m.n, starts)),
            "n_children": pa.array(np.add.reduceat(below.astype(np.int64), starts)),
            "n_leaves": pa.array(np.add.reduceat(leaf, starts)),
            "saved_tokens": pa.array(saved),
            "ends": m.sha.take(pa.array(np.where(ends, starts, 0), mask=~ends)),
        }
        made = [columns.get(name, pa.nulls(len(starts), kind)) for name, kind in zip(_NAMES, _TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays(made, _NAMES).filter(pa.array(is_node))
        keys_above, conv_above, segment_above = keys, conv, np.cumsum(change[:, d]) - 1


def _nodes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        m = TurnMatrix(pa.concat_batches(held))
        yield from _levels(m, width)
        out = []
        for k in np.flatnonzero(m.through).tolist():
            end = _key(m.groups[k], m.ids(k))
            out.append({"kind": _THROUGH, "key": m.groups[k], "parent": end, "up": m.next[k], "ids": m.ids(k)})
        for k, last in ((0, False), (m.rows - 1, True)):
            said = m.words[k, 1 : m.lengths[k] + 1].tolist()
            edge = {"kind": _EDGE, "key": m.groups[k], "n_leaves": int(not m.through[k]), "ids": m.ids(k), "words": said}
            out.append({**edge, "shard": TaskContext.get().partitionId(), "last": last})
        yield _node_rows(out)

    return run


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring ranges both counted, as rows that take it off once."""
    for batch in batches:
        out = []
        columns = (batch.column(k).to_pylist() for k in range(5))
        for grp, left, right, words, is_leaf in zip(*columns, strict=True):
            common, most = 0, min(len(left), len(right)) // _ID
            while common < most and left[common * _ID : (common + 1) * _ID] == right[common * _ID : (common + 1) * _ID]:
                common += 1
            twice = is_leaf and common == len(left) // _ID
            inner = grp[:4] != b"\0\0\0\0"
            back = sum(words[:common])
            for d in range(common + 1):
                key = _key(grp, left[: d * _ID])
                child = -1 if d < common else 0
                kind = _GROUP if inner and d == 0 else _SHARED
                figures = {"n_children": child, "n_leaves": -1 if twice else 0, "saved_tokens": back}
                out.append({"kind": kind, "key": key, "n_convs": 0, **figures})
                back -= words[d - 1] if d else 0
        yield _node_rows(out)


def _border_rows(found: DataFrame) -> DataFrame:
    """Rows that correct the figures at the borders of neighbouring ranges."""
    edges = found.filter(F.col("kind") == _EDGE)
    used = edges.filter("last").select("shard").withColumn("next_shard", F.lead("shard").over(Window.orderBy("shard")))
    left = edges.filter("last").join(used, "shard").select("next_shard", F.col("key").alias("grp"), F.col("ids").alias("left"), "words", (F.col("n_leaves") > 0).alias("leaf"))
    right = edges.filter("NOT last").select(F.col("shard").alias("next_shard"), F.col("key").alias("grp"), F.col("ids").alias("right"))
    pairs = left.join(right, ["next_shard", "grp"]).select("grp", "left", "right", "words", "leaf")
    return pairs.mapInArrow(_corrections, _NODE)


def _later_blocks(groups: DataFrame, through: DataFrame) -> DataFrame:
    """Totals of each group with all groups below it: (grp, n_children, n_leaves, saved_tokens).

    Round t knows what lies less than 2^t groups below and asks those exactly 2^t below for theirs.
    """
    above = through.filter(F.substring("key", 1, 4) != F.unhex(F.lit("00000000"))).select(F.col("up").alias("grp"), F.col("key").alias("above"))
    totals = groups.join(above, "grp", "left").select("grp", "n_children", "n_leaves", "saved_tokens", "above")
    while True:
        totals = materialize(totals, "trie-totals")
        lower = totals.filter("above IS NOT NULL")
        if lower.isEmpty():
            return totals.drop("above")
        more = lower.groupBy(F.col("above").alias("grp")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        jump = totals.select(F.col("grp").alias("above"), F.col("above").alias("beyond"))
        totals = totals.join(more, "grp", "left").join(jump, "above", "left").select(
            "grp",
            "n_children",
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
            F.col("beyond").alias("above"),
        )


def _path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies below a sequence that goes on, for each node of its block on the way there."""
    for batch in batches:
        out = []
        columns = (batch.column(k).to_pylist() for k in range(5))
        for grp, ids, children, leaves, saved in zip(*columns, strict=True):
            inner = grp[:4] != b"\0\0\0\0"
            deepest = len(ids) // _ID
            for d in range(1 if inner else 0, deepest + 1):
                figures = {"n_children": children if d == deepest else 0, "n_leaves": leaves, "saved_tokens": saved}
                out.append({"kind": _SHARED, "key": _key(grp, ids[: d * _ID]), "n_convs": 0, **figures})
        yield _node_rows(out)


def trie(
    conversations: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    width: int = WIDTH,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Per node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(numbered_turns(conversations, conv_column, turn_column, role_column, text_column))
    return trie_of(turns, convs, width, shard_rows)


def trie_of(turns: DataFrame, convs: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of sequences given as turns (conv_id, pos, id, words, a, b) and lengths (conv_id, length)."""
    rows = blocks(turns, sequences(turns, convs), width)
    dealt = rows.repartitionByRange(1 + rows.count() // shard_rows, "grp", "ids")
    found = materialize(dealt.mapInArrow(_nodes(width), _NODE), "trie-nodes")
    partial = found.filter(F.col("kind").isin(_SHARED, _GROUP)).unionByName(_border_rows(found))
    through = found.filter(F.col("kind") == _THROUGH)
    added = [F.sum(name).alias(name) for name in _SUMS]
    shared = partial.filter(F.col("kind") == _SHARED)
    if not through.isEmpty():
        groups = partial.filter(F.col("kind") == _GROUP).groupBy(F.col("key").alias("grp")).agg(*added)
        totals = _later_blocks(groups, through).withColumnRenamed("grp", "up")
        paths = through.select("key", "ids", "up").join(totals, "up")
        shared = shared.unionByName(paths.select("key", "ids", "n_children", "n_leaves", "saved_tokens").mapInArrow(_path_rows, _NODE))
        # A block's first nodes hang on the node at the end of the block before.
        last = through.select(F.col("up").alias("parent"), F.col("parent").alias("ended"))
    else:
        last = None
    shared = shared.groupBy("key").agg(
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        *added,
        F.max("ends").alias("ends"),
    )
    shared = materialize(shared, "trie-shared")
    columns = ["parent", "depth", "conv_id", "parent_conv_id", *_SUMS, "ends"]
    nodes = found.filter(F.col("kind") == _INNER).select(*columns).unionByName(shared.select(*columns))
    if last is not None:
        nodes = nodes.join(last, "parent", "left").withColumn("parent", F.coalesce("ended", "parent")).drop("ended")
    above = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    nodes = nodes.join(above, "parent", "left")
    return nodes.select(
        "conv_id",
        "depth",
        F.coalesce("above", "parent_conv_id").alias("parent_conv_id"),
        *_SUMS,
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
