"""Prefix tries of conversations: which openings are shared, by whom, and what encoding each of them once would save.

A node is a distinct sequence of first turns. Of the conversations that start with it, the smallest owns it; the deeper a node of a
conversation's path, the fewer members it has, so what a conversation owns is the end of its path. Hence sums over a subtree need no walk:
those over its nodes are, for each member, a sum over the part of its path that it owns, and every such sum is the suffix of a window.

Nodes are told apart by depth and two 64-bit keys: the XOR, over the turns so far, of hashes of (place, MD5 of role and text). XOR has no
order, so prefix keys of a conversation of any length come from blocks of its turns, as its sums do: no task needs a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted_lookup, stage, unstage

#: Turns of a conversation that one window takes, and bits of an id that number the conversations of one chunk of a node's list.
BLOCK, CHUNK_BITS = 4096, 9
#: Conversations of so many consecutive ids share their first turns, in ``shared_openings``, and how many of these they share at most.
FAMILY, OPENING = 100, 5


def _ranked(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked, lengths) of ``ordered_turns``: each turn with its place in the conversation, from 1; (c, own)."""
    blocks = turns.groupBy("c", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("c", "part").orderBy(F.col("t").asc_nulls_first(), "k"))
    placed = turns.withColumn("within", within).join(blocks.select("c", "part", before.alias("before")), ["c", "part"])
    return placed.select("c", "part", (F.col("before") + F.col("within")).alias("pos"), "k", "n"), turns.groupBy("c").agg(F.count("*").alias("own"))


def ordered_turns(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, t, k, n, part), staged: conversation, turn, MD5 of role and text, code points of the text, and the range that the row is in."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), key.alias("k"), F.char_length(text).cast("long").alias("n"))
    # the last column parts repeated rows, of which one conversation may have any number
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("u", F.monotonically_increasing_id()).repartitionByRange(parts, "c", F.col("t").asc_nulls_first(), "k", "u").drop("u")
    return stage(dealt.withColumn("part", F.spark_partition_id()), "turns")


def shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, convs) of ``ordered_turns`` with rebuilt conversations: the first h turns of conversation c - c % FAMILY, then c's own turns
    after its first h, h being the unsigned CRC-32 of c in decimal, modulo OPENING + 1. paths: (c, pos, k, n), staged; convs: (c, size), staged.
    """
    ranked, own = _ranked(turns)
    base = (F.col("c") - F.col("c") % FAMILY).alias("base")
    named = own.select("c", "own", base, (F.crc32(F.col("c").cast("string")) % (OPENING + 1)).alias("h"))
    # a conversation opens at most 2 * FAMILY - 1 others
    sized = named.join(own.select(F.col("c").alias("base"), F.col("own").alias("theirs")), "base", "left")
    taken = F.least("h", F.coalesce("theirs", F.lit(0)))
    convs = stage(sized.select("c", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "convs")
    # (c, part) has no hot key, so facts of a conversation reach its turns through it
    shifts = turns.select("c", "part").distinct().join(convs.select("c", "h", "taken"), "c")
    rest = ranked.join(shifts, ["c", "part"]).where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "k", "n")
    first = ranked.where((F.col("c") % FAMILY == 0) & (F.col("pos") <= OPENING)).select(F.col("c").alias("base"), "pos", "k", "n")
    opening = convs.where("taken > 0").select("c", "base", "taken").join(first, "base").where("pos <= taken").select("c", "pos", "k", "n")
    return stage(rest.unionByName(opening), "paths"), convs.select("c", "size")


def whole_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, convs) of ``ordered_turns`` as they are."""
    ranked, own = _ranked(turns)
    return stage(ranked.drop("part"), "paths"), own.select("c", F.col("own").alias("size"))


def _ends(last: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, c): the SHA-256 of each node's ids, ascending and comma-joined.

    A hash of a list has to see it in order. Lists are joined into chunks of up to 512 ids by all tasks; then a node's chunks, sorted, stream
    through one task, which holds a state of fixed size.
    """
    chunk = F.shiftright("c", CHUNK_BITS).alias("chunk")
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_set("c")), lambda x: x.cast("string")))
    chunks = last.groupBy("pos", "p1", "p2", chunk).agg(ids.alias("ids"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for pos, p1, p2, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (pos, p1, p2) == node:
                    state.update(b"," + text.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (pos, p1, p2), hashlib.sha256(text.encode())
            yield _batch(done)
        if node:
            yield _batch([(*node, state.hexdigest())])

    by = ("pos", "p1", "p2")
    return chunks.repartition(*by).sortWithinPartitions(*by, "chunk").select(*by, "ids").mapInArrow(task, "pos long, p1 long, p2 long, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["pos", "p1", "p2", "ends_sha256"])


def _bit_xor(c: str) -> Column:
    return F.expr(f"bit_xor({c})")


def prefix_trie(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node, of staged ``paths`` (c, pos from 1, k, n) and ``convs`` (c, size: its number of turns):

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree, the
    code points that members after the first repeat) and ends_sha256 (of the members that end here).

    1. Keys and sums along each path: windows over blocks of BLOCK turns, and one over the blocks' totals.
    2. A window over each node's members marks the owner; as only the first row counts, tasks send one row a node, however many members.
    3. A conversation's first owned node is its start. Leaves are owned ends that no start hangs on.
    4. One group-by: a member adds the code points of its path from here on, less those of nodes that it owns, and its leaf.

    No conversations, no nodes; a conversation without turns is a member of the root. Turns of one number are ordered by the MD5 of role and
    text, so equal rows may come in any order. Rows without conversation are in none. Null role and text are empty. Long texts are hashed
    whole. Extra columns and their names don't matter.
    """
    block = F.expr(f"(pos - 1) div {BLOCK}").alias("block")
    hashed = paths.select("c", "pos", "n", block, F.xxhash64("k", "pos").alias("h1"), F.xxhash64(F.lit("second"), "pos", "k").alias("h2"))
    totals = hashed.groupBy("c", "block").agg(_bit_xor("h1").alias("x1"), _bit_xor("h2").alias("x2"), F.sum("n").alias("chars"))
    whole = Window.partitionBy("c")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    offsets = totals.select(
        "c", "block", zero(_bit_xor("x1").over(earlier)).alias("o1"), zero(_bit_xor("x2").over(earlier)).alias("o2"),
        (F.sum("chars").over(whole) - zero(F.sum("chars").over(earlier))).alias("after"),
    )
    so_far = Window.partitionBy("c", "block").orderBy("pos")
    summed = hashed.select("*", _bit_xor("h1").over(so_far).alias("s1"), _bit_xor("h2").over(so_far).alias("s2"), (F.sum("n").over(so_far) - F.col("n")).alias("sn"))
    turns = summed.join(offsets.join(convs, "c"), ["c", "block"]).select(
        "c", "size", "block", "pos", F.col("s1").bitwiseXOR(F.col("o1")).alias("p1"), F.col("s2").bitwiseXOR(F.col("o2")).alias("p2"), "h1", "h2",
        (F.col("after") - F.col("sn")).alias("rest"),
    )
    turns = stage(turns, "prefixes")
    none = F.lit(0).cast("long")
    root = [none.alias("block"), none.alias("pos"), none.alias("p1"), none.alias("p2"), none.alias("h1"), none.alias("h2")]
    rooted = turns.where("pos = 1").select("c", "size", *root, "rest").unionByName(convs.where("size = 0").select("c", "size", *root, none.alias("rest")))
    path = turns.unionByName(rooted)
    by = ("pos", "p1", "p2")

    owner = F.row_number().over(Window.partitionBy(*by).orderBy("c"))
    owned = path.withColumn("r", owner).where("r = 1").select("c", "size", *by, F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("q2"), "rest")
    owned = stage(owned, "owned")
    starts = owned.groupBy("c").agg(F.min(F.struct("pos", "q1", "q2", "rest")).alias("s"))
    above = F.when(F.col("s.pos") > 0, F.struct((F.col("s.pos") - 1).alias("pos"), F.col("s.q1").alias("p1"), F.col("s.q2").alias("p2")))
    starts = stage(starts.select("c", F.col("s.pos").alias("start"), F.col("s.rest").alias("kept"), above.alias("above")), "starts")
    parents = owned.select(F.struct(*by).alias("above"), F.col("c").alias("parent"))
    parented = salted_lookup(starts, "c", "above", parents)
    inner = starts.where("above is not null").select("above").distinct()
    leaves = owned.where("pos = size").select("c", F.struct(*by).alias("above")).join(inner, "above", "left_anti").select("c", F.lit(1).alias("leaf"))
    known = convs.select("c", "size").join(parented.select("c", "start", "kept", "parent"), "c", "left").join(leaves, "c", "left")
    # a long conversation's facts reach its turns block by block
    known = known.select("c", F.explode(F.sequence(none, F.expr(f"greatest(size - 1, 0) div {BLOCK}"))).alias("block"), "start", "kept", "parent", "leaf")

    facts = path.join(known, ["c", "block"]).select(
        *by, F.lit(1).cast("long").alias("one"), F.when(F.col("pos") >= F.col("start"), F.col("c")).alias("conv_id"),
        F.when(F.col("pos") > F.col("start"), F.col("c")).when(F.col("pos") == F.col("start"), F.col("parent")).alias("parent_conv_id"),
        F.when((F.col("pos") + 1 >= F.col("start")) & (F.col("pos") < F.col("size")), 1).otherwise(0).alias("child"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.greatest(F.col("rest") - F.coalesce("kept", none), none).alias("saved"), F.lit(None).cast("string").alias("ends_sha256"),
    )
    ends = _ends(path.where("pos = size").select(*by, "c")).select(
        *by, none.alias("one"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(0).alias("child"), F.lit(0).alias("leaf"), none.alias("saved"), "ends_sha256"
    )
    nodes = facts.unionByName(ends).groupBy(*by).agg(
        F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.sum("one").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
    return nodes.select("conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def opening_trie(df: DataFrame) -> DataFrame:
    """``prefix_trie`` of the conversations with shared openings."""
    turns = ordered_turns(df)
    paths, convs = shared_openings(turns)
    unstage(turns)
    return prefix_trie(paths, convs)
