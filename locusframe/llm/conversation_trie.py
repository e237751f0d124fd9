"""Prefix trie of conversations: subtree totals by leaf peeling, paths of single messages contracted first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import final_table, materialise
from locusframe.operators.scan import running

#: Turns of one block of a conversation, as a power of two, when what is known of a conversation is joined to its turns; ids of one piece of a list of ends.
_BLOCK, _PIECE = 12, 12
#: Parents of many children that are broadcast, at most; a parent has many from _LEAST on.
_PARENTS, _LEAST = 50_000, 4096
_NODE = ["depth", "p1", "p2"]


def turn_order() -> tuple[list[Column], list[Column]]:
    """The order of a conversation's turns, and what they are dealt by: beginnings, as texts may be long."""
    turn = F.col("turn").asc_nulls_first()
    return [turn, F.col("role"), F.col("text")], [turn, F.substring("role", 1, 16), F.substring("text", 1, 32)]


def numbered(df: DataFrame) -> DataFrame:
    """(conv_id, nth, h1, h2, bytes): the turns of each conversation from 1 by turn (null first), role and text, with 128 bits of hash of role and text, and the text's UTF-8 bytes. Rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select("*", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"), F.octet_length("text").cast("long").alias("bytes"))
    order, ranges = turn_order()
    return running(rows, ["conv_id"], order, {"nth": ("sum", F.lit(1).cast("long"))}, ["conv_id", "h1", "h2", "bytes"], "turns", ranges)


def grafted(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """numbered() turns after each conversation c began like its family's: the first h turns of c - c % family, then its own after its first h, where h = crc32(c) % (most + 1).

    Gives turns (conv_id, pos from 1, size, h1, h2, bytes), and conversations (conv_id, size), also those without turns.
    % has the sign of c.
    """
    c, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    sizes = materialise(turns.groupBy("conv_id").agg(F.max("nth").alias("n")), "sizes")
    convs = sizes.select(c, "n", h.alias("h"), (c - c % family).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("b_id"), F.col("n").alias("b_n"))
    convs = convs.join(bases, F.col("base") == F.col("b_id"), "left").withColumn("taken", F.least("h", F.coalesce("b_n", F.lit(0).cast("long"))))
    convs = materialise(convs.select("conv_id", "n", "h", "base", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    first = turns.where(F.col("nth") <= most).withColumnRenamed("conv_id", "f_id")  # most rows a conversation, for the few of a family
    head = convs.join(first, (F.col("base") == F.col("f_id")) & (F.col("nth") <= F.col("h"))).select("conv_id", F.col("nth").alias("pos"), "size", "h1", "h2", "bytes")
    # Own turns meet what is known of their conversation in blocks of turns, as one may be long.
    known = convs.select(F.col("conv_id").alias("k_id"), "h", "taken", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("n", _BLOCK))).alias("k_block"))
    own = turns.join(known, (F.col("conv_id") == F.col("k_id")) & (F.shiftright("nth", _BLOCK) == F.col("k_block"))).where("nth > h")
    own = own.select("conv_id", (F.col("taken") + F.col("nth") - F.col("h")).alias("pos"), "size", "h1", "h2", "bytes")
    return head.unionAll(own), convs.select("conv_id", "size")


def _with_parents(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """nodes and n_children, parent_conv_id and parent_guide. Parents of many children are few, so they are broadcast; the others are joined by key."""
    nodes = materialise(nodes.join(counts.toDF(*[f"c_{k}" for k in _NODE], "n"), [F.col(k) == F.col(f"c_{k}") for k in _NODE], "left").select(*nodes.columns, F.coalesce("n", F.lit(0).cast("long")).alias("n_children")), "nodes")
    many = max(_LEAST, nodes.count() // _PARENTS)  # fewer than _PARENTS nodes have more children
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("a_depth"), F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("conv_id").alias("parent_conv_id"), F.col("guide").alias("parent_guide"), F.col("n_children").alias("a_n"))
    is_parent = (F.col("depth") - 1 == F.col("a_depth")) & (F.col("q1") == F.col("a1")) & (F.col("q2") == F.col("a2"))
    busy = parents.where(F.col("a_n") > many)
    out = [*nodes.columns, "parent_conv_id", "parent_guide"]
    tried = nodes.where("depth > 0").join(F.broadcast(busy), is_parent, "left")
    rest = tried.where("a_n is null").select(*nodes.columns).join(parents.where(F.col("a_n") <= many), is_parent)
    null = F.lit(None).cast("long")
    return nodes.where("depth = 0").select(*nodes.columns, null.alias("parent_conv_id"), null.alias("parent_guide")).unionAll(tried.where("a_n is not null").select(*out)).unionAll(rest.select(*out))


def peeled(paths: DataFrame) -> DataFrame:
    """(path, parent, at, saved, leaves): the totals of whole subtrees, from each path's own.

    paths has path, parent (null: the root's), at (the place on the parent's path) and own totals. Paths hold how many
    paths below still have to report. In each round those without any finish, and send their totals to their parents,
    until the root's path has finished.
    """
    below = paths.where("parent is not null").groupBy(F.col("parent").alias("b")).agg(F.count("*").alias("remaining"))
    active = paths.join(below, F.col("path") == F.col("b"), "left").select("path", "parent", "at", "saved", "leaves", F.coalesce("remaining", F.lit(0).cast("long")).alias("remaining"))
    active, finished = materialise(active, "active"), []
    while True:
        done, left = active.where("remaining = 0"), active.where("remaining > 0")
        finished.append(done)
        if left.isEmpty():
            return reduce(DataFrame.unionAll, finished)
        sent = done.groupBy(F.col("parent").alias("to")).agg(F.count("*").alias("n"), F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        zero = F.lit(0).cast("long")
        got = left.join(sent, F.col("path") == F.col("to"), "left")
        active = materialise(got.select("path", "parent", "at", *[(F.col(a) + F.coalesce(b, zero)).alias(a) for a, b in (("saved", "s"), ("leaves", "l"))], (F.col("remaining") - F.coalesce("n", zero)).alias("remaining")), "active")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each node, which come sorted; one state is held."""
    key, state = None, None
    for b in batches:
        out = []
        for *node, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if node != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield _batch(out)
    if state is not None:
        yield _batch([(*key, state.hexdigest())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["e_depth", "e1", "e2", "ends_sha256"])


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns has (conv_id, pos, size, h1, h2, bytes), with positions from 1 without gaps and size turns each; convs has
    (conv_id, size) of all conversations. A node is a sequence of first turns that some conversation has; its members
    are those that have it. conv_id is its least member. n_leaves and saved_tokens ((n_convs - 1) times the bytes of
    the last text, summed) are of the node's subtree, with it. ends_sha256 is of the ids of members that end there,
    ascending, comma-joined. Sequences are equal if 128 bits of hash are. No conversations give no rows.

    A node is named by its depth and the exclusive or of its turns' hashes with their places, a prefix scan. Each node
    has a guide, the member with the least hash of its id: going down from a node the guide stays as long as it is a
    member, so the nodes of one guide are a path, and a way from a leaf to the root meets new guides about log(members)
    times. Paths are contracted to one node each and peeled in rounds, as many as that. In the end totals are summed up
    along each path.
    """
    term = lambda h: F.xxhash64("pos", h)
    placed = turns.select("conv_id", "pos", "size", "bytes", term("h1").alias("t1"), term("h2").alias("t2"))
    placed = materialise(running(placed, ["conv_id"], ["pos"], {"p1": ("xor", F.col("t1")), "p2": ("xor", F.col("t2"))}, name="prefixes"), "placed")
    lot = F.struct(F.xxhash64("conv_id"), "conv_id")
    about = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(lot)["conv_id"].alias("guide")]
    # What is before a node's own turn is its parent's name.
    before = [F.first(F.col(p).bitwiseXOR(F.col(t))).alias(q) for p, t, q in (("p1", "t1", "q1"), ("p2", "t2", "q2"))]
    nodes = placed.groupBy(F.col("pos").alias("depth"), "p1", "p2").agg(*about, F.max("bytes").alias("bytes"), *before)
    zero = F.lit(0).cast("long")
    root = convs.agg(*about).where("n_convs > 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", "guide", zero.alias("bytes"), zero.alias("q1"), zero.alias("q2"))
    nodes = materialise(nodes.unionAll(root), "names")
    counts = nodes.where("depth > 0").groupBy(F.col("depth") - 1, "q1", "q2").count()
    nodes = materialise(_with_parents(nodes, counts).select(*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "guide", "parent_guide", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves")), "linked")

    own = nodes.groupBy(F.col("guide").alias("path")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    tops = nodes.where("parent_guide is null or parent_guide != guide").select(F.col("guide").alias("t"), F.col("parent_guide").alias("parent"), (F.col("depth") - 1).alias("at"))
    totals = peeled(own.join(tops, F.col("path") == F.col("t")).select("path", "parent", "at", "saved", "leaves"))
    got = totals.where("parent is not null").groupBy("parent", "at").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    nodes = nodes.join(got, (F.col("guide") == F.col("parent")) & (F.col("depth") == F.col("at")), "left")
    nodes = nodes.select(*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "guide", (F.col("saved") + F.coalesce("s", zero)).alias("v"), (F.col("leaves") + F.coalesce("l", zero)).alias("w"))
    nodes = running(nodes, ["guide"], [F.col("depth").desc()], {"saved_tokens": ("sum", F.col("v")), "n_leaves": ("sum", F.col("w"))}, name="sums")

    ends = placed.where("pos = size").select(F.col("pos").alias("depth"), "p1", "p2", "conv_id").unionAll(convs.where("size = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id"))
    pieces = ends.groupBy(*_NODE, F.shiftright("conv_id", _PIECE).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ends = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "piece").mapInArrow(_hash_ends, "e_depth long, e1 long, e2 long, ends_sha256 string")
    nodes = nodes.join(ends, (F.col("depth") == F.col("e_depth")) & (F.col("p1") == F.col("e1")) & (F.col("p2") == F.col("e2")), "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(df: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """trie() of the conversations of df (conv_id, turn, role, text, whatever else) after grafted().

    Turns are ordered by turn (null first), then role and text; null role or text counts as empty, and a repeated row is
    a turn of its own. Rows without conv_id are left out. An empty df gives an empty result.
    """
    return final_table(lambda: materialise(trie(*grafted(numbered(df), family, most)), "trie"))
