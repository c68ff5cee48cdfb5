"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt in ranges of ids to tasks, and there to shards of at most
``SHARD`` conversations.  A shard keeps one bitmap of conversations for each
(position, turn).  Depth first, the bitmap of a node is intersected with the bitmaps
of the turns at the next position: what is left are its children, the set bits are
their members, and a bitmap of those that end at a depth gives the end lists.

Nodes carry a 128-bit digest of their path, by which Spark adds up the shards.  Sums
over subtrees go back through the shards: every node belongs to the shard of its
smallest member, which adds it to the nodes above it.  Shards are ranges of ids in
order, so the end lists of a node, taken shard by shard, are in ascending order, and
their hash is fed from a sorted stream that never holds a list.

``rebuild`` says how conversations are put together first: with ``opening``, the
conversation c starts with the first ``opening(c)`` turns of the first conversation of
its family of five, c - c % 5, and goes on with its own turns after as many.

Defined cases: null turns come first, equal turns are ordered by a digest of role and
text; null role or text is empty; rows without a conv_id belong to no conversation;
repeated rows are turns of their own; a conversation without turns is a member of the
root; no conversation gives no node.  Other columns are not read.  A task holds the
digests of the turns of one shard, or of one conversation where that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.session import discard, durable

#: Conversations of a shard; those of one family stay together.
SHARD = 2048
FAMILY = 5
ROOT = bytes(16)
#: SHA-256 of nothing, for nodes where no conversation ends.
NOTHING = hashlib.sha256().hexdigest()

LOCAL = "shard long, path binary, parent binary, depth long, n_convs long, conv_id long, n_bytes long, ends array<long>"

Turn = tuple[int, int, int]
Rebuild = Callable[[dict[int, list[Turn]]], dict[int, list[Turn]]]


def as_they_are(family: dict[int, list[Turn]]) -> dict[int, list[Turn]]:
    """Conversations as they stand in the table."""
    return family


def with_opening(family: dict[int, list[Turn]]) -> dict[int, list[Turn]]:
    """The first ``crc32(c) % 9`` turns of the first of the family, then the own turns after as many."""
    out = {}
    for conv, own in family.items():
        h = crc32(str(conv).encode()) % 9
        out[conv] = family.get(family_of(conv), [])[:h] + own[h:]
    return out


def family_of(conv: int) -> int:
    """``conv - conv % 5``, where the remainder has the sign of ``conv``, as in SQL."""
    rest = abs(conv) % FAMILY
    return conv - (rest if conv >= 0 else -rest)


def bits_of(bitmap: int) -> Iterator[int]:
    """Positions of the set bits, ascending."""
    while bitmap:
        low = bitmap & -bitmap
        yield low.bit_length() - 1
        bitmap ^= low


def shard_nodes(convs: list[tuple[int, list[Turn]]]) -> Iterator[tuple[bytes, bytes, int, int, int, int, list[int]]]:
    """Nodes of the trie of some conversations, ascending by id: path, parent, depth, members, least member, bytes of the last text, ends.

    A turn is two longs of a digest and the bytes of its text.
    """
    ids = [c for c, _ in convs]
    postings: dict[tuple[int, int, int], int] = {}
    ends: dict[int, int] = {}
    for i, (_, turns) in enumerate(convs):
        for position, (a, b, _) in enumerate(turns):
            key = (position, a, b)
            postings[key] = postings.get(key, 0) | 1 << i
        ends[len(turns)] = ends.get(len(turns), 0) | 1 << i
    stack = [((1 << len(ids)) - 1, 0, ROOT, ROOT, 0)]
    while stack:
        members, depth, path, parent, n_bytes = stack.pop()
        over = members & ends.get(depth, 0)
        first = (members & -members).bit_length() - 1
        yield path, parent, depth, members.bit_count(), ids[first], n_bytes, [ids[i] for i in bits_of(over)]
        rest = members & ~over
        while rest:
            one = (rest & -rest).bit_length() - 1
            a, b, size = convs[one][1][depth]
            child = rest & postings[depth, a, b]
            rest &= ~child
            under = hashlib.blake2b(path + a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True), digest_size=16).digest()
            stack.append((child, depth + 1, under, path, size))


def _nodes(rebuild: Rebuild, most: int):
    """Turns (conv_id, a, b, n_bytes) in order of conversations to nodes of shards."""

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Turn]]]:
        conv, turns = None, []
        for rows in batches:
            ids, *turn = (rows.column(n).to_pylist() for n in ("conv_id", "a", "b", "n_bytes"))
            for c, t in zip(ids, zip(*turn)):
                if c != conv:
                    if conv is not None:
                        yield conv, turns
                    conv, turns = c, []
                turns.append(t)
        if conv is not None:
            yield conv, turns

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, list[Turn]]]]:
        held, family = [], {}
        for conv, turns in conversations(batches):
            if family and family_of(conv) != family_of(next(iter(family))):
                held += rebuild(family).items()
                family = {}
                if len(held) >= most:
                    yield held
                    held = []
            family[conv] = turns
        held += rebuild(family).items()
        if held:
            yield held

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        schema = pa.schema([(n, k) for n, k in zip("path parent depth n_convs conv_id n_bytes ends".split(), [pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64())])])
        for i, convs in enumerate(shards(batches)):
            number, rows = (task << 32) + i, []

            def batch() -> pa.RecordBatch:
                columns = [pa.array(x, k) for x, k in zip(zip(*rows), schema.types)]
                return pa.record_batch([pa.array(np.full(len(rows), number)), *columns], ["shard", *schema.names])

            for row in shard_nodes(convs):
                rows.append(row)
                if len(rows) == 10_000:
                    yield batch()
                    rows.clear()
            if rows:
                yield batch()

    return stream


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes by shard, deepest first, to what a shard adds to each node: its leaves and saved tokens."""
    shard, below = None, {}
    for rows in batches:
        out = []
        for number, path, parent, depth, leaf, saved in zip(*(c.to_pylist() for c in rows.columns)):
            if number != shard:
                shard, below = number, {}
            add = below.pop(path, (0, 0))
            leaves, tokens = add[0] + leaf, add[1] + saved
            if depth:
                more = below.get(parent, (0, 0))
                below[parent] = (more[0] + leaves, more[1] + tokens)
            out.append((path, leaves, tokens))
        if out:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), [pa.binary(), pa.int64(), pa.int64()])], ["path", "n_leaves", "saved_tokens"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """End lists by path and shard to one hash for each path."""
    path, state = None, None

    def batch(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([p for p, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())], ["path", "ends_sha256"])

    for rows in batches:
        done = []
        for p, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if p != path:
                if state is not None:
                    done.append((path, state.hexdigest()))
                path, state = p, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
        if done:
            yield batch(done)
    if state is not None:
        yield batch([(path, state.hexdigest())])


def prefix_trie(convs: DataFrame, rebuild: Rebuild = with_opening, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, turn, role, text).

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the parent (null at
    the root); ``n_leaves`` counts childless nodes of the subtree and ``saved_tokens``
    adds up, over the subtree, the bytes that members after the first need not repeat.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("turn"), text, role).alias("b"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    dealt = turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).repartitionByRange("family")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "a", "b").select("conv_id", "a", "b", "n_bytes")
    local = durable(dealt.mapInArrow(_nodes(rebuild, shard), LOCAL))

    nodes = durable(local.groupBy("path").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.min("n_bytes").alias("n_bytes"),
    ))
    inner = nodes.where("depth > 0")
    kids = durable(inner.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children")))
    # A node may hold most of all children (the root does): the small side is stored, so that the split of hot keys can act.
    above = durable(nodes.join(kids, "path").select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    tree = nodes.join(kids, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    parents = inner.select("path", "parent").join(above, "parent").select("path", "parent_conv_id")
    tree = durable(tree.join(parents, "path", "left"))

    least = F.col("l.conv_id") == F.col("t.conv_id")
    parts = local.alias("l").join(tree.alias("t"), F.col("l.path") == F.col("t.path")).select(
        "l.shard", "l.path", "l.parent", "l.depth",
        F.when(least & (F.col("t.n_children") == 0), 1).otherwise(0).cast("long").alias("leaf"),
        F.when(least, (F.col("t.n_convs") - 1) * F.col("t.n_bytes")).otherwise(0).cast("long").alias("saved"),
    )
    deepest = parts.repartition("shard").sortWithinPartitions("shard", F.desc("depth"))
    sums = deepest.mapInArrow(_sums, "path binary, n_leaves long, saved_tokens long").groupBy("path").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    over = local.where(F.size("ends") > 0).select("path", "ends", "shard").repartition("path").sortWithinPartitions("path", "shard")
    hashes = over.select("path", "ends").mapInArrow(_hashes, "path binary, ends_sha256 string")
    found = tree.join(sums, "path").join(hashes, "path", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    out = durable(found)
    discard(local, nodes, kids, above, tree)
    return out
