"""The trie of all prefixes of conversations, by collapsing whole sequences.

1. Turns become digests before they are shuffled.  Conversations are rebuilt in one sorted pass per family (20 ids): the
   first turns of the family's first conversation, then the own ones.  The pass keeps one running digest, so a prefix is
   known by 16 bytes and a conversation of any length needs no memory.
2. Conversations with the same last digest are one sequence: its number of conversations (weight), its smallest id (the
   conversation that stands for it) and, apart, the list of ids that end there.
3. A sequence that is a proper prefix of another one is dropped from the leaves by an anti-join.
4. Prefixes of the standing conversations are grouped: sums of weights and leaves, smallest id.  The smallest id owns the
   node; the nodes that a sequence owns are the end of its path, so what a subtree saves is summed from one number per
   sequence, without ever joining a conversation to all nodes above or below.

Hot nodes (the root, a common first turn) are only keys of partial aggregates; the one join on parents sends the few
parents with very many children (at most 100,000 rows by the choice of the limit) to all tasks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wordloom.llm.common import pinned

FAMILY = 20
SHARED = 4  # a conversation takes over 0 to SHARED - 1 turns
IDS = 1 << 14  # of an end list that are put together at once
MANY_CHILDREN, MOST_PARENTS = 10_000, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def turn_rows(conversations: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """``family, first, conv, h, words, digest`` sorted by conversation and turn within partitions by family."""
    conv, said = F.col(id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    family = conv - conv % FAMILY
    rows = conversations.where(conv.isNotNull()).select(
        family.alias("family"),
        (conv != family).alias("other"),
        conv.alias("conv"),
        F.col(turn).alias("turn"),
        (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("int").alias("h"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
        F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said))).alias("digest"),
    )
    rows = rows.repartition("family")
    return rows.sortWithinPartitions("family", "other", "conv", F.asc_nulls_first("turn"), "digest")


class _Rebuild:
    """Nodes along each rebuilt conversation, row by row."""

    names = ("conv", "depth", "node", "parent", "words", "last")

    def __init__(self):
        self.family = self.conv = None
        self.shared: list[tuple[bytes, int]] = []
        self.out: list[tuple] = []

    def _step(self, digest: bytes, words: int) -> None:
        parent, self.node = self.node, hashlib.md5(self.node + digest).digest()
        self.depth += 1
        self.out.append([self.conv, self.depth, self.node, parent, words, False])

    def end(self) -> None:
        if self.conv is not None:
            self.out[-1][5] = True

    def row(self, family: int, other: bool, conv: int, h: int, words: int, digest: bytes) -> None:
        if family != self.family:
            self.end()
            self.family, self.conv, self.shared = family, None, []
        if conv != self.conv:
            self.end()
            self.conv, self.depth, self.node, self.seen = conv, 0, ROOT, 0
            self.out.append([conv, 0, ROOT, None, 0, False])
            if other:
                for known in self.shared[:h]:
                    self._step(*known)
        self.seen += 1
        if not other and len(self.shared) < SHARED - 1:
            self.shared.append((digest, words))
        if not other or self.seen > h:
            self._step(digest, words)

    def take(self, keep: int) -> list[tuple]:
        cut = max(0, len(self.out) - keep)
        done, self.out = self.out[:cut], self.out[cut:]
        return done


ROOT = bytes(16)


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv, depth, node, parent, words, last``: a row per rebuilt conversation and prefix, the empty one included."""
    schema = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())])

    def run(batches):
        state = _Rebuild()

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state.row(*row)
            if rows := state.take(1):
                yield made(rows)
        state.end()
        if rows := state.take(0):
            yield made(rows)

    columns = turns.select("family", "other", "conv", "h", "words", "digest")
    return columns.mapInArrow(run, "conv long, depth long, node binary, parent binary, words long, last boolean")


def end_lists(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: digest of the comma-joined ids of ``ends(node, conv)``, ascending.

    Ids are sorted by range, so a long list is joined in many tasks; only its pieces of text meet in one, in order, where
    they go through the digest one by one.
    """
    pieces = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])

    def join(batches):
        node, ids = None, []

        def piece():
            return pa.RecordBatch.from_pydict({"node": [node], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, schema=pieces)

        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (n != node or len(ids) >= IDS):
                    yield piece()
                    ids = []
                node = n
                ids.append(c)
        if ids:
            yield piece()

    def digest(batches):
        node, state, done = None, None, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["node", "ends_sha256"])

        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids.encode())
            if done:
                yield made()
                done.clear()
        if node is not None:
            done.append((node, state.hexdigest()))
            yield made()

    sorted_ends = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    parts = sorted_ends.mapInArrow(join, "node binary, first long, ids string")
    parts = parts.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return parts.mapInArrow(digest, "node binary, ends_sha256 string")


def _parents(top: DataFrame, nodes: DataFrame, children: DataFrame, n_nodes: int) -> DataFrame:
    """``node, parent_conv_id`` for ``top(node, parent)``: parents with very many children are sent to every task."""
    limit = max(MANY_CHILDREN, n_nodes // MOST_PARENTS)
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    many = children.where(F.col("n_children") > limit).select(F.col("node").alias("parent"))
    heavy = pinned(named.join(many, "parent"))  # at most n_nodes / limit rows
    first = top.join(F.broadcast(heavy), "parent", "left")
    rest = first.where("parent_conv_id IS NULL").drop("parent_conv_id").join(named, "parent")
    return first.where("parent_conv_id IS NOT NULL").select("node", "parent_conv_id").unionByName(rest.select("node", "parent_conv_id"))


def prefix_trie(
    conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per prefix.

    Null roles and texts count as empty, a null turn comes first, equal turns are ordered by the md5 of role and text;
    repeated rows are turns of their own.  Rows without a conversation id are left out.  Other columns are not read.  An
    empty table has no nodes, not even the root, since a node is named after a conversation.
    """
    paths = pinned(rebuilt(turn_rows(conversations, id, turn, role, text)))
    ends = paths.where("last").select("node", "conv", "depth")
    sequences = ends.groupBy("node").agg(F.count("*").alias("weight"), F.min("conv").alias("conv"), F.max("depth").alias("length"))
    sequences = pinned(sequences)
    steps = pinned(paths.drop("last").join(sequences.select("conv", "weight", "length"), "conv"))
    proper = steps.where("depth < length").select("node").distinct()
    leaves = sequences.join(proper, "node", "left_anti").select("conv", F.lit(1).alias("leaf"))
    nodes = pinned(
        steps.join(leaves, "conv", "left")
        .groupBy("node")
        .agg(
            F.min("conv").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.max("parent").alias("parent"),
            F.sum("weight").alias("n_convs"),
            F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"),
            ((F.sum("weight") - 1) * F.max("words")).alias("saved"),
        )
    )
    children = pinned(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    # Along its path a sequence owns the nodes from ``top`` to its end; ``owned`` is what they save.
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("owned"))
    along = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = nodes.withColumn("so_far", F.sum("saved").over(along)).join(owners, "conv_id")
    own = own.withColumn("below", F.col("owned") - F.col("so_far") + F.col("saved")).drop("so_far", "owned")
    others = steps.join(owners.withColumnRenamed("conv_id", "conv"), "conv").where("depth < top").groupBy("node").agg(F.sum("owned").alias("rest"))
    top = own.where("depth = top AND depth > 0").select("node", "parent")
    parents = _parents(top, nodes, children, nodes.count())
    out = own.join(children, "node", "left").join(others, "node", "left").join(parents, "node", "left").join(end_lists(ends), "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") + F.coalesce("rest", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
