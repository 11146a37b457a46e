"""Conversation prefix trie by time-forward processing.

Conversations that begin with the same turns share them; the trie's nodes are
the distinct sequences of first turns, and every subtree's totals come from one
pass in reverse level order.

1. Turns are put in order by ranges of (conversation, turn, role, text), so that
   one conversation may spread over many tasks; a rank within a task plus the
   turns of the tasks before it (at most one number a task) is a turn's place.
2. A prefix is known by the sum of its turns' hashes, each hash salted with the
   turn's place: 128 bits in four lanes.  Sums of blocks of turns add up, so that
   a long conversation needs no single task here either.
3. A node is a group of equal (depth, sum): smallest member, members, and the
   turns of its members from here on, its weight.
4. Subtrees of weight at most ``shard`` (or a 4096th of all turns, if that is
   more) are shards; what lies above is the crown, at most 4096 nodes a level.
   The nodes of each task's shards are sorted outside of memory in reverse level
   order; each passes its totals to its parent through a priority queue that
   spills, and reads what its children passed.  Totals that shard roots pass into
   the crown are summed by parent, and the crown is processed in the same way.
5. The ends of a node, ids in order, are written as chunks by ranges of (node,
   id) and hashed as a stream.

Rows without conv_id belong to no conversation.  Null turns come first, and equal
turns are ordered by role and text; null roles and texts are empty; repeated rows
are turns of their own.  Other columns are not read.  Without conversations there
is no node.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.llm.common import materialize

SHARD = 1_000  # turns of a shard's members, at least
SHARDS = 4096  # so many shards' worth of turns lie above the crown's lowest nodes
BLOCK = 4096  # turns whose hashes are summed in one window
HELD = 200_000  # messages that a queue keeps in memory
CHUNK = 20_000  # ids written as one text
FAMILY = 100  # conversations whose ids share the hundreds take their first turns from the first of them
HEAD = 6  # at most HEAD - 1 of them
_MASK = (1 << 32) - 1
_LANES = ("s0", "s1", "s2", "s3")
_KEY = ("depth", "k1", "k2")


# --- turns and prefixes ----------------------------------------------------------------------------------------------

def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(c, j, x, len): conversation, place from 1, digest of (role, text), code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), text.alias("text"))
    by = ["c", "turn", "role", "text"]
    rows = (rows.repartitionByRange(*by).sortWithinPartitions(*by)
            .select("c", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("x"),
                    F.length("text").cast("long").alias("len"), F.spark_partition_id().alias("pid")))

    def rank(batches):
        last, seen = None, 0
        for b in batches:
            c = b.column(0).to_numpy(zero_copy_only=False)
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
            k = np.arange(len(c)) - begin + 1
            if len(c) and last == c[0]:
                k[begin == 0] += seen
            if len(c):
                last, seen = c[-1], int(k[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int64())], names=["c", "x", "len", "pid", "k"])

    ranked = materialize(rows.mapInArrow(rank, "c long, x string, len long, pid int, k long"), "turns")
    parts = ranked.groupBy("c", "pid").agg(F.max("k").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.withColumn("before", before).where("before > 0").select(F.col("c").alias("b_c"), F.col("pid").alias("b_pid"), "before")
    # only a task's first conversation can have begun in one before it: at most one row a task
    return (ranked.join(F.broadcast(carried), (F.col("c") == F.col("b_c")) & (F.col("pid") == F.col("b_pid")), "left")
            .select("c", (F.col("k") + F.coalesce("before", F.lit(0))).alias("j"), "x", "len"))


def rebuilt(turns: DataFrame, family: int = FAMILY, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """The conversations (c, m, h, turns) and their rebuilt turns (c, p, x, len, size): the first h turns of the
    family's first conversation, then the own turns after the first h."""
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % head).cast("long")
    convs = convs.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % family).alias("base"))
    first = convs.select(F.col("c").alias("f_c"), F.col("n").alias("f_n"))
    convs = convs.join(first, F.col("base") == F.col("f_c"), "left").select(
        "c", "base", "h", F.least("h", F.coalesce("f_n", F.lit(0))).alias("m"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    convs = materialize(convs.withColumn("size", F.col("m") + F.col("own")).drop("own"), "conversations")
    mine = (turns.join(convs.select(F.col("c").alias("o_c"), "h", "m", "size"), F.col("c") == F.col("o_c")).where("j > h")
            .select("c", (F.col("m") + F.col("j") - F.col("h")).alias("p"), "x", "len", "size"))
    lent = (turns.where(F.col("j") < head).select(F.col("c").alias("f_c"), "j", "x", "len")
            .join(convs.where("m > 0"), F.col("f_c") == F.col("base")).where("j <= m").select("c", F.col("j").alias("p"), "x", "len", "size"))
    return convs, mine.unionByName(lent)


def _words(salt: int) -> list[Column]:
    """Two lanes of 32 bits of a turn at its place."""
    x = F.xxhash64(F.lit(salt), F.col("p"), F.col("x"))
    return [F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_MASK))]


def _key(lanes: list[Column]) -> list[Column]:
    a, b, c, d = (x.bitwiseAND(F.lit(_MASK)) for x in lanes)
    return [F.shiftleft(a, 32).bitwiseOR(b), F.shiftleft(c, 32).bitwiseOR(d)]


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(c, depth, k1, k2, p1, p2, len, size): the prefix that ends with each turn, and the one before it."""
    rows = turns.withColumn("block", F.floor((F.col("p") - 1) / F.lit(block)))
    rows = rows.withColumns({f"t{i}": w for i, w in enumerate(_words(1) + _words(2))}).drop("x")
    so_far = Window.partitionBy("c", "block").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({s: F.sum(f"t{i}").over(so_far) for i, s in enumerate(_LANES)})
    totals = rows.where(F.col("size") > block).groupBy("c", "block").agg(*[F.sum(f"t{i}").alias(f"b{i}") for i in range(4)])
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("c").alias("b_c"), F.col("block").alias("b_block"),
                           *[F.sum(f"b{i}").over(earlier).bitwiseAND(F.lit(_MASK)).alias(f"b{i}") for i in range(4)]).where("b_block > 0")
    sums = sums.join(totals, (F.col("c") == F.col("b_c")) & (F.col("block") == F.col("b_block")), "left")
    here = [F.col(s) + F.coalesce(f"b{i}", F.lit(0)) for i, s in enumerate(_LANES)]
    k, p = _key(here), _key([x - F.col(f"t{i}") for i, x in enumerate(here)])
    return sums.select("c", F.col("p").alias("depth"), k[0].alias("k1"), k[1].alias("k2"), p[0].alias("p1"), p[1].alias("p2"), "len", "size")


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id, parent_conv_id, n_convs, own, weight); a node's id is (conv_id, depth)."""
    nodes = rows.groupBy(*_KEY).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
                                    F.max("len").alias("len"), F.sum(F.col("size") - F.col("depth") + 1).alias("weight"))
    root = convs.agg(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.min("c").alias("conv_id"),
                     F.count(F.lit(1)).alias("n_convs"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
                     F.lit(0).cast("long").alias("len"), F.coalesce(F.sum("size"), F.lit(0)).alias("weight")).where("n_convs > 0")
    nodes = materialize(nodes.unionByName(root), "nodes")
    up = nodes.select((F.col("depth") + 1).alias("u_d"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"),
                      F.col("weight").alias("parent_weight"))
    return (nodes.join(up, (F.col("depth") == F.col("u_d")) & (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2")), "left")
            .select(*_KEY, "conv_id", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("len")).alias("own"), "weight", "parent_weight"))


# --- time-forward processing -----------------------------------------------------------------------------------------

class SpillingQueue:
    """Messages (minus depth, conversation, leaves, saved) by the smallest of the first two; past ``held`` they
    go to an unnamed scratch file as a sorted run, which is read back a block at a time."""

    BLOCK = 4096

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs, self.spills = held, [], [], 0

    def push(self, message: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        own = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.path.isdir(d)]
        f = tempfile.TemporaryFile(dir=own[0] if own else None)  # where Spark's own sorts spill; no name, gone with the task
        self.heap.sort()
        f.write(np.array(self.heap, np.int64).tobytes())
        f.seek(0)
        self.heap, self.spills = [], self.spills + 1
        run = self._read(f)
        self.runs.append((next(run), self.spills, run))
        heapq.heapify(self.runs)

    def _read(self, f) -> Iterator[tuple[int, int, int, int]]:
        with f:
            while raw := f.read(32 * self.BLOCK):
                yield from map(tuple, np.frombuffer(raw, np.int64).reshape(-1, 4).tolist())

    def take(self, place: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
        """All messages for ``place``, which leave the queue."""
        while self.heap and self.heap[0][:2] == place:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:2] == place:
            message, n, run = self.runs[0]
            yield message
            if (then := next(run, None)) is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (then, n, run))


_NODE = ("depth", "k1", "k2", "conv_id", "parent_conv_id", "n_convs", "own", "in_children", "in_leaves", "in_saved", "parent_here")
_DONE = ("depth", "k1", "k2", "conv_id", "parent_conv_id", "n_convs", "parent_here", "n_children", "n_leaves", "saved_tokens")


def forward(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """Totals of the nodes of each partition, in reverse level order.  Nodes without ``parent_here`` pass theirs on
    by their row."""
    def run(batches):
        queue = SpillingQueue(held)
        for b in batches:
            out = [[], [], []]
            cols = {c: b.column(i).to_pylist() for i, c in enumerate(_NODE)}
            for depth, conv, parent, own, children, leaves, saved, here in zip(*(cols[c] for c in (
                    "depth", "conv_id", "parent_conv_id", "own", "in_children", "in_leaves", "in_saved", "parent_here"))):
                saved += own
                for _, _, more, kept in queue.take((-depth, conv)):
                    children, leaves, saved = children + 1, leaves + more, saved + kept
                leaves = leaves if children else 1
                if here:
                    queue.push((1 - depth, parent, leaves, saved))
                for x, v in zip(out, (children, leaves, saved)):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], b.column(10), *(pa.array(x, pa.int64()) for x in out)], names=list(_DONE))

    ordered = nodes.sortWithinPartitions(F.col("depth").desc(), "conv_id")
    return ordered.select(*_NODE).mapInArrow(run, ", ".join(f"{c} long" for c in _DONE))


def _shard_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(m_c, s1, s2): the shard of each conversation, by its root's key; ``nodes`` are the roots."""
    roots = nodes.select(F.col("depth").alias("r_d"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    return (rows.select("c", *_KEY).join(roots, (F.col("depth") == F.col("r_d")) & (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")))
            .select(F.col("c").alias("m_c"), "s1", "s2"))


def subtree_totals(nodes: DataFrame, rows: DataFrame, turns: int, shard: int = SHARD, shards: int = SHARDS, held: int = HELD) -> DataFrame:
    """``nodes`` with n_children, n_leaves and saved_tokens: within shards, then across their roots."""
    most = max(shard, -(-turns // shards))
    light = (F.col("weight") <= most) & (F.col("depth") > 0)
    root = light & ((F.col("parent_weight") > most) | (F.col("depth") == 1))
    nothing = {c: F.lit(0).cast("long") for c in ("in_children", "in_leaves", "in_saved")}
    members = _shard_of(rows, nodes.where(root))
    below = (nodes.where(light).join(members, F.col("conv_id") == F.col("m_c"))
             .withColumns(nothing | {"parent_here": (~root).cast("long")}))
    below = materialize(forward(below.repartition("s1", "s2"), held), "shards")
    passed = below.where("parent_here = 0").groupBy((F.col("depth") - 1).alias("t_d"), F.col("parent_conv_id").alias("t_c")).agg(
        F.count(F.lit(1)).alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved"))
    crown = nodes.where(~light).join(passed, (F.col("depth") == F.col("t_d")) & (F.col("conv_id") == F.col("t_c")), "left")
    crown = crown.withColumns({c: F.coalesce(c, F.lit(0)) for c in nothing} | {"parent_here": (F.col("depth") > 0).cast("long")})
    return below.unionByName(forward(crown.repartition(1), held))


# --- ends ------------------------------------------------------------------------------------------------------------

def ends_digest(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the ascending ids of ``ends(depth, k1, k2, c)`` by key."""
    by = [*_KEY, "c"]
    spread = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pid", F.spark_partition_id())

    def write(batches):
        n = 0
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            c, new = cols[3], np.zeros(b.num_rows, bool)
            new[:1] = True
            for x in cols[:3]:
                new[1:] |= x[1:] != x[:-1]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
            cuts = np.append(np.flatnonzero(new | ((np.arange(len(c)) - begin) % chunk == 0)), len(c))
            texts = [",".join(map(str, c[i:j].tolist())) for i, j in zip(cuts[:-1], cuts[1:])]
            at = cuts[:-1]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (*cols[:3], cols[4])), pa.array(np.arange(n, n + len(at))), pa.array(texts, pa.string())],
                                             names=[*_KEY, "pid", "seq", "ids"])
            n += len(at)

    def hashed(batches):
        key, h = None, None
        for b in batches:
            out = []
            for *now, ids in zip(*(b.column(c).to_pylist() for c in (*_KEY, "ids"))):
                if now != key:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = now, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield made(out)
        if key is not None:
            yield made([(*key, h.hexdigest())])

    def made(out):
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in list(zip(*out))[:3]), pa.array([x[3] for x in out], pa.string())],
                                          names=[*_KEY, "ends_sha256"])

    chunks = spread.mapInArrow(write, "depth long, k1 long, k2 long, pid int, seq long, ids string")
    return chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "pid", "seq").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, shard: int = SHARD, shards: int = SHARDS, held: int = HELD, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations (conv_id, turn, role, text):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = ordered_turns(conversations)
    convs, made = rebuilt(turns)
    rows = materialize(prefixes(made, block), "prefixes")
    total = convs.agg(F.sum("size")).first()[0] or 0
    nodes = materialize(trie_nodes(rows, convs), "linked-nodes")
    done = subtree_totals(nodes, rows, total, shard, shards, held)
    none = [F.lit(0).cast("long").alias(c) for c in _KEY]
    ends = rows.where("depth = size").select(*_KEY, "c").unionByName(convs.where("size = 0").select(*none, "c"))
    named = ends_digest(ends, chunk).withColumnsRenamed({c: f"e_{c}" for c in _KEY})
    on = [F.col(c) == F.col(f"e_{c}") for c in _KEY]
    empty = hashlib.sha256(b"").hexdigest()
    return done.join(named, on, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                               F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
