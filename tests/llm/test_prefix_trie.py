"""The trie against one built by dictionaries."""

import hashlib
import random
import zlib

import pytest
from llm_edge import EXTRA, collected
from pyspark.sql import functions as F

from vigil.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + v[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        kids = children.get(path, [])
        leaves[path] = sum(leaves[k] for k in kids) if kids else 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[k] for k in kids)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p], ends(p))
                  for p, m in members.items())


def got(df):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in cols) for r in collected(df))


def conversations(seed=4, n=260):
    """Shared first turns, whole copies, one long conversation, gaps among the families' first ones, nulls, ties and
    repeated rows."""
    rnd = random.Random(seed)
    said = [("user", "hello"), ("assistant", "é 日本 😀"), (None, "x"), ("user", None), ("", ""), ("user", "a" * 500)]
    out = []
    for c in range(n):
        if c in (0, 100, 137):
            continue
        turns = [rnd.choice(said) for _ in range(rnd.choice([1, 2, 3, 5, 8]))] if c % 3 else said[:4]
        out += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    out += [(100, t, "user", f"{t}") for t in range(3)]
    out += [(500, t, "user", f"turn {t % 7}") for t in range(700)]
    out += [(501, t, "user", f"turn {t % 7}") for t in range(400)]
    out += [(600, None, "b", "late"), (600, None, "a", "z"), (600, None, "a", "b"), (600, 2, "a", "b"), (600, 2, "a", "b"), (600, -3, None, None)]
    out += [(None, 0, "user", "lost"), (None, None, None, None)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard": 30, "held": 5, "block": 3, "chunk": 2}, {"shard": 1, "shards": 10**9, "held": 50, "block": 16, "chunk": 1}])
def test_trie(spark, sizes):
    """Whatever the sizes of shards, queues, blocks and chunks."""
    df = spark.createDataFrame(conversations(), SCHEMA).repartition(4)
    assert got(P.trie(df, **sizes)) == brute(conversations())


def test_edges(spark):
    """Clashing columns are not read; an empty table, and one of null ids alone, have no nodes; a conversation may
    lose all its turns."""
    clash = spark.createDataFrame(conversations(9, 40), SCHEMA).withColumns({c: F.lit("clash") for c in (*EXTRA, "c", "j", "depth", "k1")})
    assert got(P.trie(clash)) == brute(conversations(9, 40))
    for none in ([], [(None, 1, "user", "x")]):
        assert collected(P.trie(spark.createDataFrame(none, SCHEMA))) == []
    lone = next([(c, 0, "user", "only")] for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    assert got(P.trie(spark.createDataFrame(lone, SCHEMA))) == brute(lone) and brute(lone)[0][1:3] == (0, -1)


def test_whole_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in collected(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))]
    assert got(P.trie(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))) == brute(rows)


def test_queue_spills_in_order():
    rnd = random.Random(2)
    queue, sent = P.SpillingQueue(held=10), []
    for i in range(500):
        sent.append((-rnd.randint(0, 5), rnd.randint(0, 5), i, i))
        queue.push(sent[-1])
    for place in sorted({m[:2] for m in sent}):
        assert sorted(queue.take(place)) == sorted(m for m in sent if m[:2] == place)
    assert queue.spills > 3 and not queue.heap and not queue.runs
