"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each
padded with zeros to a word of the extended binary Golay code (24, 12, 8).
Any two words at distance 1 share a nearest codeword, because every word is
within distance 3 of one codeword or at distance 4 of exactly six.

Two fingerprints that differ in at most two bits have a segment without an
error, and the segment after it (cyclically) for some such choice holds at
most one.  So the keys (segment s exactly, a nearest codeword of segment s+1)
for s = 0, 1, 2 always meet; each segment gives one or six codewords, about
nine keys a fingerprint.  Key groups are joined and verified by bit count.

A key group with more than ``group_limit`` fingerprints is not paired: its
members are keyed by the 65 words within distance 1 instead.  Two words are
within distance 2 exactly if they share such a centre, and all holders of one
centre are links of each other, so a star to the smallest holder keeps every
component at 65 rows a fingerprint.  Nothing is capped or dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vigil.llm.common import connected_components, materialize

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift, width
GENERATOR = 0xC75  # x^11+x^10+x^6+x^5+x^4+x^2+1, the (23, 12) Golay code
GROUP_LIMIT = 32
_CHUNK = 1 << 15


def text_fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Bitwise majority of the shingles' XXH64; no words give 0."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    n = len(words) - words_per_shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    counts = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    parts = [words[i:] for i in range(words_per_shingle)]
    hashes = [digest(join(s), seed) for s in zip(*parts)]
    for i in range(0, n, _CHUNK):
        block = np.array(hashes[i:i + _CHUNK], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"

    def run(batches):
        for b in batches:
            fp = np.fromiter((text_fingerprint(t, words_per_shingle, seed) for t in b.column(1).to_pylist()),
                             np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _syndrome_of(words: np.ndarray) -> np.ndarray:
    """12-bit syndrome of 24-bit words: the remainder of the upper 23 bits by the generator, and the parity."""
    w = words.astype(np.int64)
    parity = np.zeros_like(w)
    for i in range(24):
        parity ^= (w >> i) & 1
    r = w >> 1
    for i in range(22, 10, -1):
        r = np.where((r >> i) & 1, r ^ (GENERATOR << (i - 11)), r)
    return (r << 1) | parity


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Coset leaders: (leaders[4096, 6], how many of them count: 1 or 6)."""
    from itertools import combinations

    words = np.array([sum(1 << b for b in c) for k in range(5) for c in combinations(range(24), k)], np.int64)
    weight = np.array([k for k in range(5) for _ in combinations(range(24), k)])
    syndrome = _syndrome_of(words)
    leaders, many = np.zeros((4096, 6), np.int64), np.zeros(4096, np.int64)
    for w, k, s in zip(words.tolist(), weight.tolist(), syndrome.tolist()):
        if many[s] == 0 or (k == 4 and bin(int(leaders[s, 0])).count("1") == 4):
            leaders[s, many[s]] = w
            many[s] += 1
    return leaders, many


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys of each fingerprint (signed 64-bit)."""
    leaders, many = golay_tables()
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    rows, keys = [], []
    for s in range(3):
        word = seg[(s + 1) % 3] << 2  # two or three padding bits on the right or left
        syndrome = _syndrome_of(word)
        for j in range(6):
            has = np.nonzero(many[syndrome] > j)[0]
            code = (word[has] ^ leaders[syndrome[has], j]) >> 12  # the code is systematic: 12 message bits
            rows.append(has)
            keys.append((np.int64(s) << 60) | (seg[s][has] << 12) | code)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            row, key = golay_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def link_edges(fps: DataFrame, max_bits: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``fps(fp)`` whose components
    are those of "at most ``max_bits`` (0, 1 or 2) bits apart"; every edge is such a link."""
    if max_bits not in (0, 1, 2):
        raise ValueError("three Golay segments cover at most 2 bits")
    keys = materialize(_keyed(fps), "golay-keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(keys.join(shared, "key"), "golay-groups")
    small = groups.where(F.col("n") <= group_limit)
    a, b = (small.select("key", F.col("fp").alias(x)) for x in ("a", "b"))
    pairs = a.join(b.withColumnRenamed("key", "k"),
                   (F.col("key") == F.col("k")) & (F.col("a") < F.col("b"))
                   & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
    members = groups.where(F.col("n") > group_limit).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)),
                        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    if max_bits == 2:
        centre = members.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("centre"))
        low = centre.groupBy("centre").agg(F.collect_list("fp").alias("holders")).where(F.size("holders") > 1)
        stars = low.select(F.array_min("holders").alias("a"), F.explode("holders").alias("b"))
    else:  # at distance 1 one of the two is the other's centre
        centre = members.select(F.col("fp").alias("a"), F.explode(flips).alias("b"))
        stars = centre.join(members.select(F.col("fp").alias("b")), "b").select("a", "b").where(F.lit(max_bits == 1))
    return pairs.unionByName(stars.where("a < b")).distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 2, seed: int = 42,
                    group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have fingerprint 0 and link like any other; repeated
    rows stay repeated; a null doc_id is never a component id unless its
    component holds no other (then null).  ``root`` is the component's smallest
    fingerprint.  Columns besides doc_id and text are not read.  An empty table
    gives no rows.
    """
    fps = materialize(fingerprints(docs, words_per_shingle, seed), "fingerprints")
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps")
    comp = connected_components(link_edges(least, max_bits, group_limit))
    linked = materialize(least.join(comp, F.col("fp") == F.col("node")).select("fp", "least", "component"), "linked")
    label = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.select(F.col("fp").alias("k"), F.col("component").alias("root")).join(
        label.withColumnRenamed("component", "root"), "root")
    known = materialize(least.join(moved, F.col("fp") == F.col("k"), "left").select(
        F.col("fp").alias("k"), F.coalesce("root", "fp").alias("root"),
        F.coalesce("component_id", "least").alias("component_id")), "components")
    return fps.join(known, F.col("fp") == F.col("k")).select("doc_id", "fp", "root", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: doc_id, fingerprint as 16 hex digits, component_id."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A list of dropped ids longer than this (8 bytes each) joins by a shuffle instead of a broadcast.
MAX_BROADCAST_IDS = 2_000_000


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` with one document of each component: the one whose doc_id
    is the component id.  Of rows that repeat this doc_id, the one with the
    smallest fingerprint stays, once; rows with a null doc_id stay only if their
    component has no other, one per component.  All columns stay, whatever
    their names."""
    found = materialize(near_duplicates(docs, **how), "near-duplicates")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    repeated = not found.groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:
        gone = found.where(~stays).select(F.col("doc_id").alias("__gone"))
        few = gone.count() <= MAX_BROADCAST_IDS
        return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
    kept = found.where(stays).groupBy("root", F.col("doc_id").alias("__id")).agg(F.min("fp").alias("__kept"))
    shingle, seed = how.get("words_per_shingle", 3), how.get("seed", 42)

    @F.pandas_udf("long")
    def fp_of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle, seed) for t in texts], dtype="uint64").astype("int64")

    rows = docs.withColumn("__fp", fp_of("text"))
    one = rows.join(kept.drop("root"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__kept")),
                    "left_semi").dropDuplicates(["doc_id", "__fp"])
    return one.drop("__fp")
