"""Benchmark decontamination with a broadcast set of test n-grams, in DataFrame
operations only.

Every item gives its windows of ``n`` consecutive normalised words (all its
words if it has fewer).  A window is filed under its longest word, the anchor.
Documents' words are exploded with their positions and looked up among the
anchors; a hit is verified by comparing the whole window with the document's
words around it.  So each occurrence of each window is found, while only
anchors' positions leave the first join.

The anchor table is broadcast while it has at most ``max_broadcast_windows``
windows.  Beyond, windows are joined by a shuffle: a document gives one row per
word and window size, with the hash of the words from there on and no text.
Equal hashes are verified by comparing the window with its document's words,
which are shuffled once per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigil.llm.common import ascii_lower, broadcast_if_small, materialize

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N = 10
MAX_BROADCAST_WINDOWS = 4_000_000  # hashes of 8 bytes, about 100 MB as a hash table


def _split(text: Column, pattern: str) -> Column:
    return F.coalesce(F.array_remove(F.split(text, pattern, -1), ""), F.array().cast("array<string>"))


def words(text: str) -> Column:
    """Normalised words of a column; none for null."""
    return _split(ascii_lower(F.col(text).cast("string")), NO_WORD)


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(w_hash, window, items): the distinct windows of ``benchmark(item_id, text)`` with the ids (as strings) of the
    items that hold them.  Null texts have none."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1)))
    windows = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("window"))
    return (windows.groupBy("window").agg(F.collect_set("item").alias("items"))
            .select(F.xxhash64(F.size("window"), _word_hashes(F.col("window"))).alias("w_hash"), "window", "items"))


def _key() -> list[Column]:
    """What tells rows apart: equal rows share their result."""
    t = F.col("text").cast("string")
    return [F.col("doc_id").alias("k_id"), F.xxhash64(t).alias("k_text"), F.length(t).alias("k_len")]


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N,
         max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """(k_id, k_text, k_len, spans, items) of documents with an occurring window:
    spans are sorted (start, end) word ranges, end exclusive.

    Every document window's hash is looked up among the benchmark's, which are
    broadcast without their words (8 bytes each; past ``max_broadcast_windows`` of
    them the same lookup is a shuffled join).  What stands at the places found is
    compared word by word."""
    windows = materialize(benchmark_windows(benchmark, n), "windows")
    sizes = [r[0] for r in windows.select(F.size("window")).distinct().collect()]  # at most n
    hashes = windows.select(F.col("w_hash").alias("known")).distinct()
    known = F.broadcast(hashes) if hashes.count() <= max_broadcast_windows else hashes
    size = F.col("size")
    there = F.transform(F.sequence(F.lit(1), F.size("h") - size + 1), lambda i: F.xxhash64(size, F.slice("h", i, size)))
    at = (docs.select(*_key(), _word_hashes(words("text")).alias("h"))
          .select("k_id", "k_text", "k_len", "h", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size")).where(F.size("h") >= size)
          .select("k_id", "k_text", "k_len", "size", F.posexplode(there).alias("start", "hash")))
    at = at.join(known, F.col("hash") == F.col("known"), "left_semi")
    maybe = at.groupBy("k_id", "k_text", "k_len").agg(F.collect_set(F.struct("start", "size")).alias("maybe"))
    maybe = materialize(maybe.select(*[F.col(c).alias(f"m_{c}") for c in ("k_id", "k_text", "k_len")], "maybe"), "maybe-hits")  # places only
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in ("k_id", "k_text", "k_len")]
    there = F.transform("maybe", lambda m: F.struct(m["start"].alias("start"), F.slice("w", m["start"] + 1, m["size"]).alias("words")))
    places = (docs.select(*_key(), words("text").alias("w")).join(broadcast_if_small(maybe), same[0] & same[1] & same[2])
              .select("k_id", "k_text", "k_len", F.explode(there).alias("t")).select("k_id", "k_text", "k_len", "t.start", "t.words"))
    span = F.struct(F.col("start"), (F.col("start") + F.size("words")).alias("end"))
    return (places.join(windows.select("window", "items"), F.col("words") == F.col("window")).groupBy("k_id", "k_text", "k_len")
            .agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))


def covered(spans: str) -> Column:
    """Words inside any of the sorted ranges."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
        F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N,
         max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, spans, items, n_hit) for every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no words; repeated rows stay repeated, with equal
    results; null item ids count as hits but aren't listed; an empty benchmark
    hits nothing.  Other columns are not read.
    """
    found = materialize(hits(docs, benchmark, n, max_broadcast_windows), "hits")
    f = found.select(*[F.col(c).alias(f"f{c}") for c in ("k_id", "k_text", "k_len")], "spans", "items")
    n_words = F.size(_split(F.col("text").cast("string"), ANY_CASE_NO_WORD))  # case doesn't move them
    every = docs.select(*_key(), n_words.cast("long").alias("n_words"))
    same = [F.col(c).eqNullSafe(F.col(f"f{c}")) for c in ("k_id", "k_text", "k_len")]
    return every.join(f, same[0] & same[1] & same[2], "left").select(
        F.col("k_id").alias("doc_id"), "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(covered("spans"), F.lit(0)).cast("long").alias("n_hit"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", n: int = N) -> DataFrame:
    """``docs`` without contaminated documents, or (``what="spans"``) with the hit
    words cut from their texts; what stands between words stays.  All columns
    stay, whatever their names."""
    if what not in ("documents", "spans"):
        raise ValueError(f"what: {what!r}")
    found = materialize(hits(docs, benchmark, n), "hits")
    f = found.select(*[F.col(c).alias(f"__{c}") for c in ("k_id", "k_text", "k_len")], F.col("spans").alias("__spans"))
    same = None
    for key, c in zip(_key(), ("k_id", "k_text", "k_len")):
        one = key.eqNullSafe(F.col(f"__{c}"))
        same = one if same is None else same & one
    if what == "documents":
        return docs.join(broadcast_if_small(f.drop("__spans")), same, "left_anti")
    t = F.col("text").cast("string")
    gaps, parts = F.split(t, ANY_CASE_WORD, -1), F.regexp_extract_all(t, F.lit(ANY_CASE_WORD), F.lit(0))
    kept = F.transform(parts, lambda w, i: F.when(F.exists("__spans", lambda s: (s["start"] <= i) & (i < s["end"])), "").otherwise(w))
    cut = F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    return docs.join(f, same, "left").withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut)) \
        .drop("__k_id", "__k_text", "__k_len", "__spans")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
                  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size)),
hit AS (SELECT rid, i, win.n, item FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
