"""Interpolated modified Kneser-Ney bigram model, counted in Spark and
memory-mapped by the workers that score.

Files below the shared folder, all written by tasks (a temporary name, then a
rename; a repeated task writes the same bytes):

* ``word-S``: sorted 64-bit word hashes of hash range S, and their counts.  A
  word's id is its place in all ranges together.
* ``pair-S``: sorted keys (context id << 32 | word id) of shard S, and counts.
* ``back-R``: by id, for id range R: the context's interpolation weight and the
  word's lower-order probability.

Pairs are counted per batch before they are shuffled as compressed blocks of
sorted keys.  A context's pairs share a shard unless it has more than
``SHARD_TOKENS`` tokens; then they are dealt out by the word, and the parts'
statistics are summed.  So no task holds all pairs of a frequent word, and the
driver only sees one row of totals per shard.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from vigil.llm.common import materialize, remainder, shared_path

SHARD_TOKENS = 1_500_000  # tokens behind one shard of pairs, about
RANGE_IDS = 1 << 18  # ids in one file of back-off weights
_FLUSH = 2_000_000  # tokens counted in a batch before a block leaves the task
_SLICE = 2 << 20  # bytes of text split into words at once
_END = xxhash.xxh64_intdigest(b" end of text")  # holds blanks, so it's no word


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply) of unsigned integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# -- files ------------------------------------------------------------------

def _place(path: str):
    """(file system, path in it) of a shared folder, given as a path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _store(path: str, name: str, *arrays: np.ndarray) -> None:
    from pyarrow import fs

    where, folder = _place(path)
    where.create_dir(folder, recursive=True)
    temp = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(temp) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    if isinstance(where, fs.LocalFileSystem):
        os.replace(temp, f"{folder}/{name}")
    else:
        where.move(temp, f"{folder}/{name}")


def _mapped(path: str, name: str) -> np.ndarray:
    """The bytes of a file, memory-mapped; from other stores by way of a copy in this worker's own folder."""
    from pyarrow import fs

    where, folder = _place(path)
    local = f"{folder}/{name}"
    if not isinstance(where, fs.LocalFileSystem):
        import tempfile

        local = os.path.join(tempfile.mkdtemp(prefix="kn-"), name)
        with where.open_input_stream(f"{folder}/{name}") as f, open(local, "wb") as out:
            while block := f.read(1 << 22):
                out.write(block)
    return np.memmap(local, np.uint8, "r") if os.path.getsize(local) else np.zeros(0, np.uint8)


# -- texts ------------------------------------------------------------------

def slices(texts: pa.Array):
    """Parts of about ``_SLICE`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _SLICE)))
        yield at, texts.slice(at, stop - at)
        at = stop


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, index among them of each token, document ends);
    an end token closes each document; null texts are empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    flat, owner = flat.filter(real), owner.filter(real).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    count = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(count + 1)
    index = np.full(int(ends[-1]) if len(ends) else 0, len(hashes), np.int64)
    inner = np.ones(len(index), bool)
    inner[ends - 1] = False
    index[inner] = coded.indices.to_numpy(zero_copy_only=False)
    return np.append(hashes, np.uint64(_END)), index, ends


# -- counting ---------------------------------------------------------------

_BLOCK = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_BLOCK_SQL = "shard long, n long, keys binary, counts binary"


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes in planes, so that equal high bytes stand together and compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _spread(b: bytes, n: int, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(-1, n).T).view(kind).ravel()


def _blocks(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """Rows of sorted keys and their counts by shard."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order].astype(np.uint64)
    cut = np.nonzero(np.diff(shard))[0] + 1
    rows = [(int(s[0]), len(k), _squeeze(k), _squeeze(c.astype(np.uint32) if c.max() < 1 << 32 else c))
            for s, k, c in zip(np.split(shard, cut), np.split(keys, cut), np.split(counts, cut)) if len(k)]
    if rows:
        yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(_BLOCK)}, schema=_BLOCK)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.append(True, k[1:] != k[:-1])
    return k[first], np.add.reduceat(c, np.nonzero(first)[0])


def _by_shard(blocks: DataFrame, kind, finish, schema: str) -> DataFrame:
    """Sum the counts of each shard's keys and hand them to ``finish(shard, keys, counts)``, which yields batches."""

    def run(batches):
        at, keys, counts, size = None, [], [], 0
        for b in batches:
            for shard, n, k, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                if at is not None and shard != at:
                    yield from finish(at, *_summed(keys, counts))
                    keys, counts, size = [], [], 0
                at = shard
                width = np.dtype(np.uint32 if len(c) == 4 * n else np.uint64)
                keys.append(_spread(k, n, kind))
                counts.append(_spread(c, n, width).astype(np.int64))
                size += n
                if size > 4 * _FLUSH:  # equal keys of many blocks
                    one = _summed(keys, counts)
                    keys, counts, size = [one[0]], [one[1]], len(one[0]) // 2
        if at is not None:
            yield from finish(at, *_summed(keys, counts))

    return blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)


class _Counter:
    """Counts keys batch by batch; full batches leave as blocks."""

    def __init__(self, shard_of):
        self.shard_of, self.keys, self.counts, self.size = shard_of, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size >= _FLUSH:
            yield from self.flush()

    def flush(self):
        if self.size:
            k, c = _summed(self.keys, self.counts)
            self.keys, self.counts, self.size = [], [], 0
            yield from _blocks(self.shard_of(k), k, c)


_TOTALS = "shard long, n long, total long, c1 long, c2 long, c3 long, c4 long"


def _totals(shard: int, counts: np.ndarray) -> pa.RecordBatch:
    exact = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
    row = [shard, len(counts), int(counts.sum()), *exact]
    names = ["shard", "n", "total", "c1", "c2", "c3", "c4"]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=names)


def count_words(docs: DataFrame, path: str, bits: int) -> list:
    """Write the word files; one row of totals per hash range."""

    def count(batches):
        held = _Counter(lambda k: (k >> np.uint64(64 - bits)).astype(np.int64))
        for b in batches:
            for _, part in slices(b.column(0)):
                hashes, index, _ = tokens(part)
                yield from held.add(hashes, np.bincount(index, minlength=len(hashes)).astype(np.int64))
        yield from held.flush()

    def finish(shard, keys, counts):
        keys, counts = keys[counts > 0], counts[counts > 0]
        if len(keys):
            _store(path, f"word-{shard}", keys, counts)
            yield _totals(shard, counts)

    return _by_shard(docs.select("text").mapInArrow(count, _BLOCK_SQL), np.uint64, finish, _TOTALS).collect()


class Words:
    """Ids and counts of word hashes."""

    def __init__(self, path: str, bits: int, sizes: dict[int, int]):
        self.path, self.bits = path, bits
        self.sizes, self.offset, at = sizes, {}, 0
        for s in sorted(sizes):
            self.offset[s] = at
            at += sizes[s]
        self.size, self._open = at, {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def _file(self, shard: int):
        if shard not in self._open:
            n, raw = self.sizes[shard], _mapped(self.path, f"word-{shard}")
            self._open[shard] = raw[:8 * n].view(np.uint64), raw[8 * n:].view(np.int64)
        return self._open[shard]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each hash."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        shard = (hashes[order] >> np.uint64(64 - self.bits)).astype(np.int64)
        for part in np.split(order, np.nonzero(np.diff(shard))[0] + 1) if len(order) else []:
            s = int(hashes[part[0]] >> np.uint64(64 - self.bits))
            if s in self.sizes:
                keys, n = self._file(s)
                at = np.minimum(np.searchsorted(keys, hashes[part]), len(keys) - 1)
                hit = keys[at] == hashes[part]
                ids[part[hit]] = at[hit] + self.offset[s]
                counts[part[hit]] = n[at[hit]]
        return ids, counts


def _contexts(ids: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The id before each token; ``start`` at the beginning of a document."""
    prev = np.empty_like(ids)
    prev[1:] = ids[:-1]
    prev[0] = start
    prev[ends[:-1]] = start
    return prev


class Shards:
    """Where a pair's count lies."""

    def __init__(self, bits: int):
        self.bits = bits

    def of(self, context: np.ndarray, word: np.ndarray, context_count: np.ndarray) -> np.ndarray:
        parts = (1 + context_count // SHARD_TOKENS).astype(np.uint64)  # a frequent context is dealt out by the word
        salt = mix(word) % parts
        spread = mix(mix(context) + salt)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(context), np.int64)


def count_pairs(docs: DataFrame, path: str, words: Words, shards: Shards, n_docs: int):
    """Write the pair files; returns (totals per shard, statistics blocks by id range)."""
    start = words.size
    low = np.uint64(0xFFFFFFFF)

    def count(batches):
        seen = _CountById(words, start, n_docs)
        held = _Counter(lambda k: shards.of(k >> np.uint64(32), k & low, seen((k >> np.uint64(32)).astype(np.int64))))
        for b in batches:
            for _, part in slices(b.column(0)):
                hashes, index, ends = tokens(part)
                ids = words.look_up(hashes)[0][index]
                key = (_contexts(ids, ends, start).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
                yield from held.add(key, np.ones(len(key), np.int64))
        yield from held.flush()

    def finish(shard, keys, counts):
        _store(path, f"pair-{shard}", keys, counts.astype(np.uint64 if len(counts) and counts.max() >> 32 else np.uint32))
        total = _totals(shard, counts)
        yield pa.RecordBatch.from_arrays([*total.columns, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                          pa.nulls(1, pa.binary())], schema=both)
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & low).astype(np.int64)
        kind = np.minimum(counts, 3)
        # key of a statistic: id * 4 + (0: contexts of a word, 1-3: a context's pairs seen once, twice, more)
        stat = np.concatenate([word * 4, context * 4 + kind]).astype(np.uint64)
        k, c = _summed([stat], [np.ones(len(stat), np.int64)])
        for b in _blocks((k // np.uint64(4 * RANGE_IDS)).astype(np.int64), k, c):
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, b["n"], *[none] * 5, b["shard"], b["keys"], b["counts"]], schema=both)

    both = pa.schema([(c, pa.int64()) for c in ("shard", "n", "total", "c1", "c2", "c3", "c4", "range")]
                     + [("keys", pa.binary()), ("counts", pa.binary())])
    rows = materialize(_by_shard(docs.select("text").mapInArrow(count, _BLOCK_SQL), np.uint64, finish,
                                 _TOTALS + ", range long, keys binary, counts binary"), "pair-stats")
    totals = rows.where("range is null").select("shard", "n", "c1", "c2", "c3", "c4").collect()
    stats = rows.where("range is not null").select(F.col("range").alias("shard"), "n", "keys", "counts")
    return totals, stats


class _CountById:
    """Training count of a word id as context; the start of a text counts once a document."""

    def __init__(self, words: Words, start: int, n_docs: int):
        self.words, self.start, self.n_docs = words, start, n_docs
        self.shards = np.array(sorted(words.sizes), np.int64)
        self.bounds = np.array([words.offset[s] for s in self.shards.tolist()], np.int64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), self.n_docs, np.int64)
        at = np.searchsorted(self.bounds, ids, side="right") - 1
        real = ids < self.start
        for a in np.unique(at[real]).tolist():
            pick = real & (at == a)
            out[pick] = self.words._file(int(self.shards[a]))[1][ids[pick] - self.bounds[a]]
        return out


# -- model ------------------------------------------------------------------

def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more; absolute ones where a class is empty."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


class Model:
    """What scoring needs; small but for the files it maps."""

    def __init__(self, path: str, words: Words, shards: Shards, pair_sizes, d, low_d, n_docs, n_tokens, n_pairs, low_rest):
        self.path, self.words, self.shards, self.pair_sizes = path, words, shards, pair_sizes
        self.d, self.low_d, self.n_docs, self.n_tokens, self.n_pairs = d, low_d, n_docs, n_tokens, n_pairs
        self.unseen = low_rest / (words.size + 1)  # lower-order probability of an unknown word
        self._pairs, self._back = {}, {}

    def __getstate__(self):
        return {**self.__dict__, "_pairs": {}, "_back": {}}

    def _pair_file(self, s: int):
        if s not in self._pairs:
            n, raw = self.pair_sizes[s], _mapped(self.path, f"pair-{s}")
            wide = np.uint64 if len(raw) == 16 * n else np.uint32  # a shard with a count beyond 32 bits has 64 for all
            self._pairs[s] = raw[:8 * n].view(np.uint64), raw[8 * n:].view(wide)
        return self._pairs[s]

    def back(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interpolation weight as context, lower-order probability as word) of ids."""
        weight, prob = np.ones(len(ids)), np.full(len(ids), self.unseen)
        order = np.argsort(ids, kind="stable")
        span = ids[order] // RANGE_IDS
        for part in np.split(order, np.nonzero(np.diff(span))[0] + 1) if len(order) else []:
            r = int(ids[part[0]] // RANGE_IDS)
            if r not in self._back:
                raw = _mapped(self.path, f"back-{r}").view(np.float64)
                self._back[r] = raw[:len(raw) // 2], raw[len(raw) // 2:]
            at = ids[part] - r * RANGE_IDS
            weight[part], prob[part] = self._back[r][0][at], self._back[r][1][at]
        return weight, prob

    def pair_counts(self, context: np.ndarray, word: np.ndarray, context_count: np.ndarray) -> np.ndarray:
        keys = (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
        shard, out = self.shards.of(context, word, context_count), np.zeros(len(keys), np.int64)
        order = np.lexsort((keys, shard))
        for part in np.split(order, np.nonzero(np.diff(shard[order]))[0] + 1) if len(order) else []:
            s = int(shard[part[0]])
            if s in self.pair_sizes:
                held, n = self._pair_file(s)
                at = np.minimum(np.searchsorted(held, keys[part]), len(held) - 1)
                hit = held[at] == keys[part]
                out[part[hit]] = n[at[hit]]
        return out

    def score(self, texts: pa.Array):
        """(tokens, known tokens, base score, score) of each text."""
        hashes, index, ends = tokens(texts)
        ids, counts = self.words.look_up(hashes)
        n, v = self.n_tokens, self.words.size
        base = np.log10((counts + 1) / (n + v + 1))
        if not n:
            logp = np.zeros(len(index))  # one class, the unknown word
        else:
            start = v
            word = ids[index]
            context = _contexts(word, ends, start)
            code = (context + 1) * (len(hashes) + 1) + index
            _, first, back = np.unique(code, return_index=True, return_inverse=True)
            c, w, i = context[first], word[first], index[first]
            seen_of = np.append(counts, 0)
            prev = np.empty_like(index)
            prev[1:] = index[:-1]
            prev[0] = 0
            cc = np.where(c == start, self.n_docs, seen_of[prev[first]])
            known = np.nonzero((c >= 0) & (w >= 0))[0]
            pair = np.zeros(len(c), np.int64)
            pair[known] = self.pair_counts(c[known], w[known], cc[known])
            low = np.full(len(hashes), self.unseen)
            has = np.nonzero(ids >= 0)[0]
            low[has] = self.back(ids[has])[1]
            some, inv = np.unique(c, return_inverse=True)
            gamma = np.ones(len(some))
            gamma[some >= 0] = self.back(some[some >= 0])[0]
            take = np.array((0.0, *self.d))[np.minimum(pair, 3)]
            p = np.where(c >= 0, (pair - take) / np.maximum(cc, 1) + gamma[inv] * low[i], low[i])
            logp = np.log10(p)[back]
        begin = np.append(0, ends[:-1])
        length = ends - begin
        if not len(ends):
            return length, length, np.zeros(0), np.zeros(0)
        return (length, np.add.reduceat((counts > 0).astype(np.int64)[index], begin),
                np.add.reduceat(base[index], begin), np.add.reduceat(logp, begin))


def _write_back(stats: DataFrame, path: str, words: Words, n_docs: int, d, low_d, n_pairs: int, low_rest: float) -> None:
    """Write the back-off files from the statistics of each id range."""
    start = words.size
    lookup = _CountById(words, start, n_docs)

    def finish(span, keys, counts):
        base = span * RANGE_IDS
        n = min(RANGE_IDS, start + 1 - base)
        table = np.zeros(4 * n)
        table[keys.astype(np.int64) - 4 * base] = counts
        table = table.reshape(n, 4)
        total = lookup(np.arange(base, base + n))
        weight = (table[:, 1:] @ np.array(d)) / np.maximum(total, 1)
        cont = table[:, 0]
        prob = (cont - np.array((0.0, *low_d))[np.minimum(cont, 3).astype(int)]) / n_pairs + low_rest / (start + 1)
        _store(path, f"back-{span}", weight, prob)
        yield pa.RecordBatch.from_arrays([pa.array([span], pa.int64())], names=["span"])

    _by_shard(stats, np.uint64, finish, "span long").count()


def _continuation_counts(stats: DataFrame) -> list[int]:
    """How many words have 1, 2, 3, 4 and any number of distinct contexts."""

    def finish(span, keys, counts):
        own = counts[keys % np.uint64(4) == 0]
        t = _totals(int(span), own)
        yield t

    rows = _by_shard(stats, np.uint64, finish, _TOTALS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("c1", "c2", "c3", "c4", "n")]).first()
    return list(rows)


def fit(docs: DataFrame, path: str | None = None) -> Model:
    """Count ``docs(text)`` and write the model below the shared folder."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "kneser-ney")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_docs = texts.count()
    bits = max(2, (texts.rdd.getNumPartitions() - 1).bit_length())
    found = count_words(texts, path, bits)
    words = Words(path, bits, {r["shard"]: r["n"] for r in found})
    if words.size >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    n_tokens = sum(r["total"] for r in found)
    if not n_docs:
        return Model(path, words, Shards(0), {}, (0,) * 3, (0,) * 3, 0, 0, 0, 1.0)
    shards = Shards(max(0, (n_tokens // SHARD_TOKENS).bit_length()))
    totals, stats = count_pairs(texts, path, words, shards, n_docs)
    n = [sum(r[c] for r in totals) for c in ("c1", "c2", "c3", "c4", "n")]
    m = _continuation_counts(stats)
    d, low_d = discounts(*n[:4]), discounts(*m[:4])
    low_rest = (low_d[0] * m[0] + low_d[1] * m[1] + low_d[2] * (m[4] - m[0] - m[1])) / n[4]
    _write_back(stats, path, words, n_docs, d, low_d, n[4], low_rest)
    sizes = {r["shard"]: r["n"] for r in totals}
    return Model(path, words, shards, sizes, d, low_d, n_docs, n_tokens, n[4], low_rest)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of
    ``docs(doc_id, text, ...)``; null texts are empty, that is one end token."""
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double, perplexity double")

    def run(batches):
        for b in batches:
            for at, part in slices(b.column(1)):
                n, known, base, logp = model.score(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(np.full(len(n), model.n_tokens), pa.int64()), pa.array(base), pa.array(logp),
                     pa.array(np.power(10.0, np.minimum(300.0, -logp / np.maximum(n, 1))))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def cross_score(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """Learn from the rows outside one fold of the ids and score every row; adds held_out.

    An empty table gives no rows; repeated rows count and are scored each; if
    nothing can be learned, every token is the unknown word with probability 1.
    """
    out = remainder("doc_id", folds) == held_out
    return score(docs, fit(docs.where(~out))).withColumn("held_out", out)
