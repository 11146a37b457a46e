"""Best-fit packing of token pieces by a configuration linear program.

1. Texts are tokenized (an end id follows each) and cut into pieces of at most
   ``capacity`` ids; only the small piece table goes on.
2. The histogram of piece lengths (at most ``capacity`` rows) reaches the
   driver.  A configuration is a multiset of lengths that fits a sequence; the
   linear program covers every length's count by as few configurations as
   possible.  It is solved by multiplicative weights: a length's weight falls
   exponentially with its covered share, and the next configuration is the
   knapsack optimum under these weights, found by dynamic programming.
3. Rounding takes the whole part of each configuration, as far as counts last;
   what is left goes by best fit, longest first, by counts as well.
4. The result, runs of (length, ranks, sequences, offset), is as small as the
   histogram allows; pieces get their rank within their length by salted
   windows, so that a third of all rows may share one length.

Tokens come from a byte-level BPE file of public tokenizers, by path.  Words
are cached by their text: a chunk between two single blanks that stand between
non-blanks is tokenized alike wherever it stands.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vigil.llm.common import materialize

CAPACITY = 2048
END = 0
CACHE = 200_000  # words kept by each Python worker, under 50 MB
BATCH = 1000  # texts taken from Arrow at once
SALT_ROWS = 2_000  # pieces for each salt; windows sort those of one length and salt
ROUNDS = 40  # of multiplicative weights
ETA = 4.0  # how fast a covered length loses weight
SLACK = 0.99  # configurations this near to the best are bought in the same round
SPECIAL = "<|endoftext|>"
_LATIN = "ɏ"  # beyond, the reference tokenizer itself is asked
_blanks = re.compile(r"\s\s|^\s|\s$")
_single = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer's file and its vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _ids(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Ids:
    """Token ids (little-endian unsigned 32-bit) of texts; equal to those of the tokenizer's file."""

    _made: dict[tuple[str, str], Ids] = {}

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Ids:
        """One per Python worker."""
        if paths not in cls._made:
            cls._made[paths] = cls(*paths)
        return cls._made[paths]

    def __init__(self, file: str, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.file, self.whole = file, None
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        if (not text.isascii() and max(text) > _LATIN) or SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.file)
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return _ids(ids)

    def _word(self, word: str, cache: dict[str, bytes], lead: str) -> bytes:
        """A chunk without a blank at its ends, after ``lead``; a line break between others is a token of its own."""
        got = cache.get(word)
        if got is None:
            first, line, rest = word.partition("\n")
            if line:
                got = self._word(first, cache, lead) + self._encode(line) + self._word(rest, self.bare, "")
            else:
                got = self._encode(lead + word)
            if len(cache) < CACHE and len(word) < 64:
                cache[word] = got
        return got

    def __call__(self, text: str) -> bytes:
        if _blanks.search(text) or not text:
            return self._mixed(text)
        words = text.split(" ")
        get, word, spaced = self.spaced.get, self._word, self.spaced
        return word(words[0], self.bare, "") + b"".join([get(w) or word(w, spaced, " ") for w in words[1:]])

    def _mixed(self, text: str) -> bytes:
        parts = _single.split(text)
        out = []
        for i, p in enumerate(parts):
            lead = " " if i else ""
            plain = p and not _blanks.search(p)
            out.append(self._word(p, self.spaced if i else self.bare, lead) if plain else self._encode(lead + p) if p or lead else b"")
        return b"".join(out)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, but for a shorter first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``docs(doc_id, text)``."""
    paths = paths or tokenizer_paths()
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
              + ", ids array<int>" * ids)
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        encode = Ids.of(paths)
        for b in (part.slice(at, BATCH) for part in batches for at in range(0, part.num_rows, BATCH)):
            row, piece, start, length, crc, held = array("l"), array("i"), array("l"), array("l"), array("L"), []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = memoryview(encode(t or "") + end)
                for k, (s, n) in enumerate(cut(len(found) // 4, capacity)):
                    part = found[4 * s:4 * (s + n)]
                    row.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(part))
                    if ids:
                        held.append(np.frombuffer(part, "<i4"))
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(np.array(crc, np.int64))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(held, pa.list_(pa.int32()))] * ids,
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: (value, choice) by room; choice is the index of a length, the
    longest of equally good ones, or -1."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    size, worth = lengths[order], price[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = fits[room]
        if k:
            value = worth[:k] + best[room - size[:k]]
            j = k - 1 - int(value[::-1].argmax())
            if value[j] > best[room - 1]:
                best[room], choice[room] = value[j], order[j]
            else:
                best[room], choice[room] = best[room - 1], -2  # one unit stays empty
    return best, choice


def configuration(first: int, lengths: np.ndarray, choice: np.ndarray, capacity: int) -> tuple[int, ...]:
    """The best configuration that holds length ``first`` (an index), as sorted indices."""
    held, room = [first], capacity - int(lengths[first])
    while room > 0 and choice[room] != -1:
        if choice[room] == -2:
            room -= 1
        else:
            held.append(int(choice[room]))
            room -= int(lengths[choice[room]])
    return tuple(sorted(held))


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Fractional cover by multiplicative weights: amounts of configurations (tuples of length indices).

    The price of a length is its size times exp(-eta * covered share).  One
    dynamic program a round prices, for each length, the best configuration
    that holds it; those within ``SLACK`` of the best of all are bought, each in
    a small share of its length's count, before prices change.
    """
    need, share = counts.astype(float), np.zeros(len(lengths))
    plan: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        price = lengths / capacity * np.exp(-ETA * (share - share.min()))
        best, choice = knapsack(lengths, price, capacity)
        value = price + best[capacity - lengths]
        for i in np.nonzero((value >= SLACK * value.max()) & (share < 1))[0].tolist():
            config = configuration(i, lengths, choice, capacity)
            amount = need[i] / rounds / config.count(i)
            plan[config] = plan.get(config, 0.0) + amount
            for j in config:
                share[j] += amount / need[j]
        if share.min() >= 1:
            break
    return {c: x / max(1.0, max(share[j] for j in c)) for c, x in plan.items()}


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Longest first, each into the fullest sequence that takes it; equal sequences are held as one entry."""
    open_: dict[int, list] = {}  # room left -> [(lengths held, sequences)]
    rooms = np.zeros(capacity + 1, bool)

    def put(room, held, k):
        open_.setdefault(room, []).append((held, k))
        rooms[room] = True

    for n, c in sorted(zip(map(int, lengths), map(int, counts)), reverse=True):
        while c > 0:
            at = n + int(rooms[n:].argmax())
            if not rooms[at]:
                each = capacity // n
                if c >= each:
                    put(capacity - n * each, (n,) * each, c // each)
                if c % each:
                    put(capacity - n * (c % each), (n,) * (c % each), 1)
                break
            held, k = open_[at].pop()
            if k > c:
                open_[at].append((held, k - c))
            rooms[at] = bool(open_[at])
            put(at - n, held + (n,), min(k, c))
            c -= min(k, c)
    return [({n: held.count(n) for n in set(held)}, k) for groups in open_.values() for held, k in groups]


def pack_counts(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS):
    """[({length: times}, sequences)] that hold every counted piece exactly once."""
    lengths, left = np.asarray(lengths, int), np.asarray(counts, np.int64).copy()
    made: list[tuple[dict[int, int], int]] = []
    whole = lengths == capacity
    if left[whole].sum():
        made.append(({capacity: 1}, int(left[whole].sum())))
    lengths, left = lengths[~whole & (left > 0)], left[~whole & (left > 0)]
    if not len(lengths):
        return made
    for config, amount in sorted(solve(lengths, left, capacity, rounds).items(), key=lambda x: -x[1]):
        held = {i: config.count(i) for i in set(config)}
        k = min([int(amount)] + [int(left[i] // a) for i, a in held.items()])
        if k > 0:
            made.append(({int(lengths[i]): a for i, a in held.items()}, k))
            for i, a in held.items():
                left[i] -= k * a
    return made + best_fit(lengths[left > 0], left[left > 0], capacity)


def runs(made) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), sorted; ranks go up to the next row's."""
    table: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for config, k in made:
        offset = 0
        for n, a in sorted(config.items(), reverse=True):
            for _ in range(a):
                r = rank.get(n, 0)
                table.setdefault(n, []).append((r, sequence, offset))
                rank[n] = r + k
                offset += n
        sequence += k
    return {n: np.array(v, np.int64) for n, v in table.items()}


def ranked(found: DataFrame, total: int) -> DataFrame:
    """``found`` with rank: a number from 0 within its length, the same on every run of the job."""
    salts = max(1, -(-total // SALT_ROWS))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    of = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = (salted.groupBy("length", "salt").count()
              .select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"),
                      F.coalesce(F.sum("count").over(of), F.lit(0)).alias("before")))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return (salted.withColumn("within", within)
            .join(before, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
            .withColumn("rank", F.col("before") + F.col("within") - 1)
            .drop("salt", "within", "before", "b_length", "b_salt"))


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece.

    Null and empty texts are one piece of the end id; repeated rows are packed
    as often as they stand; an empty table gives no rows; columns besides
    doc_id and text are not read.
    """
    found = materialize(pieces(docs, capacity, paths, ids), "pieces")
    hist = sorted((r["length"], r["count"]) for r in found.groupBy("length").count().collect())
    lengths, counts = np.array([h[0] for h in hist], int), np.array([h[1] for h in hist], np.int64)
    table = runs(pack_counts(lengths, counts, capacity))
    rows = ranked(found, int(counts.sum()) if len(hist) else 0)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields) + ", sequence_id long, offset long"
    names = found.columns

    def place(batches):
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(n[order]))[0] + 1) if len(n) else []:
                t = table[int(n[part[0]])]
                at = np.searchsorted(t[:, 0], rank[part], side="right") - 1
                sequence[part], offset[part] = t[at, 1] + rank[part] - t[at, 0], t[at, 2]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(sequence), pa.array(offset)],
                                             names=names + ["sequence_id", "offset"])

    return rows.select(*names, "rank").mapInArrow(place, schema)
