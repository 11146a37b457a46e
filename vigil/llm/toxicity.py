"""Toxicity of texts whose words may be disguised: a noisy channel, then a classifier.

1. A character model of order four over a-z, any other letter and the gap between
   words is counted in Spark over all texts outside the held-out fold.
2. Every word opens a lattice: each character stands for itself, or for what the
   channel can have made it from - a look-alike (1d10t), a masked vowel (st*pid),
   a repetition (stuuupid), a stray mark (s.c.u.m) or a blank (s c u m) - at a
   cost.  Viterbi decoding finds the cheapest reading under channel and model.  A
   word of letters without threefold repetition has one path and is itself, so
   only the others are decoded; runs of single characters are decoded as one.
3. The restored words are scored: how much likelier a word, or its first five
   letters, is in toxic texts than in others, counted on a bounded sample of
   labelled rows (``sample`` ids, half of each class where there are enough, by a
   hash of the id).  Copies of a text count about once: a word's support is the
   number of different beginnings among its texts.  Two logistic regressions take
   a text's facts, one its highest word score, the number of other high ones and
   its length, one a very high word score alone, so that one word can suffice; the
   higher of the two is the score.  When they are fitted, each text is left out of
   the counts that score it.

Reads doc_id and text; null texts are empty; texts of any length are scored whole;
repeated rows and ids count as they come (an id with two labels has none).  Without
both classes among the labels every score is 0.5, and nothing is predicted toxic.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from vigil.llm.common import remainder

ORDER, SYMBOLS = 4, 28  # gap, a-z, any other letter
BACKOFF = 4.0  # weight of the lower order
BUCKETS = 1 << 20
STEM = 5
SAMPLE = 20_000  # labelled ids at most
KNOWN = 200_000  # restored words kept by each Python worker
THRESHOLD = 0.7
GROUPS = 64
FACTS = 6  # of a text, for the regressions
#: The facts that each regression sees: all, and the length with a very high word score alone.
VIEWS = (list(range(FACTS)), [0, 4])
_SLICE = 2 << 20
_OTHER = "{"  # follows z; stands for any other letter

#: What a mark may stand for, and its cost.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
         "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
MASKS, VOWELS, STOPS = "*#?%", "aeiou", ".,;:"
LOOK, MASK, STRAY, GAP, TWICE, AGAIN, JOIN, KEEP = 1.2, 3.0, 2.0, 2.0, 6.0, 0.4, 0.2, 1.5

_triple = re.compile(r"(.)\1\1")
_words = re.compile(r"[a-z{]+")
_ends = re.compile(r"^[^a-z{0-9@$!|(<*#€£+]+|[^a-z{0-9@$|€£+*#]+$")
_runs = re.compile(r"[*#%$&@!?]{2,}$|^[*#%&@!?]{2,}")


def fold(text: str) -> str:
    """Lower case without accents; a letter beyond a-z becomes '{'."""
    text = text.lower()
    if text.isascii():
        return text
    out = []
    for c in unicodedata.normalize("NFKD", text):
        kind = unicodedata.category(c)
        if c.isascii() or c in "€£":
            out.append(c)
        elif kind[0] == "L":
            out.append(_OTHER)
        elif kind not in ("Mn", "Cf"):
            out.append(" ")
    return "".join(out)


# --- the character model ---------------------------------------------------------------------------------------------

def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words and the gap after each, and the word that each belongs to."""
    text = "\n".join(words) + "\n"
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    points = points[(points < 0x300) | (points > 0x36F)]  # accents
    word = np.cumsum(points == 10) - (points == 10)
    lower = np.where((points >= 65) & (points <= 90), points + 32, points)
    return np.where((lower >= 97) & (lower <= 122), lower - 96, np.where(lower > 0xBF, 27, 0)).astype(np.int64), word


def _grams(words: list[str], counts: np.ndarray) -> np.ndarray:
    symbols, word = _symbols(words)
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0  # one gap in a row
    symbols, word = symbols[keep], word[keep]
    code = np.zeros(len(symbols), np.int64)
    for back in range(ORDER - 1, -1, -1):
        shifted = np.zeros_like(symbols)
        shifted[back:] = symbols[:len(symbols) - back]
        if back:  # nothing before the word's own beginning but gaps
            same = np.zeros(len(symbols), bool)
            same[back:] = word[back:] == word[:-back]
            shifted = np.where(same, shifted, 0)
        code = code * SYMBOLS + shifted
    return np.bincount(code, counts[word], SYMBOLS ** ORDER).astype(np.int64)


def count_characters(texts: DataFrame) -> np.ndarray:
    """Character sequences of every text of ``texts(text)``; at most 28^4 rows reach the driver."""
    def run(batches):
        total = np.zeros(SYMBOLS ** ORDER, np.int64)
        for b in batches:
            for _, words, at, _ in _slices(b.column(0).to_pylist()):
                if words:
                    total += _grams(words, np.bincount(at, minlength=len(words)))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], names=["code", "n"])

    got = texts.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS ** ORDER, np.int64)
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out


def character_model(counts: np.ndarray) -> np.ndarray:
    """Costs (minus natural log) of each symbol after three others, each order backing off to the next lower one."""
    n = counts.reshape((SYMBOLS,) * ORDER).astype(float)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        now = n.sum(axis=tuple(range(ORDER - order)))
        p = (now + BACKOFF * p) / (now.sum(-1, keepdims=True) + BACKOFF)
    return (-np.log(p)).astype(np.float32).reshape(-1)


# --- the lattice -----------------------------------------------------------------------------------------------------

def lattice(shown: str) -> list[list[tuple[int, float]]]:
    """For each character what it may stand for - a symbol, the gap (0) or nothing (-1) - and the cost."""
    out, before, run = [], "", 0
    for c in shown:
        run = run + 1 if c == before else 1
        before = c
        if "a" <= c <= _OTHER:
            arcs = [(ord(c) - 96, 0.0)]
            if run > 1:
                arcs.append((-1, TWICE if run == 2 else AGAIN))
        elif c == " ":
            arcs = [(0, KEEP), (-1, JOIN)]
        else:
            arcs = [(0, GAP), (-1, STRAY if run == 1 else AGAIN)]
            arcs += [(ord(x) - 96, LOOK) for x in LOOKS.get(c, "")]
            if c in MASKS:
                arcs += [(ord(x) - 96, MASK) for x in VOWELS]
        out.append(arcs)
    return out


def decode(shown: str, model: np.ndarray) -> str:
    """The cheapest reading of ``shown`` (folded); words divided by single blanks."""
    high = SYMBOLS ** (ORDER - 1)
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # last three symbols: cost, path
    for arcs in lattice(shown):
        step: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, path) in best.items():
            for symbol, price in arcs:
                if symbol < 0 or (symbol == 0 and state % SYMBOLS == 0):  # nothing, or a gap after a gap
                    to, c, p = state, cost + price, path
                else:
                    wide = state * SYMBOLS + symbol
                    # a word's beginning forgets what stood before its gap
                    to, c, p = (wide % high if symbol else 0), cost + price + float(model[wide]), (path, symbol)
                if to not in step or c < step[to][0]:
                    step[to] = (c, p)
        best = step
    end = min(((cost + (float(model[state * SYMBOLS]) if state % SYMBOLS else 0.0), state) for state, (cost, _) in best.items()))
    path, out = best[end[1]][1], []
    while path:
        path, symbol = path
        out.append(chr(symbol + 96) if symbol else " ")
    return "".join(reversed(out)).strip()


def restore_word(word: str, model: np.ndarray) -> list[str]:
    """The words that a token without blanks stands for."""
    shown = fold(word)
    if shown.isalpha() and shown.isascii() and not _triple.search(shown):
        return [shown]
    shown = _ends.sub("", _runs.sub("", shown))
    if not _words.search(shown) and not re.search("[@$!|]", shown):
        return []
    if _words.fullmatch(shown) and not _triple.search(shown):
        return [shown]
    return decode(shown, model).split()


class Reader:
    """Restored words, kept by the token that they came from."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def word(self, word: str) -> list[str]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            got = restore_word(word, self.model)
            if len(word) < 64:
                self.known[word] = got
        return got

    def spaced(self, run: list[str]) -> list[str]:
        return decode(fold(" ".join(w.rstrip(STOPS) or w for w in run)), self.model).split()


def _slices(texts: list[str | None]):
    """(first text, distinct tokens, each token's number, its text) of consecutive texts of about 2 MB together."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < _SLICE):
            size += len(texts[stop] or "")
            stop += 1
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([t or "" for t in texts[at:stop]], pa.string())))
        flat, owner = lists.flatten(), pc.list_parent_indices(lists)
        real = pc.not_equal(flat, "")
        coded = flat.filter(real).dictionary_encode()
        yield (at, stop), coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), \
            owner.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
        at = stop


def _single_runs(words: list[str], at: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Positions from and to of three or more tokens of one character in a row, whatever stops follow it."""
    one = np.array([len(c := w.rstrip(STOPS)) == 1 and (c.isalpha() or c in LOOKS) for w in words], bool)
    if not len(at) or not one.any():
        return []
    single = one[at]
    edge = np.ones(len(at), bool)
    edge[1:] = (single[1:] != single[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(at))
    return [(int(i), int(j)) for i, j in zip(begin, end) if single[i] and j - i >= 3]


def restored_words(texts: list[str | None], reader: Reader):
    """For consecutive texts: (from, to), restored words, and (word, text) of each occurrence; a text's first words."""
    for span, tokens, at, owner in _slices(texts):
        index: dict[str, int] = {}
        put = lambda w: index.setdefault(w, len(index))
        read = [[put(x) for x in reader.word(t)] for t in tokens]
        n = np.array([len(r) for r in read], np.int64)
        flat = np.array([x for r in read for x in r], np.int64)
        starts = np.cumsum(n) - n
        each = n[at] if len(at) else np.zeros(0, np.int64)
        word = flat[np.arange(int(each.sum())) + np.repeat(starts[at] - np.cumsum(each) + each, each)] if len(flat) else np.zeros(0, np.int64)
        doc = np.repeat(owner, each)
        more = [(put(w), int(owner[i])) for i, j in _single_runs(tokens, at, owner) for w in reader.spaced([tokens[k] for k in at[i:j]])]
        word = np.append(word, np.array([w for w, _ in more], np.int64))
        doc = np.append(doc, np.array([d for _, d in more], np.int64))
        begins = np.searchsorted(owner, np.arange(span[1] - span[0]))
        ends = np.searchsorted(owner, np.arange(span[1] - span[0]), "right")
        heads = [" ".join(tokens[k] for k in at[i:min(i + 8, j)]) for i, j in zip(begins, ends)]
        yield span, list(index), word, doc, heads


def _features(words: list[str]) -> np.ndarray:
    """[word, 2, 2] buckets: of the word and of its first letters, each by two hashes with halves of their own."""
    digest, half = xxhash.xxh64_intdigest, BUCKETS // 2
    pairs = lambda x: (x % half, half + (x >> 32) % half)
    return np.array([(pairs(digest(w)), pairs(digest(w[:STEM], 7))) for w in words], np.int64).reshape(-1, 2, 2)


def _facts(n: int, score: np.ndarray, word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each text: its length, how far its highest word score is above 0 to 3, and the number of other high ones."""
    out = np.zeros((n, FACTS))
    total = np.bincount(doc, minlength=n)
    high = np.flatnonzero(score[word] > 0) if len(word) else np.zeros(0, np.int64)
    out[:, 0] = np.log1p(total) / 5
    top = np.zeros(n)
    np.maximum.at(top, doc[high], score[word[high]])
    for k in range(4):
        out[:, 1 + k] = np.maximum(0, top - k)
    high = high[score[word[high]] > 2] if len(high) else high
    key = np.unique(doc[high] * np.int64(max(1, len(score))) + word[high])
    out[:, 5] = np.log1p(np.maximum(0, np.bincount(key // max(1, len(score)), minlength=n) - 1))
    return out


# --- the classifier --------------------------------------------------------------------------------------------------

@dataclass
class Model:
    characters: np.ndarray
    scores: np.ndarray  # of a bucket
    weights: list[np.ndarray]  # of the facts of each view, and the bias


def _word_scores(table: np.ndarray, words: list[str]) -> np.ndarray:
    return table[_features(words)].min(2).max(1) if words else np.zeros(0, np.float32)  # both hashes must agree


def _bucket_scores(t, c, groups, n_t: int, n_c: int, less: int) -> np.ndarray:
    """log of the support among toxic texts over that among as many others; ``less``: 1 leaves out one toxic text, 0
    one other text, -1 none."""
    seen = -GROUPS * np.log(np.maximum(1 - groups / GROUPS, 0.5 / GROUPS))  # of different beginnings
    t = np.minimum(t, np.where(groups < GROUPS - 8, np.ceil(seen), t))
    t, n_t = (np.maximum(t - 1, 0), max(1, n_t - 1)) if less == 1 else (t, n_t)
    c, n_c = (np.maximum(c - 1, 0), max(1, n_c - 1)) if less == 0 else (c, n_c)
    return np.log((t + 1) / (c * n_t / max(1, n_c) + 1)).astype(np.float32)


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the bias."""
    z = np.column_stack([x, np.ones(len(x))])
    w, pen = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (y - p) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _labelled(docs: DataFrame, labels: DataFrame, train_on, sample: int):
    """The sample's rows (doc_id, text, y), and the labelled ids of each class."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2").select(F.col("doc_id").alias("l_id"), "y").where(train_on("l_id")))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(n) < 2:
        return None, n
    take = {y: max(sample // 2, sample - n[1 - y]) for y in n}
    ids = known.where("y = 0").orderBy(F.xxhash64("l_id"), "l_id").limit(take[0]).unionByName(
        known.where("y = 1").orderBy(F.xxhash64("l_id"), "l_id").limit(take[1]))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"))  # at most `sample` ids
    return rows.select("doc_id", "text", "y"), n


def fit(docs: DataFrame, labels: DataFrame, train_on, sample: int = SAMPLE) -> Model | None:
    """Learn from ``docs`` rows and ``labels(doc_id, toxic)`` where ``train_on`` holds for the id; None if a class is
    missing."""
    characters = character_model(count_characters(docs.where(train_on("doc_id")).select(F.col("text").cast("string").alias("text"))))
    rows, n = _labelled(docs, labels, train_on, sample)
    if rows is None:
        return None
    schema = "bucket int, t long, c long, groups long"

    def count(batches):
        reader = Reader(characters)
        t, c = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        groups, texts = np.zeros(BUCKETS, np.uint64), np.zeros(2, np.int64)
        for b in batches:
            y = np.array(b.column(2).to_pylist(), np.int64)
            texts += np.bincount(y, minlength=2)
            for (first, stop), words, word, doc, heads in restored_words(b.column(1).to_pylist(), reader):
                if not words:
                    continue
                key = np.unique(np.repeat(doc, 4) * BUCKETS + _features(words)[word].reshape(-1))
                d, bucket = key // BUCKETS, key % BUCKETS
                toxic = y[first:stop][d] == 1
                t += np.bincount(bucket[toxic], minlength=BUCKETS)
                c += np.bincount(bucket[~toxic], minlength=BUCKETS)
                bit = np.array([1 << (xxhash.xxh64_intdigest(h) % GROUPS) for h in heads], np.uint64)
                np.bitwise_or.at(groups, bucket[toxic], bit[d[toxic]])
        at = np.flatnonzero(t + c)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(t[at]), pa.array(c[at]), pa.array(groups[at].view(np.int64))],
                                         names=["bucket", "t", "c", "groups"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array(texts[1:]), pa.array(texts[:1]), pa.array([0], pa.int64())],
                                         names=["bucket", "t", "c", "groups"])

    got = rows.mapInArrow(count, schema).groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.bit_or("groups").alias("groups")).toArrow()
    bucket, ts, cs, gs = (got.column(x).to_numpy() for x in ("bucket", "t", "c", "groups"))  # at most 2^20 + 1 rows
    texts = bucket < 0
    n_t, n_c = int(ts[texts].sum()), int(cs[texts].sum())
    t, c, groups = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    t[bucket[~texts]], c[bucket[~texts]] = ts[~texts], cs[~texts]
    groups[bucket[~texts]] = np.unpackbits(gs[~texts].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1).sum(1)
    left_out = [_bucket_scores(t, c, groups, n_t, n_c, y) for y in (0, 1)]

    def facts(batches):
        reader = Reader(characters)
        for b in batches:
            y = np.array(b.column(2).to_pylist(), np.int64)
            x = np.zeros((b.num_rows, FACTS))
            for (first, stop), words, word, doc, _ in restored_words(b.column(1).to_pylist(), reader):
                of = y[first:stop]
                both = [_facts(stop - first, _word_scores(s, words), word, doc) for s in left_out]
                x[first:stop] = np.where(of[:, None] == 1, both[1], both[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    one = rows.mapInArrow(facts, f"doc_id {kind}, y int, x array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = sorted((r["y"], list(r["x"])) for r in one.collect())  # a row for each of the sample's ids
    y, x = np.array([r[0] for r in got], float), np.array([r[1] for r in got], float).reshape(-1, FACTS)
    if len(set(y)) < 2:
        return None
    seen, real = y.mean(), n[1] / (n[0] + n[1])  # back from the sample's share to that of all labels
    shift = np.log(real / (1 - real)) - np.log(seen / (1 - seen))
    weights = [_regress(x[:, view], y) for view in VIEWS]
    for w in weights:
        w[-1] += shift
    return Model(characters, _bucket_scores(t, c, groups, n_t, n_c, -1), weights)


def text_scores(texts: list[str | None], model: Model | None, reader: Reader | None = None) -> np.ndarray:
    """The probability of label 1 for each text."""
    out = np.full(len(texts), 0.5)
    if model is None:
        return out
    for (first, stop), words, word, doc, _ in restored_words(texts, reader or Reader(model.characters)):
        x = _facts(stop - first, _word_scores(model.scores, words), word, doc)
        margin = np.max([x[:, view] @ w[:-1] + w[-1] for view, w in zip(VIEWS, model.weights)], axis=0)
        out[first:stop] = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        reader = Reader(model.characters) if model else None
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_scores(b.column(1).to_pylist(), model, reader))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def restore(docs: DataFrame, characters: np.ndarray) -> DataFrame:
    """(doc_id, text): the texts with every disguised word restored, words divided by blanks; runs of single
    characters are read as one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        reader = Reader(characters)
        for b in batches:
            out = []
            for (first, stop), tokens, at, owner in _slices(b.column(1).to_pylist()):
                parts = [[] for _ in range(first, stop)]
                runs, k = dict(_single_runs(tokens, at, owner)), 0
                while k < len(at):
                    if k in runs:
                        parts[owner[k]] += reader.spaced([tokens[i] for i in at[k:runs[k]]])
                        k = runs[k]
                    else:
                        parts[owner[k]] += reader.word(tokens[at[k]])
                        k += 1
                out += [" ".join(p) for p in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text string")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Learn outside one fold of the ids and score every row: (doc_id, held_out, score, predicted)."""
    model = fit(docs, labels, lambda c: remainder(c, folds) != held_out, sample)
    return (score(docs, model).withColumn("held_out", remainder("doc_id", folds) == held_out)
            .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
