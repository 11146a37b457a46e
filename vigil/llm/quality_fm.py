"""Quality classifier: a factorisation machine.

A text's features are its words, hashed into buckets and weighted by the share
of the text they make up, statistics of its structure, and its stored length
where the table has one.  The score is

    sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so the pairwise interactions cost time linear in the features.  It is fitted in
numpy by Adam on a bounded sample: at most ``sample`` labelled ids, half
of each class where there are enough, chosen by a hash of the id.  Every word of
every text counts, in the sample and when scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from vigil.llm.common import remainder

BUCKETS = 1 << 12
RANK = 6
SAMPLE = 4000
EPOCHS = 12
THRESHOLD = 0.7
_SLICE = 2 << 20
STATS = ("log_words", "mean_word", "distinct", "symbols", "digits", "upper", "stops", "lines", "repeated_lines",
         "short_lines", "bars", "non_ascii", "top_word", "word_ends_symbol", "log_chars")


def structure(text: str, n_chars: int | None) -> list[float]:
    """Statistics of one text, each about 0 to 1."""
    b = text.encode()
    n = max(1, len(b))
    a = np.bincount(np.frombuffer(b, np.uint8), minlength=256) / n if b else np.zeros(256)
    words, lines = b.split(), [x.strip() for x in b.split(b"\n")]
    lines = [x for x in lines if x]
    m, k = max(1, len(words)), max(1, len(lines))
    alpha = a[65:91].sum() + a[97:123].sum()
    letters = alpha + a[128:].sum()
    symbols = a[33:48].sum() + a[58:65].sum() + a[91:97].sum() + a[123:127].sum()
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    odd = sum(c for w, c in seen.items() if not 65 <= (w[-1] & 0xDF) <= 90 and w[-1] < 128 and w[-1] not in b".,;:!?")
    return [np.log1p(len(words)) / 8, len(b) / m / 10, len(seen) / m, 4 * symbols, 4 * a[48:58].sum(), 4 * a[65:91].sum(),
            10 * (a[46] + a[44]), np.log1p(len(lines)) / 5, 1 - len(set(lines)) / k, sum(len(x) < 20 for x in lines) / k,
            10 * a[124], (letters - alpha), max(seen.values(), default=0) / m, odd / m,
            np.log1p(n_chars if n_chars is not None and n_chars >= 0 else len(text)) / 10]


def features(texts: list[str | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) triples; structure statistics stand after the word buckets."""
    rows, feats, vals = [], [], []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < _SLICE):
            size += len(texts[stop] or "")
            stop += 1
        part = [t or "" for t in texts[at:stop]]
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(part, pa.string())))
        flat, owner = lists.flatten(), pc.list_parent_indices(lists)
        real = pc.not_equal(flat, "")
        coded = flat.filter(real).dictionary_encode()
        owner = owner.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
        digest = xxhash.xxh64_intdigest
        bucket = np.fromiter((digest(w) % BUCKETS for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(coded.dictionary))
        key, count = np.unique(owner * BUCKETS + bucket[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
        row = key // BUCKETS
        total = np.bincount(owner, minlength=len(part))
        rows.append(row + at)
        feats.append(key % BUCKETS)
        vals.append(np.sqrt(count / total[row]))
        for i, t in enumerate(part):
            rows.append(np.full(len(STATS), at + i))
            feats.append(BUCKETS + np.arange(len(STATS)))
            vals.append(np.array(structure(t, n_chars[at + i])))
        at = stop
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(feats), np.concatenate(vals)


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray  # [features, rank]
    mean: np.ndarray  # of the structure statistics, and their spread
    spread: np.ndarray

    def scaled(self, feat: np.ndarray, val: np.ndarray) -> np.ndarray:
        x, s = val.copy(), feat >= BUCKETS
        i = feat[s] - BUCKETS
        x[s] = np.clip((val[s] - self.mean[i]) / self.spread[i], -4, 4)
        return x

    def margin(self, n: int, row, feat, x) -> np.ndarray:
        linear = np.bincount(row, self.w[feat] * x, n)
        pair = np.zeros(n)
        for f in range(self.v.shape[1]):
            vx = self.v[feat, f] * x
            pair += np.bincount(row, vx, n) ** 2 - np.bincount(row, vx * vx, n)
        return self.bias + linear + 0.5 * pair

    def scores(self, texts: list[str | None], n_chars: list[int | None]) -> np.ndarray:
        row, feat, val = features(texts, n_chars)
        z = self.margin(len(texts), row, feat, self.scaled(feat, val))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(n: int, row, feat, val, y: np.ndarray, seed: int = 0, epochs: int = EPOCHS) -> FactorisationMachine:
    """Logistic loss, weighted so that either class counts as it stands in the sample; rows sorted."""
    rng = np.random.default_rng(seed)
    d = BUCKETS + len(STATS)
    dense = np.zeros((n, len(STATS)))
    s = feat >= BUCKETS
    dense[row[s], feat[s] - BUCKETS] = val[s]
    m = FactorisationMachine(0.0, np.zeros(d), rng.normal(0, 0.05, (d, RANK)), dense.mean(0), dense.std(0) + 1e-3)
    x = m.scaled(feat, val)
    order = np.argsort(row, kind="stable")
    row, feat, x = row[order], feat[order], x[order]
    begin = np.searchsorted(row, np.arange(n + 1))
    held = [np.zeros(1), m.w, m.v]
    mom, var = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    step = 0
    for epoch in range(epochs):
        perm = rng.permutation(n)
        for i in range(0, n, 64):
            rows = perm[i:i + 64]
            pick = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows])
            f, xv = feat[pick], x[pick]
            vx = m.v[f] * xv[:, None]
            sums = np.zeros((len(rows), RANK))
            np.add.at(sums, local, vx)
            z = held[0][0] + np.bincount(local, m.w[f] * xv, len(rows)) + 0.5 * ((sums ** 2).sum(1) - np.bincount(local, (vx ** 2).sum(1), len(rows)))
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[rows]) / len(rows)
            gw, gv = 1e-5 * m.w, 1e-4 * m.v
            np.add.at(gw, f, g[local] * xv)
            np.add.at(gv, f, (g[local] * xv)[:, None] * (sums[local] - vx))
            step += 1
            rate = 0.02 * (1 - 0.9 * epoch / max(1, epochs - 1))
            for a, grad in enumerate((np.array([g.sum()]), gw, gv)):
                mom[a] = 0.9 * mom[a] + 0.1 * grad
                var[a] = 0.99 * var[a] + 0.01 * grad ** 2
                held[a] -= rate * (mom[a] / (1 - 0.9 ** step)) / (np.sqrt(var[a] / (1 - 0.99 ** step)) + 1e-8)
    m.bias = float(held[0][0])
    return m


def _inputs(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), n.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, train_on, sample: int = SAMPLE, seed: int = 0) -> FactorisationMachine | None:
    """Fit on labelled ``docs`` rows where ``train_on`` holds; None if a class is missing.

    Labels other than 0 and 1, and ids with more than one label, are left out."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2")
             .select(F.col("doc_id").alias("l_id"), "y").where(train_on("l_id")))
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(count) < 2:
        return None
    half = sample // 2
    want = {y: max(half, sample - count[1 - y]) for y in count}
    h = F.xxhash64("l_id", F.lit(3))
    chosen = known.where("y = 0").orderBy(h, "l_id").limit(want[0]).unionByName(known.where("y = 1").orderBy(h, "l_id").limit(want[1]))
    rows = _inputs(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # at most `sample` ids
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, feat array<int>, val array<float>"

    def extract(batches):
        for b in batches:
            text, n_chars, y = (b.column(i).to_pylist() for i in range(1, 4))
            row, feat, val = features(text, n_chars)
            order = np.argsort(row, kind="stable")
            at = np.searchsorted(row[order], np.arange(1, len(text)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y, pa.int32()),
                                              pa.array([f.astype(np.int32) for f in np.split(feat[order], at)], pa.list_(pa.int32())),
                                              pa.array([v.astype(np.float32) for v in np.split(val[order], at)], pa.list_(pa.float32()))],
                                             names=["doc_id", "y", "feat", "val"])

    got = rows.select("doc_id", "text", "n_chars", "y").mapInArrow(extract, schema)
    got = got.groupBy("doc_id").agg(F.min(F.struct("y", "feat", "val")).alias("r")).select("r.*")  # one row for each id
    got = sorted(got.toArrow().to_pylist(), key=lambda r: (r["y"], r["feat"], r["val"]))
    if len({r["y"] for r in got}) < 2:
        return None
    row = np.repeat(np.arange(len(got)), [len(r["feat"]) for r in got])
    feat = np.concatenate([np.array(r["feat"], np.int64) for r in got])
    val = np.concatenate([np.array(r["val"], float) for r in got])
    m = train(len(got), row, feat, val, np.array([r["y"] for r in got], float), seed)
    seen = sum(r["y"] for r in got) / len(got)  # back from the sample's share of class 1 to that of all labels
    real = count[1] / (count[0] + count[1])
    m.bias += float(np.log(real / (1 - real)) - np.log(seen / (1 - seen)))
    return m


def score(docs: DataFrame, model: FactorisationMachine | None) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text, ...)``: the probability of label 1.

    Null texts count as empty; without a model every score is 0.5.  Of other
    columns only n_chars is read, and may be null or absent."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches):
        for b in batches:
            text, n_chars = b.column(1).to_pylist(), b.column(2).to_pylist()
            s = model.scores(text, n_chars) if model and text else np.full(len(text), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return _inputs(docs).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE,
             threshold: float = THRESHOLD) -> DataFrame:
    """Learn from labelled rows outside one fold of the ids and score every row:
    (doc_id, held_out, score, predicted)."""
    model = fit(docs, labels, lambda c: remainder(c, folds) != held_out, sample)
    return (score(docs, model).withColumn("held_out", remainder("doc_id", folds) == held_out)
            .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
