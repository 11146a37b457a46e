"""Language ID by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over windows of fixed
length, the maximum over positions is pooled and a softmax gives the language.
A text is cut into windows that cover all of it (the last one is moved back to
end with the text; a shorter text is padded with blanks); the text's
probabilities are the mean of its windows'.

Training takes a bounded sample: at most ``docs_per_class`` labelled documents
of each language, chosen by a hash of the id, with up to ``windows_per_doc``
random windows each.  Prediction reads every byte of every text.  For it the
embedding and the filters are folded into tables by pairs of neighbouring
bytes, so a filter output is the sum of two table rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vigil.llm.common import broadcast_if_small, materialize, remainder

WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
EMBED = 8
WINDOW = 256
DOCS_PER_CLASS = 800
WINDOWS_PER_DOC = 2
EPOCHS = 6
UNKNOWN = "und"
MIN_SCORE = 0.35  # a text whose best language is less likely is in none that was learned
_STEP = 1 << 18  # bytes classified at once
_PART = 1 << 15  # and of these convolved at once: their outputs are two times 3 MB


@dataclass
class ByteCnn:
    """emb[256, E], filt[4E, F] (zero rows above a filter's width), bias[F], out[F, C], out_bias[C]."""

    classes: list[str]
    emb: np.ndarray
    filt: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter parts of the byte pairs at offsets 0-1 and 2-3, as [65536, F]."""
        e = self.emb.shape[1]
        t = [self.emb @ self.filt[j * e:(j + 1) * e] for j in range(4)]
        pair = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for j in (0, 2)]
        return pair[0] + self.bias.astype(np.float32), pair[1]

    def window_probs(self, windows: np.ndarray, tables=None) -> np.ndarray:
        """Softmax of each row of bytes [n, WINDOW]."""
        lo, hi = tables or self.tables()
        n, length = windows.shape
        probs = np.empty((n, len(self.classes)))
        step = max(1, _STEP // length)
        for i in range(0, n, step):
            w = windows[i:i + step].astype(np.int32)
            pair = (w[:, :-1] << 8) | w[:, 1:]
            pooled = np.empty((len(w), lo.shape[1]), np.result_type(lo, hi))
            for j in range(0, len(w), max(1, _PART // length)):
                k = slice(j, j + max(1, _PART // length))
                conv = lo.take(pair[k, :length - 3], axis=0)
                conv += hi.take(pair[k, 2:], axis=0)
                pooled[k] = conv.max(axis=1)
            pooled = np.maximum(pooled, 0)
            logit = pooled @ self.out + self.out_bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            probs[i:i + step] = p / p.sum(axis=1, keepdims=True)
        return probs


def fold(text: str) -> np.ndarray:
    """The bytes the network sees: UTF-8, A-Z lowered."""
    return np.frombuffer(text.encode().lower(), np.uint8)


def window_starts(n: int, length: int = WINDOW) -> np.ndarray:
    """Starts of the windows that cover n bytes (n >= length)."""
    s = np.arange(0, n - length + 1, length)
    return s if (n % length) == 0 else np.append(s, n - length)


def draw(text: str, seed: int, window: int = WINDOW, windows_per_doc: int = WINDOWS_PER_DOC) -> list[np.ndarray]:
    """Windows to learn from, from anywhere in the text; shorter ones stand for short texts."""
    rng, b, out = np.random.default_rng(seed), fold(text), []
    for _ in range(windows_per_doc if len(b) > window else min(1, len(b))):
        s = int(rng.integers(0, max(1, len(b) - window + 1)))
        part = b[s:s + int(rng.integers(window // 8, window + 1))]
        out.append(np.pad(part, (0, window - len(part)), constant_values=32))
    return out


def train(rows: list[np.ndarray], labels: list[str], seed: int = 0, window: int = WINDOW, epochs: int = EPOCHS) -> ByteCnn | None:
    """Fit the network to windows; None without any."""
    if not rows:
        return None
    rng, classes = np.random.default_rng(seed), sorted(set(labels))
    number = {c: i for i, c in enumerate(classes)}
    ys = [number[y] for y in labels]
    x, y = np.array(rows), np.array(ys)
    f, e, c = FILTERS * len(WIDTHS), EMBED, len(classes)
    mask = np.zeros((4 * e, f), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w * e, i * FILTERS:(i + 1) * FILTERS] = 1
    p = [rng.normal(0, 0.3, (256, e)), rng.normal(0, 0.3, (4 * e, f)) * mask, np.zeros(f),
         rng.normal(0, 0.3, (f, c)), np.zeros(c)]
    p = [v.astype(np.float32) for v in p]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    weight = (len(y) / (c * np.maximum(1, np.bincount(y, minlength=c)))).astype(np.float32)
    step, batch, at = 0, 32, window - 3
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            k = order[i:i + batch]
            xb, yb, n = x[k], y[k], len(k)
            em = p[0][xb]
            cols = np.concatenate([em[:, j:j + at] for j in range(4)], axis=2)
            conv = cols @ p[1] + p[2]
            top = conv.argmax(axis=1)
            pooled = np.take_along_axis(conv, top[:, None, :], 1)[:, 0, :]
            h = np.maximum(pooled, 0)
            logit = h @ p[3] + p[4]
            q = np.exp(logit - logit.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(n), yb] -= 1
            q *= (weight[yb] / n)[:, None]
            gh = (q @ p[3].T) * (pooled > 0)
            hit = np.take_along_axis(cols, top[:, :, None], 1)  # [n, F, 4E]: what each filter's best position saw
            gf = np.einsum("nf,nfd->df", gh, hit) * mask
            ge = np.zeros_like(p[0])
            back = gh[:, :, None] * p[1].T[None]  # [n, F, 4E]
            rowsel = np.arange(n)[:, None]
            for j in range(4):
                np.add.at(ge, xb[rowsel, top + j].ravel(), back[:, :, j * e:(j + 1) * e].reshape(-1, e))
            grads = [ge, gf, gh.sum(0), h.T @ q + 1e-4 * p[3], q.sum(0)]
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / max(1, epochs - 1))
            for a, g in enumerate(grads):
                m[a] = 0.9 * m[a] + 0.1 * g
                v[a] = 0.99 * v[a] + 0.01 * g * g
                p[a] -= (rate * (m[a] / (1 - 0.9 ** step)) / (np.sqrt(v[a] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return ByteCnn(classes, *p)


def training_windows(docs: DataFrame, train_on, docs_per_class: int = DOCS_PER_CLASS, seed: int = 0) -> list:
    """Rows (lang, window) from at most ``docs_per_class`` texts of every language, those with the least 64-bit hashes
    of id and text; whole texts are drawn from, and only their windows reach the driver."""
    h = F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), "text")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & train_on).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), h.alias("h"))
    sizes = materialize(known.groupBy(F.col("lang").alias("l_lang")).agg(F.count(F.lit(1)).alias("n")), "languages")
    # hashes are uniform: a few more than wanted lie below this share of their range, whatever the language's size
    share = F.lit(docs_per_class + 6 * docs_per_class ** 0.5 + 20) / F.col("n")
    chosen = (known.join(broadcast_if_small(sizes), F.col("lang") == F.col("l_lang"))
              .where((F.col("h").cast("double") + 2.0 ** 63) / 2.0 ** 64 < share).select("lang", "text", "h"))

    def run(batches):
        for b in batches:
            lang, h, windows = [], [], []
            for name, text, key in zip(*(b.column(i).to_pylist() for i in range(3))):
                for w in draw(text, [key & 0xFFFFFFFF, (key >> 32) & 0xFFFFFFFF, seed]):
                    lang.append(name), h.append(key), windows.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h, pa.int64()), pa.array(windows, pa.binary())], names=["lang", "h", "window"])

    # repeated rows have equal windows
    drawn = chosen.mapInArrow(run, "lang string, h long, window binary").distinct()
    nth = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    return drawn.withColumn("nth", nth).where(F.col("nth") <= docs_per_class).orderBy("h", "lang", "window").collect()


def fit(docs: DataFrame, train_on, docs_per_class: int = DOCS_PER_CLASS, seed: int = 0) -> ByteCnn | None:
    """Train on a sample of ``docs(doc_id, text, lang)`` rows where ``train_on`` holds."""
    rows = training_windows(docs, train_on, docs_per_class, seed)
    return train([np.frombuffer(bytes(r["window"]), np.uint8) for r in rows], [r["lang"] for r in rows], seed)


def predict_texts(model: ByteCnn | None, texts: list[str | None], tables=None) -> tuple[list[str], np.ndarray]:
    """Language and its probability of each text; ``und`` (0) where it is null or has no letter."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return lang, score
    rows, owner, pending = [], [], 0
    total = np.zeros((len(texts), len(model.classes)))

    def flush():
        if rows:
            probs = model.window_probs(np.concatenate(rows), tables)
            np.add.at(total, np.concatenate(owner), probs)
            rows.clear(), owner.clear()

    for i, t in enumerate(texts):
        if t is None or not any(map(str.isalpha, t)):
            continue
        b = fold(t)
        if len(b) < WINDOW:
            w = np.pad(b, (0, WINDOW - len(b)), constant_values=32)[None]
        else:
            every = np.lib.stride_tricks.sliding_window_view(b, WINDOW)
            w = every[window_starts(len(b))]
        for at in range(0, len(w), 4096):
            part = w[at:at + 4096]
            rows.append(part)
            owner.append(np.full(len(part), i))
            pending += len(part)
            if pending >= 4096:
                flush()
                pending = 0
    flush()
    for i in np.nonzero(total.sum(axis=1))[0]:
        k = int(total[i].argmax())
        lang[i], score[i] = model.classes[k], min(1.0, total[i, k] / total[i].sum())
    return lang, score


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, lang_pred, score), one row per row.

    Null texts and texts without a letter give ``und`` with score 0, and so
    does every text when nothing could be learned.  Other columns are not read.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"

    def run(batches):
        tables = model.tables() if model else None
        for b in batches:
            lang, score = predict_texts(model, b.column(1).to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, docs_per_class: int = DOCS_PER_CLASS) -> DataFrame:
    """Learn from the rows outside one fold of the ids and predict every row:
    (doc_id, held_out, lang_pred, score)."""
    out = remainder("doc_id", folds) == held_out
    model = fit(docs, ~out, docs_per_class)
    return predict(docs, model).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score")


def reject_unknown(docs: DataFrame, folds: int = 4, held_out: int = 2, docs_per_class: int = DOCS_PER_CLASS,
                   min_score: float = MIN_SCORE, languages: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` in a learned language, or in one of ``languages``: those go
    whose text has no letter, whose best language has a probability below
    ``min_score``, or is not wanted.  All columns stay, whatever their names; the
    filter is evaluated where the row is.  Without a model only letterless texts go."""
    model = fit(docs, remainder("doc_id", folds) != held_out, docs_per_class)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        lang, score = predict_texts(model, texts.tolist(), model.tables() if model else None)
        return pd.Series([x != UNKNOWN and p >= min_score and (languages is None or x in languages) for x, p in zip(lang, score)], dtype=bool)

    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return docs.where(known("text"))
