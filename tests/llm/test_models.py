"""Language network, quality classifier and language model."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_edge import collected, documents, empty, rows
from pyspark.sql import functions as F

from vigil.llm import language_cnn as c
from vigil.llm import ngram_kn as k
from vigil.llm import quality_fm as q
from vigil.llm.common import remainder

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_remainder(spark):
    got = spark.range(50).select("id", remainder("id", 7).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)


# -- language -----------------------------------------------------------------

def test_language_windows_in_little_memory():
    """A worker shares its executor's memory with another and with what the other stages keep."""
    import tracemalloc

    r = np.random.default_rng(0)
    shapes = ((256, c.EMBED), (4 * c.EMBED, 24), (24,), (24, 3), (3,))
    model = c.ByteCnn(["a", "b", "c"], *[r.normal(size=s).astype(np.float32) for s in shapes])
    windows, tables = r.integers(0, 256, (2048, c.WINDOW)).astype(np.uint8), model.tables()
    tracemalloc.start()
    whole = model.window_probs(windows, tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    assert np.allclose(whole, np.concatenate([model.window_probs(w[None], tables) for w in windows]), atol=1e-5)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    got = {r["doc_id"]: r for r in collected(c.identify(docs))}
    truth = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == set(truth)
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_convolution_equals_direct_form():
    drawn = [(w, y) for t, y in (("der hund und die katze " * 9, "de"), ("the dog and the cat " * 9, "en")) for w in c.draw(t, 1)]
    m = c.train([w for w, _ in drawn], [y for _, y in drawn], epochs=2)
    text = "the katze und der dog " * 20
    w = c.fold(text)[None, :c.WINDOW]
    em = m.emb[w[0]]
    conv = np.array([sum(em[i + j] @ m.filt[j * c.EMBED:(j + 1) * c.EMBED] for j in range(4)) for i in range(c.WINDOW - 3)]) + m.bias
    z = np.maximum(conv.max(0), 0) @ m.out + m.out_bias
    want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(m.window_probs(w)[0], want, atol=1e-4)


@pytest.mark.parametrize("n", [256, 257, 511, 512, 10_000])
def test_windows_cover_the_text(n):
    seen = np.zeros(n, bool)
    for s in c.window_starts(n):
        seen[s:s + c.WINDOW] = True
    assert seen.all()


def test_language_edges(spark):
    docs = documents(spark)
    got = collected(c.identify(docs, docs_per_class=50))
    assert len(got) == len(rows())
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {300, 301, 302, 303} <= und and 306 not in und
    kept = c.reject_unknown(docs, min_score=0.0)
    assert kept.columns == docs.columns and kept.count() == sum(any(map(str.isalpha, t or "")) for _, t, *_ in rows())
    model = c.fit(docs, remainder("doc_id", 4) != 2)
    sure = [(r["doc_id"], r["lang_pred"], r["score"]) for r in collected(c.predict(docs, model))]
    name = max(("en", "de"), key=lambda x: sum(lang == x for _, lang, _ in sure))
    middle = sorted(p for _, lang, p in sure if lang == name)
    middle = (middle[len(middle) // 2 - 1] + middle[len(middle) // 2]) / 2 + 1e-9
    want = sorted((i for i, lang, p in sure if lang == name and p >= middle), key=repr)
    assert sorted((r["doc_id"] for r in collected(c.reject_unknown(docs, min_score=middle, languages=[name]))), key=repr) == want and 0 < len(want) < len(rows())
    assert c.identify(empty(spark)).count() == 0 and c.reject_unknown(empty(spark)).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in collected(c.identify(nothing))} == {"und"}


def test_sample_is_bounded_by_language(spark):
    """Every language, however rare; whole texts; repeated rows count once."""
    many = [(i, f"wort {i} und " * 200, "de", None, None) for i in range(90)] + [(500, "only one", "xx", None, None)] * 3
    got = c.training_windows(spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long"), F.lit(True), docs_per_class=20)
    assert {r["lang"] for r in got} == {"de", "xx"}
    assert sum(r["lang"] == "xx" for r in got) == 1 and 30 < sum(r["lang"] == "de" for r in got) <= 40


# -- quality ------------------------------------------------------------------

def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = sum(y)
    return (rank[np.array(y) == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(y) - pos))


def test_quality_held_out_auc(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in collected(q.classify(docs, labels))}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert auc([h[0] for h in held], [h[1] for h in held]) > 0.95


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    texts = ["a b a c", "", "one two three !!", "é é ß"]
    row, feat, val = q.features(texts, [None, 0, 7, None])
    d = q.BUCKETS + len(q.STATS)
    m = q.FactorisationMachine(0.1, rng.normal(size=d), rng.normal(size=(d, 3)), np.zeros(len(q.STATS)), np.ones(len(q.STATS)))
    x = m.scaled(feat, val)
    got = m.margin(len(texts), row, feat, x)
    for i in range(len(texts)):
        f, v = feat[row == i], x[row == i]
        pairs = sum(m.v[f[a]] @ m.v[f[b]] * v[a] * v[b] for a in range(len(f)) for b in range(a + 1, len(f)))
        assert np.isclose(got[i], 0.1 + m.w[f] @ v + pairs)


def test_quality_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (5, 7, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(collected(q.classify(docs, labels))) == len(rows())
    assert {r["score"] for r in collected(q.classify(docs, labels.limit(0)))} == {0.5}
    assert q.classify(empty(spark), labels).count() == 0
    assert len(collected(q.classify(docs.drop("n_chars"), labels))) == len(rows())


# -- language model -------------------------------------------------------------

def brute_model(train):
    toks = [t + [None] for t in train]
    uni = Counter(w for t in toks for w in t)
    pairs = Counter(p for t in toks for p in zip([0] + t, t))
    ctx, kinds, cont = Counter(), {}, Counter()
    for (h, w), n in pairs.items():
        ctx[h] += n
        kinds.setdefault(h, [0, 0, 0])[min(n, 3) - 1] += 1
        cont[w] += 1
    exact = lambda v: [sum(x == i for x in v) for i in (1, 2, 3, 4)]
    d, low_d = k.discounts(*exact(pairs.values())), k.discounts(*exact(cont.values()))
    rest = sum(low_d[min(n, 3) - 1] for n in cont.values()) / len(pairs)

    def low(w):
        return (cont[w] - low_d[min(cont[w], 3) - 1] if cont[w] else 0) / len(pairs) + rest / (len(uni) + 1)

    def prob(h, w):
        if h not in ctx:
            return low(w)
        n = pairs.get((h, w), 0)
        return (n - d[min(n, 3) - 1] if n else 0) / ctx[h] + sum(a * b for a, b in zip(d, kinds[h])) / ctx[h] * low(w)

    return uni, prob


def split(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("source", ["edges", "edges, many shards", "table"])
def test_language_model_matches_brute_force(spark, source, monkeypatch):
    if "many" in source:
        monkeypatch.setattr(k, "SHARD_TOKENS", 40)  # in this process; the tasks get the shard layout with the model
    docs = documents(spark) if "edges" in source else spark.read.parquet(f"{SMALL}/documents.parquet").limit(120)
    docs = docs.select("doc_id", "text")
    data = [(r["doc_id"], split(r["text"])) for r in docs.collect()]
    out = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
    uni, prob = brute_model([t for i, t in data if not out(i)])
    n, v = sum(uni.values()), len(uni)
    want = []
    for i, t in data:
        t = t + [None]
        want.append((repr(i), len(t), sum(uni[w] > 0 for w in t), n, round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), 5),
                     round(sum(math.log10(prob(h, w)) for h, w in zip([0] + t, t)), 5), out(i)))
    got = [(repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5), r["held_out"])
           for r in collected(k.cross_score(docs))]
    assert sorted(got) == sorted(want)
    h = next(iter(w for _, t in data for w in t))
    assert math.isclose(sum(prob(h, w) for w in uni) + prob(h, b"not a word"), 1, rel_tol=1e-9)


def test_model_of_nothing(spark):
    assert k.cross_score(empty(spark)).count() == 0
    m = k.fit(empty(spark))
    assert [r["score"] for r in collected(k.score(documents(spark).limit(3), m))] == [0.0] * 3


def test_tokens_split_on_six_blanks():
    hashes, index, ends = k.tokens(pa.array([" a\x0b\x0cB \x1cc\x85d\te\xa0f ", None, "a"]))
    assert ends.tolist() == [5, 6, 8] and len(index) == 8
    assert index.tolist()[-2] == index.tolist()[0] and index.tolist()[-1] == len(hashes) - 1
