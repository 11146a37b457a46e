"""Decoding against exhaustive search, and held-out toxicity of plain and disguised words."""

import itertools
import random
import zlib

import numpy as np
import pytest
from llm_edge import collected, documents, empty, rows
from pyspark.sql import functions as F

from vigil.llm import toxicity as X
from vigil.llm.common import remainder

BAD = ["drelmok", "vuntiger", "plorash", "skabelin"]
SYLL = ["the", "on", "er", "ti", "ba", "lo", "mu", "re", "und", "der", "ch", "que", "la", "eau", "so", "mi"]


def corpus(n=900, seed=5):
    """Texts of invented words; a fifth hold bad ones, plain in the learned folds, disguised half of the time in the
    held-out one."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice(SYLL) for _ in range(rnd.randint(1, 4))) for _ in range(600)]
    disguise = [lambda w: w.replace("e", "3").replace("o", "0").replace("a", "4"), lambda w: " ".join(w), lambda w: w[0] + w[1] * 4 + w[2:],
                lambda w: ".".join(w).upper()]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120))]
        toxic = int(rnd.random() < 0.2)
        held = zlib.crc32(str(i).encode()) % 3 == 1
        for _ in range(rnd.randint(2, 4) * toxic):
            w = rnd.choice(BAD)
            words.insert(rnd.randrange(len(words)), rnd.choice(disguise)(w) if held and i % 2 else w)
        docs.append((i, " ".join(words) + "."))
        labels.append((i, None, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return d, y, X.fit(d, y, lambda c: remainder(c, 3) != 1)


def test_decode_is_the_cheapest_reading(learned):
    """Over all readings of the lattice."""
    model = learned[2].characters

    def cost(reading):
        total, state, after_gap = 0.0, 0, True
        for symbol, price in reading:
            total += price
            if symbol < 0 or (symbol == 0 and after_gap):
                continue
            wide = state * X.SYMBOLS + symbol
            total += float(model[wide])
            state, after_gap = (wide % X.SYMBOLS ** 3 if symbol else 0), symbol == 0
        return total + (0.0 if after_gap else float(model[state * X.SYMBOLS]))

    def text(reading):
        out = "".join(" " if s == 0 else chr(s + 96) for s, _ in reading if s >= 0)
        return " ".join(out.split())

    for shown in ["m1", "p10ra", "p l o r", "d.r.3", "st*p", "aaab", "1d10t", "t@5!"]:
        best = min(itertools.product(*X.lattice(shown)), key=cost)
        got = X.decode(shown, model)
        same = [r for r in itertools.product(*X.lattice(shown)) if text(r) == " ".join(got.split())]
        assert min(map(cost, same)) == pytest.approx(cost(best)), (shown, got, text(best))


@pytest.mark.parametrize("shown", ["dr3lm0k", "d r e l m o k", "d.r.e.l.m.o.k", "DRELMOK!!", "dreeeelmok", "drélmok", "dr*lmok", "dre|mok", "drelmok###"])
def test_disguises_are_undone(learned, shown):
    reader = X.Reader(learned[2].characters)
    assert (reader.spaced(shown.split()) if " " in shown else reader.word(shown.lower())) == ["drelmok"]


def test_plain_words_are_themselves(learned):
    reader = X.Reader(learned[2].characters)
    for w in ["the", "eau", "Letter", "ñandú", "über", "2024", "3.5", "---"]:
        want = {"ñandú": "nandu", "über": "uber", "2024": None, "3.5": None, "---": None}.get(w, w.lower())
        assert reader.word(w.lower()) == ([want] if want else [])


def test_held_out(learned):
    """Toxic texts of the held-out fold, disguised or not, against clean ones."""
    d, _, model = learned
    want = {i: y for i, _, y in corpus()[1]}
    got = {r["doc_id"]: r["score"] for r in collected(X.score(d, model)) if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    caught = [got[i] >= X.THRESHOLD for i in got if want[i]]
    wrong = [got[i] >= X.THRESHOLD for i in got if not want[i]]
    assert len(caught) > 40 and np.mean(caught) >= 0.95 and np.mean(wrong) <= 0.01


def test_one_word_suffices_and_copies_do_not(spark, learned):
    model = learned[2]
    clean, bad = X.text_scores(["the lo mu re und der " * 20, "the lo mu re und der " * 20 + "p l 0 r a s h"], model)
    assert clean < 0.2 and bad >= X.THRESHOLD
    docs, labels = corpus(400, 8)
    copies = [(1000 + i, "wuschel brandig keltern " + " ".join(SYLL)) for i in range(120)]  # one toxic text, many times
    d = spark.createDataFrame(docs + copies, "doc_id long, text string")
    y = spark.createDataFrame(labels + [(i, None, 1) for i, _ in copies], "doc_id long, quality int, toxic int")
    model = X.fit(d, y, lambda c: F.lit(True))
    assert X._word_scores(model.scores, ["brandig"])[0] < 1.5 < X._word_scores(model.scores, ["plorash"])[0]


def test_characters_of_all_texts(spark):
    texts = ["Abc abc", "é 1x", None, "abc\nzz"]
    counts = X.count_characters(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = {}
    for t in texts:
        for w in X.fold(t or "").split():
            s = [0, 0, 0]
            for c in [(ord(c) - 96 if "a" <= c <= "{" else 0) for c in w] + [0]:
                if c == 0 and s[-1] == 0:
                    continue
                s.append(c)
                k = ((s[-4] * 28 + s[-3]) * 28 + s[-2]) * 28 + s[-1]
                want[k] = want.get(k, 0) + 1
    assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == want


def test_restored_texts(spark, learned):
    got = collected(X.restore(spark.createDataFrame([(1, "The d r e l m o k, re-LO 12 v0ntig"), (2, None)], "doc_id long, text string"), learned[2].characters))
    assert got[0]["text"].startswith("the drelmok relo") and got[1]["text"] == ""


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns, empty tables, missing classes and labels in
    conflict."""
    docs = documents(spark)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(3, 1, 0), (4, 1, None), (None, 1, 1), (5, 0, 7)], "doc_id long, quality int, toxic int")
    got = collected(X.classify(docs.withColumn("toxic", F.lit(1)), labels))
    assert len(got) == len(rows()) and set(got[0]) == {"doc_id", "held_out", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1) for r in got)
    assert collected(X.classify(empty(spark), labels)) == []
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {(r["score"], r["predicted"]) for r in collected(X.classify(documents(spark, clash=False), few))} == {(0.5, 0)}
