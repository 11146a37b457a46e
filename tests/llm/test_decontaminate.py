import hashlib
import re

import pytest
from llm_edge import collected, documents, empty, rows
from pyspark.sql import functions as F

from vigil.llm import decontaminate as d

ITEMS = "item_id long, text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def brute(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for win in [iw[i:i + n] for i in range(max(1, len(iw) - n + 1))] if iw else []:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.fixture(scope="module")
def items():
    base = [t for _, t, *_ in rows()]
    long_ = words(next(t for i, t, *_ in rows() if i == 304))
    return [(1, " ".join(long_[100:125])), (2, " ".join(long_[110:121]).upper()), (10, "Der, UND!"), (3, base[2]), (4, None), (5, ""), (6, base[2])]


@pytest.mark.parametrize("limit", [d.MAX_BROADCAST_WINDOWS, 0])
def test_scan_matches_brute_force(spark, items, limit):
    got = collected(d.digest(d.scan(documents(spark), spark.createDataFrame(items, ITEMS), max_broadcast_windows=limit)))
    want = sorted(((i, *brute(t, items)) for i, t, *_ in rows()), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got), key=repr) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_shuffle_path_holds_no_words_per_word(spark, items, monkeypatch):
    plans, real = [], d.materialize
    monkeypatch.setattr(d, "materialize", lambda df, what: (plans.append(df), real(df, what))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans.append(d.hits(documents(spark), spark.createDataFrame(items, ITEMS), max_broadcast_windows=0))
        shown = "".join(spark._jvm.PythonSQLUtils.explainString(x._jdf.queryExecution(), "formatted") for x in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", shown)
    assert inputs and not [x for x in inputs if re.search(r"\bw#", x) and re.search(r"\b(pos|start)#", x)]


def test_equal_hashes_are_verified(spark, items, monkeypatch):
    monkeypatch.setattr(d, "_word_hashes", lambda w: F.transform(w, lambda x: F.lit(1).cast("long")))
    docs = documents(spark).where("length(text) < 5000")
    got = collected(d.digest(d.scan(docs, spark.createDataFrame(items, ITEMS), max_broadcast_windows=0)))
    want = sorted(((i, *brute(t, items)) for i, t, *_ in rows() if t is not None and len(t) < 5000), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got), key=repr) == want


def test_remove(spark, items):
    docs, bench = documents(spark), spark.createDataFrame(items, ITEMS)
    kept = collected(d.remove(docs, bench))
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted((i for i, t, *_ in rows() if not brute(t, items)[1]), key=repr)
    assert set(kept[0]) == set(docs.columns)
    cut = collected(d.remove(docs, bench, what="spans"))
    assert len(cut) == len(rows()) and set(cut[0]) == set(docs.columns)
    n = {(r["doc_id"], len(words(r["text"]))) for r in cut}
    assert n == {(i, len(words(t)) - brute(t, items)[1]) for i, t, *_ in rows()}


def test_empty_tables(spark, items):
    none = spark.createDataFrame([], ITEMS)
    assert d.scan(empty(spark), spark.createDataFrame(items, ITEMS)).count() == 0
    assert {r["n_hit"] for r in collected(d.scan(documents(spark), none))} == {0}
    assert d.remove(documents(spark), none).count() == len(rows())
