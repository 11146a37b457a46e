import random
import zlib

import numpy as np
import pytest
from llm_edge import collected, documents, empty, rows

import corpus_pipeline
from vigil.llm import packing as p

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.tokenizer_paths()[0])
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [p.END]


def test_pieces_take_few_texts_at_once(spark, monkeypatch):
    docs = [(i, None if i % 7 == 0 else f"word {i} " * (i % 9)) for i in range(2500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    whole = collected(p.pieces(df))
    monkeypatch.setattr(p, "BATCH", 1 << 20)
    assert p.BATCH > 1000 and sorted(map(tuple, whole)) == sorted(map(tuple, collected(p.pieces(df))))
    assert sorted({r["doc_id"] for r in whole}) == list(range(2500))


def test_ids_equal_the_tokenizer(reference):
    rnd, ids = random.Random(0), p.Ids(*p.tokenizer_paths())
    parts = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "1", "23", "!", "日本", "😀", "<|endoftext|>", "\r\n", "\x1c", "\x85", "́", "’",
             "​", "\x00", "_", "word"]
    for _ in range(4000):
        x = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert list(np.frombuffer(ids(x), "<u4")) == reference(x)[:-1], repr(x)


def whole(out, docs, reference, capacity=p.CAPACITY):
    """Every document's ids, cut as told, gapless in sequences that fit."""
    want = sorted((repr(d["doc_id"]), k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()))
                  for d in docs for ids in [reference(d["text"])] for k, (s, n) in enumerate(p.cut(len(ids), capacity)))
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in places.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= capacity
    return len(places), -(-sum(r["length"] for r in out) // capacity)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack_is_whole(spark, reference, capacity):
    docs = documents(spark)
    out = collected(p.pack(docs, capacity, ids=True))
    used, least = whole(out, collected(docs), reference, capacity)
    assert used <= 1.05 * least + 2
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in out)
    assert p.pack(empty(spark)).count() == 0


def test_salted_ranks(spark, monkeypatch):
    monkeypatch.setattr(p, "SALT_ROWS", 7)
    df = spark.createDataFrame([(i, 0, 0, 1 + i % 3 // 2, 5) for i in range(200)] + [(1, 0, 0, 1, 5)] * 9,
                               "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = p.ranked(df, 209).collect()
    for n in (1, 2):
        r = sorted(x["rank"] for x in got if x["length"] == n)
        assert r == list(range(len(r)))


def test_cut():
    assert p.cut(1) == [(0, 1)] and p.cut(2048) == [(0, 2048)] and p.cut(2049) == [(0, 1), (1, 2048)]
    assert p.cut(4096) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("kind", ["spread", "large", "one", "small", "none"])
def test_counts_are_packed_once_and_well(kind):
    rng = np.random.default_rng(0)
    n = {"spread": rng.integers(1, 2049, 20_000), "large": rng.integers(1025, 2049, 500), "one": np.full(3000, 700),
         "small": rng.integers(1, 40, 5000), "none": np.zeros(0, int)}[kind]
    lengths, counts = np.unique(n, return_counts=True)
    made = p.pack_counts(lengths, counts)
    held = {}
    for config, k in made:
        assert sum(a * x for a, x in config.items()) <= 2048
        for a, x in config.items():
            held[a] = held.get(a, 0) + x * k
    assert held == dict(zip(lengths.tolist(), counts.tolist()))
    bound = {"large": (n > 1024).sum(), "one": 1500}.get(kind, -(-n.sum() // 2048))
    assert sum(k for _, k in made) <= 1.005 * bound + 1


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        size, worth, room = rng.permutation(30)[:5] + 1, rng.random(5), 60
        best = [0.0] * (room + 1)
        for c in range(1, room + 1):
            best[c] = max([best[c - 1]] + [best[c - s] + w for s, w in zip(size, worth) if s <= c])
        value, choice = p.knapsack(size, worth, room)
        assert np.allclose(value, best)
        config = p.configuration(2, size, choice, room)
        assert 2 in config and sum(size[list(config)]) <= room
        assert np.isclose(worth[list(config)].sum(), worth[2] + best[room - size[2]])


def test_pipeline_by_stage(spark, reference):
    """Each stage against its operator's brute-force rule, on its own input."""
    from test_decontaminate import words
    from test_secrets_pii import brute_secrets
    from test_simhash import brute_components, brute_fp
    from vigil.llm import language_cnn
    from vigil.llm.common import materialize, remainder

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    one = materialize(stage["language"](spark, docs, SMALL))
    a = collected(one)
    model = language_cnn.fit(docs, remainder("doc_id", 4) != 2)
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in collected(language_cnn.predict(docs, model))}
    letters = {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))}
    assert sorted(r["doc_id"] for r in a) == sorted(i for i, (lang, p) in said.items() if lang != "und" and p >= language_cnn.MIN_SCORE)
    assert len(a) >= 0.99 * len(letters) and all(said[i][0] == "und" for i in said if i not in letters)

    two = materialize(stage["near_duplicates"](spark, one, SMALL))
    fp = {r["doc_id"]: brute_fp(r["text"]) for r in a}
    comp = brute_components(set(fp.values()), lambda x, y: bin(x ^ y).count("1") <= 2)
    least = {}
    for i, f in fp.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    assert sorted(r["doc_id"] for r in collected(two)) == sorted(least.values())

    windows = {tuple(w[i:i + 10]) for t in bench for w in [words(t)] if w for i in range(max(1, len(w) - 9))}

    def clean(t):
        w = words(t)
        return not any(tuple(w[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    three = materialize(stage["decontamination"](spark, two, SMALL))
    assert sorted(r["doc_id"] for r in collected(three)) == sorted(r["doc_id"] for r in collected(two) if clean(r["text"]))

    four = materialize(stage["secrets"](spark, three, SMALL))
    before, after = {r["doc_id"]: r["text"] for r in collected(three)}, {r["doc_id"]: r["text"] for r in collected(four)}
    assert set(before) == set(after) and all(d.columns == docs.columns for d in (one, two, three, four))
    for i, t in before.items():
        assert (after[i] == t) == (sum(brute_secrets(t)[:3]) == 0) and sum(brute_secrets(after[i])[:3]) == 0

    whole(collected(stage["packing"](spark, four, SMALL)), collected(four), reference)
    out = collected(corpus_pipeline.run(spark, SMALL))
    used, least_ = whole(out, collected(four), reference)
    assert used <= least_ + 3


def test_pipeline_on_edges(spark, tmp_path):
    documents(spark, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this is there, not at all, in any of those")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = collected(corpus_pipeline.run(spark, str(tmp_path)))
    ids = {r["doc_id"] for r in out}
    assert 0 in ids and 304 in ids and not ids & {300, 301, 302, 303, *range(100, 130)} and len(rows()) > len(ids)


def test_pipeline_with_clashing_columns_and_nothing(spark, tmp_path):
    """Extra columns named like the stages' own pass through every stage but the last; empty tables give no sequences."""
    documents(spark).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this is there, not at all, in any of those")], "item_id long, text string").write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "a" / "documents.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path / "a"))
        assert kept.columns == docs.columns
    out = collected(corpus_pipeline.run(spark, str(tmp_path / "a")))
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in collected(kept)}
    documents(spark, clash=False).limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    assert collected(corpus_pipeline.run(spark, str(tmp_path / "b"))) == []
