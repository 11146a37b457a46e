import numpy as np
import pytest
import xxhash
from llm_edge import collected, documents, empty, rows

from vigil.llm import simhash_golay as g
from vigil.llm.common import connected_components


def brute_fp(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_words_two_bits_apart_share_a_key():
    rng = np.random.default_rng(0)
    fp = rng.integers(-2**63, 2**63 - 1, 3000, dtype=np.int64)
    for bits in (0, 1, 2):
        other = fp.view(np.uint64).copy()
        for i in range(len(fp)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        (r1, k1), (r2, k2) = g.golay_keys(fp), g.golay_keys(other.view(np.int64))
        assert len(set(zip(r1.tolist(), k1.tolist())) & set(zip(r2.tolist(), k2.tolist()))) >= 3000
        assert {r for r, _ in set(zip(r1.tolist(), k1.tolist())) & set(zip(r2.tolist(), k2.tolist()))} == set(range(3000))


def test_golay_cosets_have_one_or_six_leaders():
    leaders, many = g.golay_tables()
    assert sorted(set(many.tolist())) == [1, 6] and (many == 6).sum() == 1771


@pytest.mark.parametrize("group_limit", [g.GROUP_LIMIT, 1])
def test_near_duplicates_match_brute_force(spark, group_limit):
    got = collected(g.digest(g.near_duplicates(documents(spark), group_limit=group_limit)))
    data = rows()
    fp = [brute_fp(t) for _, t, *_ in data]
    comp = brute_components(set(fp), lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for (i, *_), f in zip(data, fp):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted(((i, f"{f:016x}", least.get(comp[f])) for (i, *_), f in zip(data, fp)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == want


def test_big_key_groups_by_balls_equal_pairs(spark):
    rng = np.random.default_rng(1)
    centre = [int(x) for x in rng.integers(0, 2**63, 3)]
    fps = sorted({c ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 6), replace=False)) for c in centre for _ in range(80)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bits in (1, 2):
        edges = g.link_edges(df, bits, group_limit=2).collect()
        assert all(bin(e["a"] ^ e["b"]).count("1") <= bits for e in edges)
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = brute_components(fps, lambda a, b: bin(a ^ b).count("1") <= bits)
        assert {f: got.get(f, f) for f in fps} == want


def test_keep_one(spark):
    docs = documents(spark)
    got = collected(g.keep_one(docs))
    assert set(got[0]) == set(docs.columns)
    found = collected(g.near_duplicates(docs))
    assert len(got) == len({r["root"] for r in found})
    ids = [r["doc_id"] for r in got]
    assert ids.count(100) == 0 and ids.count(0) == 1
    assert g.keep_one(empty(spark)).count() == 0


def test_empty(spark):
    assert g.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500)], "a long, b long")
    got = connected_components(e).collect()
    assert len(got) == 201 and {r["component"] for r in got} == {0}
