"""Alignment against a brute force over whole texts and byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_edge import collected, documents, empty, rows

from vigil.llm import token_align as T


def brute(texts, paths):
    """Rows in the order of ``texts``: whole-text encodings, all pairs of overlapping ranges by a two-pointer walk."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(paths[0])
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=paths[2])
    chars = {c: x for x, c in T._byte_chars().items()}
    links, out = [], []
    for text in texts:
        if not text:
            links.append([])
            out.append([0, 0, 0, 0, ""])
            continue
        a = tok.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(chars[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b = [(i, bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace("▁", " ").encode()) for i in sp.encode(text) for t in [sp.id_to_piece(i)]]
        raw = (" " + text).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            links.append([])
            out.append([0, 0, 0, 0, ""])
            continue
        ends = lambda side: list(np.cumsum([len(x) for _, x in side]))
        ea, eb = ends(a), ends(b)
        both = sorted(set(ea) & set(eb))
        found, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            found.append((a[i][0], b[j][0]))
            x, y = ea[i], eb[j]
            i, j = i + (x <= y), j + (y <= x)
        groups, i, j = [], 0, 0
        for e in both:
            i2, j2 = i, j
            while i2 < len(a) and ea[i2] <= e:
                i2 += 1
            while j2 < len(b) and eb[j2] <= e:
                j2 += 1
            groups.append(",".join(str(x[0]) for x in a[i:i2]) + "|" + ",".join(str(x[0]) for x in b[j:j2]))
            i, j = i2, j2
        links.append(found)
        out.append([len(a), len(b), len(both), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    docs = Counter(p for f in links for p in set(f))
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    return [tuple(o) + (sum(docs[p] == top[p[0]] for p in f), sum(docs[p] for p in f)) for o, f in zip(out, links)], docs


def key(r):
    return (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["n_best"], r["count_sum"])


def special():
    return [(400, "a <|endoftext|> b</s><s> <0x41>▁x", None, None, None), (401, "▁", None, None, None), (402, "tab\tnul\x00 　 \x1c x", None, None, None),
            (403, " lead", None, None, None), (404, "trail  ", None, None, None), (405, "日本語のテキスト 😀😀 ﬁ é", None, None, None)]


@pytest.mark.parametrize("steps,deal,frequent", [(1 << 15, 1 << 16, 1 << 18), (7, 50, 1 << 18), (64, 200, 100), (3, 0, 0)])
def test_whole_results(spark, steps, deal, frequent):
    """However the merge is cut, dealt and looked up, rows and pair counts are those of the brute force."""
    data = [r for r in rows() if len(r[1] or "") < 40_000] + special()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got, pairs = T.align(df, steps=steps, deal=deal, frequent=frequent)
    want, docs = brute([r[1] for r in data], T.tokenizer_paths())
    assert sorted((str(r["doc_id"]), key(r)) for r in collected(got)) == sorted((str(r[0]), w) for r, w in zip(data, want))
    assert {(r["a_id"], r["b_id"]): r["docs"] for r in collected(pairs)} == dict(docs)


def test_merge_path_cuts_equal_work():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(0, 40))) for _ in range(2))
        d = np.arange(len(a) + len(b) + 1)
        i, j = T.merge_path(a, b, d)
        order = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        assert [(sum(s == 0 for _, s in order[:k]), sum(s == 1 for _, s in order[:k])) for k in d] == list(zip(i, j))


def test_edges(spark):
    """Clashing columns are not read; an empty table has no rows; null and empty texts have zeros."""
    got = collected(T.digest(documents(spark)))
    assert len(got) == len(rows()) and set(got[0]) == {"doc_id", *T.DIGEST}
    for r in got:
        if r["doc_id"] in (300, 301):
            assert key(r) == (0, 0, 0, 0, "", 0, 0)
    assert collected(T.digest(empty(spark))) == []


def test_pairs_round_trip():
    for p, n in (([], []), ([0, 5, 9], [1, 2, 70_000]), ([1 << 40, 1 << 41], [3, 4])):
        x, y = T.unpack_pairs(T.pack_pairs(np.array(p, np.int64), np.array(n, np.int64)))
        assert x.tolist() == p and y.tolist() == n
