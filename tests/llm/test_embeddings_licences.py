import os
import re

import numpy as np
import pytest
from llm_edge import collected, documents, empty, rows
from pyspark.sql import functions as F

from vigil.llm import embedding_tiles as e
from vigil.llm import license_scan as lic

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(n // 3):  # a chain of near copies and a group of exact ones
        x[i] = x[0] + rng.normal(size=d) * 0.25 if i % 2 else x[0]
    return [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]


def brute(data, threshold):
    good = {i: np.array(v, float) for i, v, _ in data if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None}
    links = {i: set() for i in good}
    for i in good:
        for j in good:
            if i != j and len(good[i]) == len(good[j]):
                a, b = good[i], good[j]
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i].add(j)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    return sorted((i, len(links.get(i, ())), comp.get(i, i), comp.get(i, i) == i) for i, _, _ in data)


@pytest.mark.parametrize("threshold,block", [(0.9, 2048), (0.9, 17), (0.5, 40)])
def test_embeddings_match_brute_force(spark, threshold, block):
    data = vectors() + [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [1.0, None] * 8, None),
                        (905, [float("inf")] * 16, 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (908, [1e-30] * 16, 1), (909, [1e30] * 16, 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in collected(e.near_duplicates(df, threshold, block, sample=100)))
    assert got == brute(data, threshold)


def test_embeddings_edges(spark):
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(5, [1.0, 0.0], 1)], SCHEMA)
    assert [(r["vec_id"], r["n_links"], r["kept"]) for r in collected(e.near_duplicates(one))] == [(5, 0, True)]
    with pytest.raises(ValueError):
        e.near_duplicates(one, 0.0)


def brute_licences(files):
    terms = lambda t: re.findall(lic.TERM, t.lower())
    temps = [terms(t) for _, t, _, _ in lic.TEMPLATES]
    df = {t: sum(t in x for x in temps) for x in temps for t in x}
    idf = lambda t: np.log((1 + len(temps)) / (1 + df.get(t, 0))) + 1

    def cosine(a, b):
        va, vb = ({t: x.count(t) * idf(t) for t in x} for x in (a, b))
        norm = np.sqrt(sum(v * v for v in va.values()) * sum(v * v for v in vb.values()))
        return round(sum(v * vb.get(t, 0) for t, v in va.items()) / norm, 9) if norm else 0

    own = []
    for i, path, text in files:
        text = text or ""
        is_file = bool(path and re.search(lic.FILE_NAME, path))
        stated = [x for x in text.split("\n") if re.search(r"licen[sc]|copyright|spdx|public domain|released under", x, re.I)]
        stated += re.split(r"\n(?:[ \t\r]*\n)+", text) if is_file else []
        best, used = {}, {}
        for k, ((name, _, least, kind), t) in enumerate(zip(lic.TEMPLATES, temps)):
            score = max((cosine(terms(x), t) for x in stated), default=0)
            if score >= least and (kind < 2 or is_file):
                best[name] = max(score, best.get(name, 0))
                used.setdefault(name, set()).add(k)
        names = sorted(best, key=lambda n: (-best[n], -len(used[n]), n))
        own.append((i, path, names[0] if names else None, is_file))
    up = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    dirs = {up(p): n for _, p, n, f in own if f and n and p}
    out = []
    for i, p, n, f in own:
        origin = ("file" if f else "header") if n else None
        at = up(p) if p else None
        while n is None and at is not None:
            if at in dirs:
                n, origin = dirs[at], "inherited"
            at = up(at) if at else None
        out.append((i, n, origin))
    return out


def test_licences_match_brute_force(spark):
    files = [(1, "a/b/c.py", "x"), (2, "a/LICENSE", "Released under the MIT License."), (3, "a/b/d/e.py", ""), (4, "z.py", "# Licensed under the Apache License, Version 2.0."),
             (5, None, None), (6, "q/r.py", "nothing of a license here, but long text without any template in it"),
             (7, "a/b/d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (8, "a/b/d/x/y/z.c", "text"),
             (12, "s/a.c", "// SPDX-License-Identifier: GPL-3.0"), (13, "s/b.c", "// SPDX-License-Identifier: Zlib"), (14, "m/LICENSE", MIT),
             (15, "m/src/x.c", "int x;"), (16, "n/LICENSE.md", BSD3), (17, "n/x.c", ""), (18, "m/src/old/COPYING", "GNU GENERAL PUBLIC LICENSE"),
             (9, "ab/c.py", "t"), (10, "q/n.txt", "first line\nLicensed under CC BY-NC 4.0.\nlast line"), (11, "a/b/d/n.c", "Released under the MIT License.")]
    got = collected(lic.scan(spark.createDataFrame(files, "id long, path string, text string")))
    assert sorted((r["id"], r["licence"], r["origin"]) for r in got) == sorted(brute_licences(files))
    assert {r["id"]: r["from_dir"] for r in got}[8] == "a/b/d" and {r["id"]: r["from_dir"] for r in got}[11] is None


def test_statements_are_whole_lines_and_comment_blocks(spark):
    stated = [(name, t) for name, t, _, kind in lic.TEMPLATES if kind < 2]
    by_line = [(i, "a.py", t) for i, (_, t) in enumerate(stated)]
    wrapped = "x = 1\n# Licensed under the Apache License,\n# Version 2.0; you may not use this file\n# except in compliance with the License\ny = 2"
    files = by_line + [(100, "b.py", wrapped), (101, "c.py", "x = 1\n" + "# long\n" * 50_000 + "y"), (102, "d.py", "; a\r\n; Licensed under CC BY 4.0.")]
    got = {r["id"]: r for r in collected(lic.scan(spark.createDataFrame(files, "id long, path string, text string")))}
    assert [(got[i]["licence"], got[i]["score"]) for i, _, _ in by_line] == [(name, 1.0) for name, _ in stated]
    assert (got[100]["licence"], got[100]["score"], got[101]["licence"]) == ("Apache-2.0", 1.0, None) and got[102]["licence"] == "CC-BY-4.0"


def test_licence_edges(spark):
    assert len(collected(lic.scan_documents(documents(spark)))) == len(rows())
    assert lic.scan_documents(empty(spark)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD2 = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
SYSTEM = "/usr/share/common-licenses"
REAL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


def test_real_licence_texts(spark):
    """Whole licence files are named right and serve what lies below them; tags name their licence exactly."""
    texts = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3}
    for name, licence in REAL.items():
        if os.path.exists(f"{SYSTEM}/{name}"):
            with open(f"{SYSTEM}/{name}", encoding="utf-8") as f:
                texts[licence] = f.read()
    files = [(f"{n}/{p}", f"{n}/{p}", t if p == "LICENSE" else "int x;") for n, t in texts.items() for p in ("LICENSE", "src/deep/x.c")]
    files += [(f"tag {n}", "t/x.c", f"/* SPDX-License-Identifier: {n} */") for n in dict.fromkeys(x for x, *_ in lic.TEMPLATES)]
    files += [("tag Zlib", "t/y.c", "// SPDX-License-Identifier: Zlib")]
    got = {r["id"]: (r["licence"], r["origin"]) for r in collected(lic.scan(spark.createDataFrame(files, "id string, path string, text string")))}
    for n in texts:
        assert got[f"{n}/LICENSE"] == (n, "file") and got[f"{n}/src/deep/x.c"] == (n, "inherited")
    for i, (licence, _) in got.items():
        if i.startswith("tag "):
            assert licence == (i[4:] if i != "tag Zlib" else None)


def test_documents_inherit_from_licence_texts_of_their_source(spark):
    """Documents have no file names: those that begin as a licence's text does are their source's licence files."""
    prose = "Somebody wrote this.\n\nIt says nothing of rights."
    late = "One.\n\nTwo.\n\nThree.\n\n" + MIT  # quotes a licence further on
    docs = [(0, "a", MIT), (1, "a", prose), (2, "b", BSD3), (3, "b", prose), (4, "c", late), (5, "c", prose),
            (6, "d", "# " + MIT.replace("\n", "\n# ")), (7, "d", prose), (8, None, prose), (9, "b", None),
            (10, "a", "Released under CC BY 4.0.\nLicensed under CC BY 4.0.")]
    got = {r["doc_id"]: (r["licence"], r["origin"], r["from_dir"]) for r in
           collected(lic.scan_documents(spark.createDataFrame(docs, "doc_id long, source string, text string")))}
    assert got[0] == ("MIT", "file", None) and got[1] == ("MIT", "inherited", "a")
    assert got[2] == ("BSD-3-Clause", "file", None) and got[3] == got[9] == ("BSD-3-Clause", "inherited", "b")
    assert got[4][1] == "header" and got[5] == (None, None, None)  # by a line
    assert got[6][1] != "file" and got[7] == got[8] == (None, None, None)
    assert got[10][:2] == ("CC-BY-4.0", "header")


def test_embeddings_with_repeated_and_null_ids_and_clashing_columns(spark):
    """A repeated id's rows share their result; a null id links with nothing; other columns are not read."""
    data = [(1, [1.0, 0.0]), (1, [0.999, 0.01]), (2, [0.0, 1.0]), (None, [0.0, 1.0]), (3, [0.01, 0.999]), (None, None), (4, [float("nan"), 1.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit("x") for c in ("block", "dim", "home", "n", "node", "v")})
        got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in collected(e.near_duplicates(df))), key=str)
        assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True), (None, 0, None, True), (None, 0, None, True)], key=str)
