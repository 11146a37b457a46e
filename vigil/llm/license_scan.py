"""License scan by sparse TF-IDF cosine to templates and directory inheritance,
in DataFrame operations only.

A file's statements are the licence lines in its text (whole lines with a cue
word) and, where such a line is one of several comment lines, their whole block;
of a file named like a licence (LICENSE, COPYING, ...) also each of its
paragraphs.  Templates are short statements, SPDX tags of every licence, and
paragraphs of the licences' own texts (titles, grants, clauses), each kind with
its own threshold.  Both are vectors of term counts times idf (over the
templates; a term of no template counts as rare), joined term by term, so that
only shared terms meet.  A file takes the licence of its best statement; in a file
named like a licence any match makes it its directory's.

Files without names, as documents are, are known as licence files by how they
begin (``by_text``): one of the first paragraphs is a paragraph of a licence's text.

A file without a licence of its own takes that of the nearest directory above
it that holds a licence file: its ancestor directories are joined to those
directories, and the deepest one wins.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigil.llm.common import ascii_lower, materialize

# Short statements of common licences
STATEMENTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, under the MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
)
# Paragraphs of the licences' own texts, by which a licence file is known
PARAGRAPHS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
     to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
     whom the Software is furnished to do so, subject to the following conditions:"""),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
     provided that the above copyright notice and this permission notice appear in all copies."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
     the following conditions are met:"""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
     the following conditions are met:"""),
    ("BSD-3-Clause", """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
     products derived from this software without specific prior written permission."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD = 0.6
PARAGRAPH_THRESHOLD = 0.75
SPDX_THRESHOLD = 0.98  # a tag names its licence exactly


def templates_of(statements=STATEMENTS, paragraphs=PARAGRAPHS) -> list[tuple[str, str, float, int]]:
    """(licence, text, threshold, kind) - statements (0), tags (1) and paragraphs of licence files (2); every licence has
    its SPDX tag."""
    ids = dict.fromkeys(x for x, _ in (*statements, *paragraphs))
    return ([(x, t, THRESHOLD, 0) for x, t in statements] + [(x, f"SPDX-License-Identifier: {x}", SPDX_THRESHOLD, 1) for x in ids]
            + [(x, t, PARAGRAPH_THRESHOLD, 2) for x, t in paragraphs])


TEMPLATES = tuple(templates_of())
CUE = r"(?i:licen[sc]|copyright|spdx|public domain|released under)"
# Lines that follow one another and begin as comments do
BLOCK = r"(?m)(?:^[\x20\t]*+(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*+(?:\n|\z))++"
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying|notice)[^/]*$"
TERM = r"[a-z0-9]+(?:[.][0-9]+)*"
HEAD = 3  # paragraphs by which a text is known as a licence's: title, copyright line, first paragraph
COMMENT = r"\A\s*(?:#|//|/\*|\*|--|;|%|<!--)"
PARAGRAPH = r"\n(?:[\x20\t\r]*\n)+"  # blank lines between them


def terms(text: Column) -> Column:
    """Terms of a statement: words and version numbers, A-Z lowered."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def template_weights(spark: SparkSession, templates=TEMPLATES) -> tuple[DataFrame, float]:
    """(term, template, licence, least, kind, weight, idf), weights of unit length; and the idf of a term of no template."""
    counted = []
    for _, text, _, _ in templates:
        seen: dict[str, int] = {}
        for t in re.findall(TERM, text.lower()):
            seen[t] = seen.get(t, 0) + 1
        counted.append(seen)
    n = len(templates)
    df = {t: sum(t in c for c in counted) for c in counted for t in c}
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows = []
    for k, ((licence, _, least, kind), seen) in enumerate(zip(templates, counted)):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in seen.items()))
        rows += [(t, k, licence, least, kind, c * idf[t] / norm, idf[t]) for t, c in sorted(seen.items())]
    return spark.createDataFrame(rows, "term string, template int, licence string, least double, kind int, weight double, idf double"), math.log(1 + n) + 1


def statements(files: DataFrame, by_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files: rid, id, path; statements: rid, start, whole, head, text) of ``files(id, path, text)``; whole: of a licence
    file; head: with ``by_text``, a paragraph of a file with a cue word, unless it begins with a comment."""
    is_file = F.col("path").rlike(FILE_NAME)
    text = F.coalesce("text", F.lit(""))
    numbered = lambda found, kind: F.transform(found, lambda x, i: F.struct(i.cast("long").alias("i"), F.lit(kind).alias("kind"), x.alias("text")))
    cued = lambda found: F.filter(found, lambda x: x.rlike(CUE))
    lines = numbered(cued(F.split(text, "\n", -1)), 0)
    blocks = numbered(F.filter(cued(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))), lambda x: x.rlike("\n[^\n]")), 1)
    none = F.array().cast("array<struct<i:bigint,kind:int,text:string>>")
    stated = F.when(text.rlike(CUE), F.concat(lines, blocks)).otherwise(none)
    parts = F.when(F.coalesce(is_file, F.lit(False)), numbered(F.split(text, PARAGRAPH, -1), 2)).otherwise(none)
    filled = F.filter(F.split(text, PARAGRAPH, -1), lambda x: x.rlike(r"\S"))
    head = F.when(F.lit(by_text) & text.rlike(CUE) & ~text.rlike(COMMENT), numbered(filled, 3)).otherwise(none)
    scanned = materialize(files.select(F.monotonically_increasing_id().alias("rid"), "id", "path", F.concat(stated, parts, head).alias("stated"),
                                       F.coalesce(is_file, F.lit(False)).alias("whole")), "statements")
    # start tells a file's statements apart: lines, blocks, paragraphs and those of unnamed files in turn
    s = scanned.select("rid", "whole", F.explode("stated").alias("s"))
    return scanned.select("rid", "id", "path"), s.select("rid", (F.col("s.i") * 4 + F.col("s.kind")).alias("start"), "whole", (F.col("s.kind") == 3).alias("head"),
                                                         F.col("s.text").alias("text"))


def match(stated: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(rid, licence, score, whole): the licence of each file's best statement that reaches its template's threshold.

    Paragraphs of licence texts only count in licence files; one of a text's first ``HEAD`` paragraphs makes it such a
    file, where ``statements`` marks them.  Of licences with equal best cosines the one with more of its templates in the file wins: the three clauses of
    one begin with the two of another."""
    weights, rare = template_weights(stated.sparkSession, templates)
    if "head" not in stated.columns:
        stated = stated.withColumn("head", F.lit(False))
    counted = (stated.select("rid", "start", "whole", "head", F.explode(terms(F.col("text"))).alias("term"))
               .groupBy("rid", "start", "whole", "head", "term").agg(F.count(F.lit(1)).alias("tf")))
    idf = F.broadcast(weights.select(F.col("term").alias("i_term"), "idf").distinct())
    known = counted.join(idf, F.col("term") == F.col("i_term"), "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    known = materialize(known.select("rid", "start", "whole", "head", "term", "x"), "licence-terms")
    norm = known.groupBy("rid", "start", "whole").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = (known.join(F.broadcast(weights.select(F.col("term").alias("w_term"), "template", "licence", "least", "kind", "weight")), F.col("term") == F.col("w_term"))
           .groupBy("rid", "start", "whole", "head", "template", "licence", "least", "kind").agg(F.sum(F.col("x") * F.col("weight")).alias("dot")))
    n = norm.select(*[F.col(c).alias(f"n_{c}") for c in ("rid", "start", "whole")], "norm")
    cosine = F.least(F.lit(1.0), F.round(F.col("dot") / F.col("norm"), 9))
    scored = dot.join(n, (F.col("rid") == F.col("n_rid")) & (F.col("start") == F.col("n_start")) & (F.col("whole") == F.col("n_whole")))
    scored = scored.select("rid", "start", "whole", "head", "template", "licence", "least", "kind", cosine.alias("score"))
    scored = scored.where("score >= least and if(kind < 2, not head, whole or head)")  # the lines of marked paragraphs have been matched as lines
    begun = F.max(F.col("head") & (F.col("start") < 4 * HEAD)).over(Window.partitionBy("rid"))  # a file's matches
    scored = scored.withColumn("begun", begun).where("not head or begun").withColumn("whole", F.col("whole") | F.col("begun"))
    by = scored.groupBy("rid", "licence").agg(F.max("score").alias("score"), F.count_distinct("template").alias("n"), F.max("whole").alias("whole"))
    best = by.groupBy("rid").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("n")).alias("n"), "licence")).alias("b"), F.max("whole").alias("whole"))
    return best.select(F.col("rid").alias("m_rid"), F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"), "whole")


def _directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, templates=TEMPLATES, by_text: bool = False) -> DataFrame:
    """(id, path, licence, score, origin, from_dir) of every row of ``files(id, path, text)``.

    origin: ``file`` (a licence file), ``header`` (a line of the text),
    ``inherited`` (from_dir names the directory), or null without a licence.
    Null paths have no directory, null texts no statement; repeated rows stay
    repeated; with ``by_text`` a text that begins as a licence's is a licence file,
    whatever its name; ties go to the higher cosine, then more matching templates, then the first licence by name.
    """
    every, stated = statements(files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")), by_text)
    found = materialize(match(stated, templates), "licences")
    own = every.join(found, F.col("rid") == F.col("m_rid"), "left").select("rid", "id", "path", "licence", "score", F.coalesce("whole", F.lit(False)).alias("whole"))
    own = materialize(own, "own-licences")
    dirs = (own.where("whole and licence is not null and path is not null")
            .groupBy(_directory(F.col("path")).alias("d_dir"))
            .agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
            .select("d_dir", F.col("b.licence").alias("d_licence"), (-F.col("b.s")).alias("d_score")))
    open_ = own.where("licence is null and path is not null")
    parts = F.split(_directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    up = open_.select("rid", F.explode(above).alias("a")).select("rid", "a.depth", "a.dir")
    near = (up.join(dirs, F.col("dir") == F.col("d_dir")).groupBy("rid")
            .agg(F.max(F.struct("depth", "dir", "d_licence", "d_score")).alias("n")).select(F.col("rid").alias("i_rid"), "n.*"))
    out = own.join(near, F.col("rid") == F.col("i_rid"), "left")
    origin = (F.when(F.col("licence").isNotNull() & F.col("whole"), "file").when(F.col("licence").isNotNull(), "header")
              .when(F.col("d_licence").isNotNull(), "inherited"))
    return out.select("id", "path", F.coalesce("licence", "d_licence").alias("licence"), F.coalesce("score", "d_score").alias("score"),
                      origin.alias("origin"), F.when(F.col("licence").isNull(), F.col("dir")).alias("from_dir"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """Documents as files: the path is source/doc_id.  Such names never are a licence file's, so those are known by their texts."""
    path = F.concat_ws("/", F.col("source").cast("string"), F.col("doc_id").cast("string"))
    found = scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text"), by_text=True)
    return found.withColumnRenamed("id", "doc_id")
