"""Small tables with nulls, empty and long texts, repeated rows and clashing extra columns."""

import random

from pyspark.sql import functions as F

EXTRA = ("start", "end", "kind", "fp", "root", "component_id", "score", "spans", "items", "pos", "word", "rid", "rank", "salt", "key")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rnd = random.Random(3)
    syll = ["the", "on", "er", "ti", "ba", "lo", "mu", "re", "und", "der", "ch", "que", "la", "eau"]
    word = lambda: "".join(rnd.choice(syll) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    base = [text(rnd.randint(3, 90)) for _ in range(40)]
    out = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t)) for i, t in enumerate(base)]
    out += [(100 + i, base[0], "en", "src0", 1) for i in range(30)]  # a group of copies
    out += [(200 + i, base[1].replace(".", f" {word()}."), None, None, None) for i in range(10)]
    out += [(300, None, "en", "src0", None), (301, "", "en", None, 0), (302, " \n\t ", None, "src1", 4), (303, "12 34 !!", None, "src1", 8),
            (304, text(12_000), "de", "src0", 9), (305, "x" * 30_000, "en", "src0", None), (306, "é ß 日本 😀 <|endoftext|>  two  blanks\r\nline", "de", "", 3),
            (7, base[7], "en", "src1", len(base[7])), (7, base[7], "en", "src1", len(base[7])), (7, base[8], "en", "src1", 5),
            (None, base[9], "en", "src2", 5), (None, None, None, None, None)]
    return out


def documents(spark, clash=True):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("clash") for c in EXTRA}) if clash else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]
