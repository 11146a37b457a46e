"""Pattern matches with code-point positions, in DataFrame operations only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.llm.common import materialize

CONTEXT = 48  # code points kept on either side of a match


class Kind(NamedTuple):
    name: str
    pattern: str  # of positive width; possessive groups, so that long matches need no stack
    needs: str  # a cheap pattern that every text with a match contains


def _matches(n: int) -> Column:
    """Structs of kind n's matches, from its columns of hits and of gaps between them."""
    gaps = F.col(f"g{n}")
    return F.transform(F.col(f"h{n}"), lambda h, i: F.struct(
        F.lit(n).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).cast("long").alias("gap"), h.alias("hit"),
        F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")))


def scan(docs: DataFrame, kinds: list[Kind]) -> DataFrame:
    """(rid, doc_id, found), one row per row of ``docs(doc_id, text)``; written to
    the shared folder, so rid stays what it is.  A match's gap is its distance
    from the end of the match of its kind before."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text"))
    none = F.array().cast("array<string>")
    for n, k in enumerate(kinds):  # columns of their own: within a lambda they would be made anew for every match
        needed = F.col("text").rlike(k.needs)
        rows = rows.withColumns({f"g{n}": F.when(needed, F.split("text", k.pattern, -1)).otherwise(none),
                                 f"h{n}": F.when(needed, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none)})
    found = [_matches(n) for n in range(len(kinds))]
    return materialize(rows.select("rid", "doc_id", F.concat(*found).alias("found")), "matches")


def positions(scanned: DataFrame) -> DataFrame:
    """(rid, kind, start, end, hit, before, after) of all matches; code points, end exclusive."""
    m = scanned.select("rid", F.explode("found").alias("m")).select("rid", "m.*")
    so_far = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(so_far)
    return m.withColumn("end", end).select(
        "rid", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "before", "after")


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs with these fields, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def cut(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with the spans (sorted array of structs with start, end) replaced by ``mark``; overlapping ones as one."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("out"))
    walked = F.aggregate(spans, zero, lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        F.when(s["start"] >= a["end"], F.concat(
            a["out"], F.substring(text, (a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int")), F.lit(mark)))
        .otherwise(a["out"]).alias("out")))
    return F.concat(walked["out"], F.substring(text, (walked["end"] + 1).cast("int"), F.length(text)))
