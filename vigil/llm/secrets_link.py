"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong findings (assignments, access identifiers, long hex strings) are
reported by themselves.  Weak parts are reported only with their complements:

* a weak secret (a mixed-case token with digits, a value assigned to a word such
  as ``auth`` or ``key`` that is no plain word, or a URL's password) needs an identifier or an endpoint in its scope;
* a weak identifier (``user=``, ``client_id:``, ..., or a URL's user) needs a secret, weak or strong;
* an endpoint (URL with a scheme of services, ``host:port``) needs both.

Scopes are intervals of ``scope`` code points around a part, from start to start.
The parts of a text are walked once in either direction, with the nearest part of
each role so far that doesn't overlap the one at hand: one string is not its own
complement, as a token within a URL would be.  That nearest part decides exactly
whether some part of its role is in reach, however many parts a text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.llm import spans as S
from vigil.llm.common import broadcast_if_small, materialize

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# user:password@ of a URL are parts of their own; what follows them is the endpoint
USERINFO = r"""[^\s/:@"'<>]++:[^\s/@"'<>]++@"""
URL = (r"""(?<![A-Za-z0-9])(?:https?|s3|ftp|jdbc|postgres|postgresql|mysql|redis|amqp|mongodb)://(?!""" + USERINFO + r""")[^\s"'<>]{3,}+"""
       r"""|(?<=@)(?<=://[^\s/:@"'<>]{1,500}:[^\s/@"'<>]{1,500}@)[A-Za-z0-9-][^\s"'<>]*+""")
# A chain of labels is tried from its first one, or from behind the port of a match before: the rest ends alike, so long chains cost linear time
HOST = (r"(?<![A-Za-z0-9])(?:(?<![A-Za-z0-9-]\.)(?<!-)|(?<=:[0-9]{2,5}[.-]{1,9}))"
        r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}(?![0-9])")
KINDS = [
    S.Kind("assign", ASSIGN, r"[:=]"),
    S.Kind("access", r"AKIA[A-Z0-9]{16,}+", r"AKIA"),
    S.Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", r"[0-9a-f]{24}"),
    S.Kind("weak_token", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])", r"[A-Za-z0-9+/_-]{20}"),
    S.Kind("weak_value", r"""(?<![A-Za-z0-9])(?i:auth|key|pwd|pass|credential)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]{6,}+""", r"[:=]"),
    S.Kind("weak_id", r"""(?<![A-Za-z0-9])(?i:user|username|login|account|client_?id|access_?key_?id|tenant_?id)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@_.-]{3,}+""", r"[:=]"),
    S.Kind("endpoint", URL + "|" + HOST, r":"),
    S.Kind("url_user", r"""(?<=://)[^\s/:@"'<>]++(?=:[^\s/@"'<>]++@)""", r"://"),
    S.Kind("url_password", r"""(?<=:)(?<=://[^\s/:@"'<>]{1,500}:)[^\s/@"'<>]++(?=@)""", r"://"),
]
WEAK_VALUE = r"""[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""

BASE = 3  # of the kinds above are the base
SCOPE = 256
TAIL = 200  # of a longer part, what follows is in reach of its last so many code points
ROLES = {"secret": ("assign", "hex", "weak_token", "weak_value", "url_password"), "id": ("access", "weak_id", "url_user"), "endpoint": ("endpoint",)}


def _keylike(value: Column) -> Column:
    """Not a word of prose: letters with digits or in both cases within the word, or signs that words lack."""
    return (value.rlike("[A-Za-z]") & value.rlike("[0-9]")) | value.rlike("[a-z][A-Z]") | value.rlike("[+/=]") | value.rlike("^[0-9]{6,}$")


def parts(scanned: DataFrame) -> DataFrame:
    """Valid parts: (rid, kind, start, end, role).  Weak ones that overlap a strong one of the same text are none."""
    p = S.positions(scanned)
    kind = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1)
    p = p.withColumn("number", F.col("kind")).withColumn("kind", kind)
    mixed = F.col("hit").rlike("[A-Z]") & F.col("hit").rlike("[a-z]") & F.col("hit").rlike("[0-9]")
    p = p.where(((F.col("kind") != "assign") | (F.length(F.regexp_extract("hit", ASSIGN_VALUE, 1)) >= 6))
                & ((F.col("kind") != "weak_token") | mixed) & ((F.col("kind") != "weak_value") | _keylike(F.regexp_extract("hit", WEAK_VALUE, 1))))
    role = F.coalesce(*[F.when(F.col("kind").isin(*ks), F.lit(r)) for r, ks in ROLES.items()])
    return p.select("rid", "number", "kind", "start", "end", role.alias("role"))


def _seen(p: DataFrame, ahead: bool, **columns: tuple[Column, str]) -> DataFrame:
    """``p`` with, per (value, role), the nearest value among the parts of that role
    that end up to its start, or (``ahead``) begin from its end on: the greatest
    before, the least ahead.  Parts that overlap it are never among them."""
    gives, asks = ("start", "end") if ahead else ("end", "start")
    marks = F.array(F.struct(F.col(gives).alias("at"), F.lit(0).alias("ask")), F.struct(F.col(asks).alias("at"), F.lit(1).alias("ask")))
    e = p.withColumn("m", F.explode(marks)).select(*p.columns, "m.*")
    so_far = Window.partitionBy("rid").orderBy(F.desc("at") if ahead else F.asc("at"), "ask").rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.min if ahead else F.max
    e = e.withColumns({n: nearest(F.when((F.col("ask") == 0) & F.col("role").isin(*[r] if r else list(ROLES)), v)).over(so_far)
                       for n, (v, r) in columns.items()})
    return e.where("ask = 1").drop("at", "ask")


def link(p: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, number, kind, start, end, roles): weak parts with the complementary roles in reach.

    A part never vouches for one that it overlaps, and the two that vouch for an
    endpoint don't overlap either.
    """
    p = p.withColumn("tail", F.greatest("start", F.col("end") - TAIL))
    p = _seen(p, False, **{f"before_{r}": (F.col("tail"), r) for r in ROLES})
    p = _seen(p, True, **{f"after_{r}": (F.col("start"), r) for r in ROLES})
    # Pairs of a secret and an identifier, filed under the one that is nearer to those who ask
    other = lambda side: F.when(F.col("role") == "secret", F.col(f"{side}_id")).when(F.col("role") == "id", F.col(f"{side}_secret"))
    p = _seen(p, False, before_pair=(other("before"), None))
    p = _seen(p, True, after_pair=(other("after"), None))
    behind = lambda x: F.coalesce(F.col(f"before_{x}") >= F.col("start") - scope, F.lit(False))
    ahead = lambda x: F.coalesce(F.col(f"after_{x}") <= F.col("tail") + scope, F.lit(False))
    has = lambda r: behind(r) | ahead(r)
    both = has("pair") | (behind("id") & ahead("secret")) | (behind("secret") & ahead("id"))
    enough = F.when(F.col("role") == "secret", has("id") | has("endpoint")).when(F.col("role") == "id", has("secret")).otherwise(both)
    roles = F.array_compact(F.array(*[F.when(has(r) & (F.col("role") != r), F.lit(r)) for r in ROLES]))
    return p.where((F.col("number") >= BASE) & enough).select("rid", "number", "kind", "start", "end", roles.alias("roles"))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, doc_id, base, added) for every row of ``docs(doc_id, text, ...)``:
    arrays of (start, number, kind, end) sorted by start, then kind; ``added``
    also has the roles that vouch for each part.  An added part that overlaps a
    base span is left out: it is reported already.

    Null and empty texts have none; repeated rows stay repeated; an empty table
    gives no rows; other columns are not read.
    """
    scanned = S.scan(docs, KINDS)
    p = materialize(parts(scanned), "parts")
    base = p.where(F.col("number") < BASE).withColumn("roles", F.array().cast("array<string>"))
    every = base.select("rid", "number", "kind", "start", "end", "roles").unionByName(link(p, scope))
    per = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "number", "kind", "end", "roles"))).alias("all"))
    strong = F.filter("all", lambda s: s["number"] < BASE)
    weak = F.filter("all", lambda s: s["number"] >= BASE)
    per = per.select("rid", strong.alias("base"), weak.alias("added"))
    per = per.withColumn("added", F.filter("added", lambda w: ~F.exists("base", lambda b: _overlaps(w, b))))
    return (scanned.select("rid", "doc_id").join(per.withColumnRenamed("rid", "p_rid"), F.col("rid") == F.col("p_rid"), "left")
                .select("rid", "doc_id", *[F.coalesce(c, F.array().cast(per.schema[c].dataType)).alias(c) for c in ("base", "added")]))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"),
                        F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"),
                        S.joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


MARK = "[secret]"


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = MARK) -> DataFrame:
    """``docs`` with all findings replaced by ``mark``; n_chars, where present,
    follows the text.  Rows without findings stay as they are, all rows and
    columns stay, whatever their names."""
    t = F.col("text").cast("string")
    key = [F.col("doc_id"), F.xxhash64(t), F.length(t)]
    names = ["__k_id", "__k_text", "__k_len"]
    slim = docs.select("text", F.struct(*[k.alias(n) for k, n in zip(key, names)]).alias("doc_id"))
    found = find(slim, scope).select("doc_id.*", F.array_sort(F.concat("base", "added")).alias("__spans"))
    found = materialize(found.where(F.size("__spans") > 0).dropDuplicates(names), "secrets")
    same = None
    for k, n in zip(key, names):
        one = k.eqNullSafe(F.col(n))
        same = one if same is None else same & one
    rows = docs.join(broadcast_if_small(found), same, "left")
    new = {"text": F.when(F.col("__spans").isNull(), F.col("text")).otherwise(S.cut(t, F.col("__spans"), mark))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length(new["text"]).cast(kind))
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
