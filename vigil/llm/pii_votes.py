"""Personal data by weak supervision, in DataFrame operations only.

Base findings (e-mail, IP address, payment card, phone number) pass fixed
checks and stay as they are.  Further candidates (names after titles, numbers,
account numbers, street addresses) are put to labelers that vote yes, no or not
at all: shapes and check digits, gazetteers, words of the context, neighbours.

Expectation-maximisation over the counts of vote patterns estimates how often
each labeler is right, given the hidden answer; base findings take part as
candidates that the check labeler vouches for.  The answers' probabilities then
train a logistic span classifier on the votes, the kind and the size, whose
weights are applied as one column expression.  The driver only sees pattern
counts, at most kinds x 3^labelers x sizes rows, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.llm import spans as S
from vigil.llm.common import materialize

# Titles, street words, first names and context words of the labelers
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
STREETS = ("Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "Straße", "Weg", "Platz", "Allee")
FIRST_NAMES = ("James", "Mary", "John", "Anna", "Peter", "Laura", "Thomas", "Maria", "Michael", "Sarah", "David", "Julia",
               "Hans", "Klaus", "Sabine", "Jean", "Pierre", "Marie", "Claire", "José", "Carmen", "Juan", "Lucía")
CUES = ("phone", "tel", "call", "mobile", "fax", "contact", "name", "address", "born", "birth", "passport", "ssn", "social security",
        "account", "iban", "card", "mail", "ip", "telefon", "adresse", "geboren", "konto", "téléphone", "né le", "compte",
        "teléfono", "dirección", "nacido", "cuenta")
DENIALS = ("invoice", "order", "version", "isbn", "issn", "page", "figure", "table", "total", "price", "sku", "build", "no.", "nr.",
           "ref", "rechnung", "seite", "facture", "factura", "página")

KINDS = [
    S.Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    S.Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    S.Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    S.Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    S.Kind("name", rf"(?<!\p{{L}})(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}[\p{{L}}'-]{{1,30}}+(?:\x20\p{{Lu}}[\p{{L}}'-]{{1,30}}+)?",
           rf"(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}"),
    S.Kind("number", r"(?<![0-9A-Za-z+.(-])[0-9(][0-9\x20().-]{5,22}[0-9](?![0-9A-Za-z])", r"[0-9(][0-9\x20().-]{5}"),
    S.Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    S.Kind("street", rf"(?<![0-9A-Za-z])[0-9]{{1,5}}\x20\p{{Lu}}\p{{L}}{{2,30}}\x20(?:{'|'.join(STREETS)})(?!\p{{L}})", rf"{'|'.join(STREETS)}"),
]
BASE = 4
LABELERS = ("check", "shape", "digits", "gazetteer", "cue", "denial", "edge", "verify")
SURE = math.log(50.0)  # log odds of a base finding's validation; the other labelers' reliabilities are estimated
THRESHOLD = 0.8
EM_ROUNDS, FIT_ROUNDS = 50, 300


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    value = lambda x: F.when(x["i"] % 2 == 0, x["d"]).when(x["d"] < 5, 2 * x["d"]).otherwise(2 * x["d"] - 9)
    return F.aggregate(F.filter(each, lambda x: x["d"].isNotNull()), F.lit(0), lambda a, x: a + value(x)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (letters and digits, no blanks) passes the remainder check of IBANs."""
    turned = F.split(F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a)
    return F.aggregate(turned, F.lit(0), step) == 1


def clear_of_base(p: DataFrame) -> DataFrame:
    """``p`` without weak candidates that overlap a base finding of their text: those are reported already.  One
    sorted pass each way over a text's matches."""
    base = F.col("number") < BASE
    so_far = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = Window.partitionBy("rid").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumns({"reached": F.max(F.when(base, F.col("end"))).over(so_far), "next": F.min(F.when(base, F.col("start"))).over(to_come)})
    meets = F.coalesce(F.col("reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return p.where(base | ~meets).drop("reached", "next")


def candidates(scanned: DataFrame) -> DataFrame:
    """Valid base findings and the weak candidates clear of them, with each labeler's vote (1, -1 or 0) and the size
    class.  Per kind several labelers look at different things: the form, a checksum, word lists, the words before,
    what stands next to the span."""
    p = S.positions(scanned).withColumn("number", F.col("kind"))
    p = p.withColumn("kind", F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("number") + 1))
    p = p.withColumn("digits", F.regexp_replace("hit", "[^0-9]", ""))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    kind, n, hit = F.col("kind"), F.length("digits"), F.col("hit")
    p = p.where((kind != "ip") | hit.rlike(rf"^{part}(?:\.{part}){{3}}$"))
    p = p.where((kind != "card") | luhn(F.col("digits")))
    p = p.where((kind != "phone") | n.between(9, 15))
    p = clear_of_base(p)
    before, after = F.lower("before"), F.lower("after")
    some = lambda words: rf"(?:^|[^\p{{L}}])(?:{'|'.join(w.replace('.', '[.]') for w in words)})(?:[^\p{{L}}]|$)"
    yes = lambda c: F.when(c, 1)
    phone, social, date = r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", r"^[0-9]{1,4}[.-][0-9]{1,2}[.-][0-9]{1,4}$"
    votes = {
        "check": yes(F.col("number") < BASE),
        "shape": yes(((kind == "number") & (hit.rlike(phone) | hit.rlike(social))) | kind.isin("iban", "street", "name")
                     | ((kind == "email") & hit.rlike(r"\.[A-Za-z]{2,10}$")) | ((kind == "ip") & ~hit.rlike(r"(^|\.)0[0-9]"))
                     | ((kind == "card") & hit.rlike("^[3-6]")) | ((kind == "phone") & hit.rlike(r"^\+[1-9][0-9]{0,2}[ (.-]")))
                 .when((kind == "number") & hit.rlike(date), -1),
        "digits": F.when((kind == "number") & hit.rlike("^[0-9]+$"), -1).when((kind == "number") & ~n.between(7, 15), -1),
        "gazetteer": yes(hit.rlike(some(FIRST_NAMES + STREETS)) | F.col("after").rlike(some(STREETS))),
        "cue": yes(before.rlike(some(CUES))),
        "denial": F.when(before.rlike(some(DENIALS)), -1),
        "edge": F.when(F.right("before", F.lit(2)).rlike(r"[|$€£%#=/]\s?$") | after.rlike(r"^\s?[|%€]"), -1),
        "verify": F.when(kind == "iban", F.when(mod97(F.regexp_replace("hit", "[^A-Z0-9]", "")), 1).otherwise(-1))
                   .when((kind == "number") & hit.rlike(social), F.when(hit.rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1))
                   .when((kind == "number") & hit.rlike(phone), F.when(F.col("digits").rlike("^[2-9][0-9]{2}[2-9]|555"), 1).otherwise(-1))
                   .when(kind == "number", -1),  # of no form that could be verified
    }
    size = F.least(F.floor(F.length("hit") / 8), F.lit(3)).cast("int")
    return p.select("rid", "number", "kind", "start", "end", *[F.coalesce(v, F.lit(0)).alias(f"v_{k}") for k, v in votes.items()], size.alias("size"))


def patterns(found: DataFrame) -> list[tuple[tuple, int]]:
    """[((kind number, size, votes...), count)]."""
    cols = ["number", "size", *[f"v_{k}" for k in LABELERS]]
    return [(tuple(r[c] for c in cols), r["n"]) for r in found.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(*cols).collect()]


def em(seen: list[tuple[tuple, int]], rounds: int = EM_ROUNDS) -> list[float]:
    """The probability that the answer is yes, per pattern; starts from the votes' majority."""
    if not seen:
        return []
    post = []
    for key, _ in seen:
        s = sum(key[2:])
        post.append(1 / (1 + math.exp(-2 * s)) if s else 0.3)
    for _ in range(rounds):
        total = [sum(n * (p if z else 1 - p) for (_, n), p in zip(seen, post)) for z in (0, 1)]
        prior = (total[1] + 1) / (total[0] + total[1] + 2)
        rate = []
        for j in range(len(LABELERS)):
            table = {}
            for z in (0, 1):
                count = {-1: 1.0, 0: 1.0, 1: 1.0}
                # a vote is evidence for what it says: pseudo-counts keep labelers better than chance
                count[1 if z else -1] += 2.0
                for (key, n), p in zip(seen, post):
                    count[key[2 + j]] += n * (p if z else 1 - p)
                whole = sum(count.values())
                table[z] = {v: c / whole for v, c in count.items()}
            rate.append(table)
        new = []
        for key, _ in seen:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(key[2:]):
                if v:  # a labeler that doesn't vote says nothing
                    odds += SURE if j == 0 else math.log(rate[j][1][v] / rate[j][0][v])
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        moved, post = max(abs(a - b) for a, b in zip(new, post)), new
        if moved < 1e-9:
            break
    return post


def _inputs(key: tuple) -> list[float]:
    number, size, *votes = key
    return [1.0, *[float(v) for v in votes[1:]], *[float(number == k) for k in range(BASE, len(KINDS))], *[float(size == s) for s in (1, 2, 3)]]


def train(seen: list[tuple[tuple, int]], answers: list[float], rounds: int = FIT_ROUNDS) -> list[float]:
    """Logistic weights over the votes (but the base check), the kind and the size; weak candidates weigh by their counts' logarithm."""
    rows = [(_inputs(key), a, math.log1p(n)) for (key, n), a in zip(seen, answers)]
    if not rows:
        return []
    w = [0.0] * len(rows[0][0])
    whole = sum(r[2] for r in rows)
    for _ in range(rounds):
        grad = [1e-3 * x for x in w]
        for x, a, n in rows:
            z = max(-30.0, min(30.0, sum(p * q for p, q in zip(w, x))))
            g = (1 / (1 + math.exp(-z)) - a) * n / whole
            for k, v in enumerate(x):
                if v:
                    grad[k] += g * v
        w = [p - 2.0 * g for p, g in zip(w, grad)]
    return w


def probability(w: list[float]) -> Column:
    """The classifier as a column."""
    if not w:
        return F.lit(0.0)
    terms = [F.lit(1.0), *[F.col(f"v_{k}").cast("double") for k in LABELERS[1:]],
             *[(F.col("number") == k).cast("double") for k in range(BASE, len(KINDS))],
             *[(F.col("size") == s).cast("double") for s in (1, 2, 3)]]
    z = None
    for p, t in zip(w, terms):
        z = t * F.lit(p) if z is None else z + t * F.lit(p)
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rid, doc_id, base, added) for every row of ``docs(doc_id, text, ...)``:
    arrays of (number, start, kind, end) sorted by kind, then start; added ones
    reach ``threshold`` and overlap no base finding.

    Null and empty texts have none; repeated rows stay repeated; an empty table
    gives no rows; other columns are not read.
    """
    scanned = S.scan(docs, KINDS)
    found = materialize(candidates(scanned), "candidates")
    seen = patterns(found)
    w = train(seen, em(seen))
    take = found.where((F.col("number") < BASE) | (probability(w) >= threshold))
    per = take.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("number", "start", "kind", "end"))).alias("all"))
    per = per.select(F.col("rid").alias("p_rid"), F.filter("all", lambda s: s["number"] < BASE).alias("base"),
                     F.filter("all", lambda s: s["number"] >= BASE).alias("added"))
    return (scanned.select("rid", "doc_id").join(per, F.col("rid") == F.col("p_rid"), "left")
            .select("rid", "doc_id", *[F.coalesce(c, F.array().cast(per.schema[c].dataType)).alias(c) for c in ("base", "added")]))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"),
                        S.joined(F.concat("base", "added")).alias("spans"))
