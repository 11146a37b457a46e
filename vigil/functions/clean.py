"""Cleaning and coercion as pure ``Column -> Column`` functions.

All of them are built-in expressions (codegen, no Python in the hot path).
ANSI mode is on in Spark 4, so every conversion goes through ``try_cast``
behind a strict numeric pattern (Spark alone would accept ``'1d'``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the reference (keyword lists, labels, null words, patterns)
FEMALE_WORDS = ["fem", "menina", "mulher", "garota", "feminino", "f"]
MALE_WORDS = ["masc", "menino", "homem", "garoto", "masculino", "m"]
FEMALE_WORDS_STRICT = ["fem", "menina", "mulher", "garota"]
MALE_WORDS_STRICT = ["masc", "menino", "homem", "garoto"]
GROUP_FEMALE, GROUP_MALE, GROUP_OTHER = "Feminino", "Masculino", "Outro"
NULL_WORDS = ["nan", "nat", "none"]
MISSING_TEXT = "N/A"
EMPTY_CODE = "0"
NUMERIC_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
CODE_WORD_PATTERN = r"\b(ALFA)\b"
CODE_LEVEL_PATTERN = r"\b([0-9]{1,2}[A-Z])\b"
CODE_NUMBER_PATTERN = r"\b([0-9]{1,2})\b"
AGE_MIN, AGE_MAX = 4, 25
YEAR_MIN, YEAR_MAX = 2000, 2026
BASE_YEAR = 2024


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_number(c) -> Column:
    """Coerce to double; text that is not a plain decimal/scientific number,
    NaN and ±inf become null."""
    s = _c(c).cast("string")
    # the pattern admits no NaN/inf spelling, so no NaN check is needed
    return F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))


def clip(c, lo=None, hi=None) -> Column:
    """Clip to [lo, hi]; null stays null (``greatest``/``least`` skip nulls)."""
    x = _c(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def normalise_key(c) -> Column:
    """Entity key as trimmed text with a trailing ``.0`` removed."""
    return F.regexp_replace(F.trim(_c(c).cast("string")), r"\.0$", "")


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(text, F.lit(w))
    return cond


def keyword_classify(c, strict: bool = False) -> Column:
    """Group label by substring keywords on the lower-cased, trimmed text:
    first list -> female label, second -> male label, else/null -> other.
    Default lists include the single letters ``f``/``m`` (so any text with an
    ``f`` is female, as in the reference); ``strict`` uses the word lists."""
    t = F.lower(F.trim(_c(c).cast("string")))
    fw, mw = (FEMALE_WORDS_STRICT, MALE_WORDS_STRICT) if strict else (FEMALE_WORDS, MALE_WORDS)
    return (F.when(t.isNull(), F.lit(GROUP_OTHER))
            .when(_contains_any(t, fw), F.lit(GROUP_FEMALE))
            .when(_contains_any(t, mw), F.lit(GROUP_MALE)).otherwise(F.lit(GROUP_OTHER)))


def clean_code(c) -> Column:
    """Upper-case, keep only [A-Z0-9]; empty or null -> ``"0"``."""
    s = F.regexp_replace(F.upper(_c(c).cast("string")), "[^A-Z0-9]", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(EMPTY_CODE))


def extract_code(c) -> Column:
    """Ordered patterns: already clean -> as is; the word ALFA; a 1–2 digit
    level with a letter; a 1–2 digit number; else ``clean_code``."""
    t = F.upper(F.trim(_c(c).cast("string")))
    word = F.nullif(F.regexp_extract(t, CODE_WORD_PATTERN, 1), F.lit(""))
    level = F.nullif(F.regexp_extract(t, CODE_LEVEL_PATTERN, 1), F.lit(""))
    num = F.nullif(F.regexp_extract(t, CODE_NUMBER_PATTERN, 1), F.lit(""))
    return (F.when(t.isNull(), F.lit(EMPTY_CODE))
            .when(t.rlike("^[0-9A-Z]+$"), t)
            .otherwise(F.coalesce(word, level, num, clean_code(t))))


def null_words(c) -> Column:
    """Null or a null-like word (nan / nat / none, any case) -> ``"N/A"``."""
    s = _c(c).cast("string")
    return F.when(s.isNull() | F.lower(s).isin(*NULL_WORDS), F.lit(MISSING_TEXT)).otherwise(s)


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-null value over the alias columns that exist in ``df``."""
    present = [F.col(n) for n in names if n in df.columns]
    if not present:
        return F.lit(None)
    return present[0] if len(present) == 1 else F.coalesce(*present)


def year_parse(c, lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> Column:
    """Integer year (truncated) within [lo, hi], else null."""
    v = to_number(c)
    y = F.when(v.isNotNull() & (F.abs(v) < 1e9), v.cast("long"))
    return F.when(y.between(lo, hi), y.cast("int"))


def _truthy_text(s: Column) -> Column:
    return s.isNotNull() & (s != "")


def age_from_mixed(c, ref_year=None, base_year: int = BASE_YEAR, number=None) -> Column:
    """Age from an age, a birth year or a birth date: a value in [4, 25] is an
    age (truncated); a value above 1900 is a year -> base − value; otherwise
    an ISO date -> base − its year; the base is the reference year or 2024.
    Results outside [4, 25] are null.  ``number`` may pass ``to_number(c)``
    already computed as a column (keeps generated code small)."""
    s = _c(c).cast("string")
    v = _c(number) if number is not None else to_number(s)
    base = F.coalesce(_c(ref_year).cast("int"), F.lit(base_year)) if ref_year is not None else F.lit(base_year)
    from_year = base - v
    d = F.try_to_timestamp(F.trim(s), F.lit("yyyy-MM-dd"))
    from_date = base - F.year(d)
    ok = _truthy_text(s) & v.isNotNull()
    return (F.when(ok & v.between(AGE_MIN, AGE_MAX), F.floor(v).cast("int"))
            .when(ok & (v > 1900) & from_year.between(AGE_MIN, AGE_MAX), F.floor(from_year).cast("int"))
            .when(from_date.between(AGE_MIN, AGE_MAX), from_date.cast("int")))


def int_or_null(c) -> Column:
    """``int(float(text))`` for truthy text, else null."""
    v = to_number(c)
    return F.when(v.isNotNull() & (F.abs(v) < 1e9), v.cast("long").cast("int"))
