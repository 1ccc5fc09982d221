"""Label normalisation and signatures.

Dash folding, case and punctuation are built-ins.  Compatibility folding (NFKC, full case folding) has none, so labels with signs beyond ASCII and common dashes,
quotes and blanks go through an Arrow-batched UDF; for all others it is handed a null.  The sequence ratio is a batched UDF too.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that initialisms skip.
STOPWORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
# Groups of tokens of which different members mean different things.
CONTRASTS = [["spot", "futures", "forward"], ["product", "process"], ["quantity", "quality"], ["closeness", "betweenness", "eigenvector", "degree"], ["imports", "exports", "import", "export"], ["inbound", "outbound"], ["upstream", "downstream"], ["male", "female", "men", "women"]]


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ \-]+|[ \-]+$", "")


def normalized_simple(c: Column) -> Column:
    """``normalized`` for labels that compatibility folding leaves as they are."""
    x = F.regexp_replace(c, "[–—−]", "-")
    x = F.lower(F.regexp_replace(x, "&", " and "))
    return _squeezed(F.regexp_replace(x, r"[^0-9a-z()\-\s]+", " "))


@F.pandas_udf(T.StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def normalized(c: Column) -> Column:
    """Compatibility form, dashes folded, & spelled out, folded case, / as blank, other punctuation but brackets and hyphens as blank (null stays null)."""
    rare = c.rlike("[^\\x00-\\x7f–—−“”‘’\u00a0\u2009]")
    return normalized_simple(F.coalesce(_compatible(F.when(rare, c)), c))


def without_acronym(norm: Column) -> Column:
    return F.regexp_replace(norm, r"\s*\([A-Za-z][A-Za-z0-9&/\-]{1,14}\)\s*$", "")


def acronym(raw: Column) -> Column:
    """The upper-case name in brackets at the end, or the empty string."""
    return F.coalesce(normalized_simple(F.regexp_extract(raw, r"\s*\(([A-Z][A-Z0-9&/\-]{1,14})\)\s*$", 1)), F.lit(""))


def plain(norm: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(norm, r"[^0-9a-z\s]+", " "), r"\s+", " "))


def _singular(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when((n <= 4) | t.endswith("ics"), t)
        .when(t.endswith("ies") & (n > 5), F.regexp_replace(t, "ies$", "y"))
        .when(t.endswith("ss") | ~t.endswith("s") | t.endswith("us") | t.endswith("is"), t)
        .otherwise(F.regexp_replace(t, "s$", ""))
    )


def singular(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), _singular), " ")


def initialism(norm: Column) -> Column:
    """First letters of two to eight words that are no stop words, else the empty string."""
    words = F.filter(F.split(plain(norm), " "), lambda w: (w != "") & ~w.isin(STOPWORDS))
    return F.when(F.size(words).between(2, 8), F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).otherwise("")


def signatures(raw: Column) -> dict[str, Column]:
    """The six lexical signatures of a label."""
    norm = normalized(raw)
    bare = without_acronym(norm)
    return {"normalized_label": norm, "no_paren_signature": bare, "punctuation_signature": plain(bare), "singular_signature": singular(plain(bare)), "paren_acronym": acronym(raw), "initialism_signature": initialism(bare)}


def tokens(raw: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain(normalized(without_acronym(raw))), " "), lambda w: w != ""))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks (gestalt matching); edit distance is not equivalent."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def substring_share(a: Column, b: Column) -> Column:
    """Length share of a label that lies whole in another."""
    inside = F.contains(b, a) | F.contains(a, b)
    return F.when((F.length(a) > 0) & (F.length(b) > 0) & inside, F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def contrast(a: Column, b: Column) -> Column:
    """Whether two token arrays use different members of one contrast group."""
    out = F.lit(False)
    for g in CONTRASTS:
        lit = F.array(*map(F.lit, g))
        x, y = F.array_sort(F.array_intersect(a, lit)), F.array_sort(F.array_intersect(b, lit))
        out = out | ((F.size(x) > 0) & (F.size(y) > 0) & (x != y))
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def slug(c: Column, most: int = 40) -> Column:
    """A safe code from free text."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", "_"), r"^_+|_+$", ""), 1, most)


def is_true(c: Column) -> Column:
    """True for 1, true, t, yes and y, in any case and between blanks; anything else, null included, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


