"""Words, tokens and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_]+"


def clean_word(word: Column) -> Column:
    """Lower case, every run of characters outside words deleted: ``don't`` becomes ``dont``."""
    return F.regexp_replace(F.lower(word), NOT_WORD, "")


def words(text: Column) -> Column:
    """White-space separated words, each as ``clean_word`` leaves it, empty ones dropped.

    The text is cleaned in one pass before it is cut: what goes is no white space, so words neither merge nor split.
    """
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]+", ""), r"\s+"), "")


def folded(items: Column) -> Column:
    """An array without adjacent repeats."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))))
    pairs = F.zip_with(items, before, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(F.filter(pairs, lambda p: ~p["x"].eqNullSafe(p["y"])), lambda p: p["x"])


def tokens(text: Column) -> Column:
    return folded(words(text))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def array_ngrams(items: Column, n: int, separator: str = "\x1f") -> Column:
    """Runs of ``n`` successive elements joined to strings; none where the array is shorter, NULL for a NULL array."""
    m = F.size(items) - n + 1
    runs = F.transform(F.sequence(F.lit(1), m), lambda k: F.array_join(F.slice(items, k, n), separator))
    return F.when(m > 0, runs).when(items.isNotNull(), F.array().cast("array<string>"))


def computed(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a column evaluated once a row: later expressions refer to it, the optimizer does not inline it."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def pair_jaccard(a: Column, b: Column, longest: int = 5) -> Column:
    """Jaccard similarity of the shingles of two token arrays, of as many tokens as the shorter has, five at most.

    0 where either has no tokens.
    """
    n = F.least(F.size(a), F.size(b), F.lit(longest))
    out = F.lit(0.0)
    for k in range(1, longest + 1):
        out = F.when(n == k, jaccard(F.array_distinct(array_ngrams(a, k)), F.array_distinct(array_ngrams(b, k)))).otherwise(out)
    return out


def minhash(items: Column, permutations: int = 128) -> Column:
    """Signature of a set: the least hash of its items under each of the seeds."""
    return F.transform(F.sequence(F.lit(1), F.lit(permutations)), lambda s: F.array_min(F.transform(items, lambda x: F.xxhash64(s, x))))


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)
