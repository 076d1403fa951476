"""Similarity of names and near-match forms as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namewright.functions.names import LEADING, blank_to_null, bound, led

#: Fixed values of the near-match form: digraphs in the rest of a word, then letters by place (H has no partner and goes).
DIGRAPHS, LETTERS, INSTEAD = [("AE", "I"), ("IA", "A"), ("OE", "I"), ("OI", "A"), ("SC", "S")], "EOUYKZH", "IAIICS"


def _numbered_grams(x: Column, n: int) -> Column:
    pad = " " * (n - 1)
    text = F.concat(F.lit(pad), x, F.lit(pad))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda h: h == g)).cast("string")))


def ngram_similarity(a: Column, b: Column, n: int) -> Column:
    """Dice similarity of the multisets of n-grams of the padded texts, to four places."""
    both = F.size(F.array_intersect(_numbered_grams(a, n), _numbered_grams(b, n)))
    return F.round(2.0 * both / (F.length(a) + F.length(b) + 2 * (n - 1)), 4)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / length of the longer text; 1 for two empty ones."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def term_ladder(query: Column, found: Column, unlike: Column, kingdom: bool = False) -> Column:
    """Null if the query has no term, 0.01 (kingdom) or 0.5 if the taxon has none, 1 if equal, else the given similarity."""
    return F.when(blank_to_null(query).isNull(), None).when(blank_to_null(found).isNull(), 0.01 if kingdom else 0.5).when(F.lower(query) == F.lower(found), 1.0).otherwise(unlike)


def wildcard_score(x: Column, query: Column, exact: float = 12.0) -> Column:
    """Points for a text that starts with the query, has a word that does, contains it, and is it."""
    point = lambda test, w: F.when(test, w).otherwise(0.0)
    return point(x.startswith(query), 1.0) + point(x.contains(F.concat(F.lit(" "), query)), 1.0) + point(x.contains(query), 1.0) + point(x == query, exact)


def gender_neutral(x: Column) -> Column:
    """Endings -us and -um become -a; the whole run of their letters goes."""
    return F.when(x.endswith("us"), F.concat(F.regexp_replace(x, "[us]+$", ""), F.lit("a"))).when(x.endswith("um"), F.concat(F.regexp_replace(x, "[um]+$", ""), F.lit("a"))).otherwise(x)


def near_match(x: Column, epithet: bool = False) -> Column:
    """Near-match form of an upper-case word: leading letters, digraphs, letters, repeats; endings of epithets of over four letters."""

    def key(lead: Column) -> Column:
        rest = F.substring(lead, 2, 1 << 30)
        for old, new in DIGRAPHS:
            rest = F.replace(rest, F.lit(old), F.lit(new))
        return F.regexp_replace(F.concat(F.substring(lead, 1, 1), F.translate(rest, LETTERS, INSTEAD)), r"(\w)\1+", "$1")

    out = bound(bound(x, lambda w: led(w, [("PH", "F"), *LEADING, ("X", "Z")])), key)
    return bound(out, lambda k: F.when(F.length(k) > 4, F.regexp_replace(k, "(IS|IM|AS)$", "A")).otherwise(k)) if epithet else out
