"""Name and text functions as Columns: all built-in expressions, so that they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to, pair by pair.
ACCENTED, FOLDED = "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÃÑÕÅÇØ", "AEIOUAEIOUAEIOUAEIOUANOACO"
#: Leading letters and what takes their place, first match only.
LEADING = [
    ("AE", "E"), ("CN", "N"), ("CT", "T"), ("CZ", "C"), ("DJ", "J"), ("EA", "E"), ("EU", "U"), ("GN", "N"), ("KN", "N"), ("MC", "MAC"),
    ("MN", "N"), ("OE", "E"), ("QU", "Q"), ("PS", "S"), ("PT", "T"), ("TS", "S"), ("WR", "R"),
]
#: Replacements in the rest of a word, in this order.
TAIL = [("AE", "I"), ("IA", "A"), ("OE", "I"), ("OI", "A"), ("SC", "S"), ("E", "I"), ("O", "A"), ("U", "I"), ("Y", "I"), ("K", "C"), ("Z", "C"), ("H", "")]
#: Fixed value: letters that the search form of a common name keeps.
COMMON_KEPT = "A-Z0-9ÏËÖÜÄÉÈČÁÀÆŒ"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def normalise_spaces(x: Column) -> Column:
    """Runs of any white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def sound_normal(x: Column) -> Column:
    """Upper case without marks, letters, spaces and dots only; null if nothing is left."""
    x = F.replace(F.translate(F.upper(x), ACCENTED, FOLDED), F.lit("Æ"), F.lit("AE"))
    return blank_to_null(F.regexp_replace(x, "[^a-zA-Z .]", ""))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once: a long rule that repeats its argument would copy it into every branch."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def led(x: Column, rules: list[tuple[str, str]]) -> Column:
    """x with the first of the leading letters that it has replaced."""
    lead = F.when(F.lit(False), x)
    for old, new in rules:
        lead = lead.when(x.startswith(old), F.concat(F.lit(new), F.substring(x, len(old) + 1, 1 << 30)))
    return lead.otherwise(x)


def sound_key(x: Column, epithet: bool = False) -> Column:
    """Sounds-alike key of one word of a name; an epithet also loses its gender ending."""

    def key(lead: Column) -> Column:
        rest = F.substring(lead, 2, 1 << 30)
        for old, new in TAIL:
            rest = F.replace(rest, F.lit(old), F.lit(new))
        squeezed = F.regexp_replace(F.concat(F.substring(lead, 1, 1), rest), r"(\w)\1+", "$1")
        return F.regexp_replace(squeezed, "(IS|IM|AS)$", "A") if epithet else squeezed

    lead = bound(sound_normal(x), lambda w: F.when(w.startswith("X"), F.concat(F.lit("Z"), F.substring(w, 3, 1 << 30))).otherwise(led(w, LEADING)))
    return bound(lead, key)


def common_key(x: Column) -> Column:
    """Search form of a common name."""
    return F.regexp_replace(F.upper(x), f"[^{COMMON_KEPT}]", "")


def letters_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z]", "")


def author_key(x: Column) -> Column:
    """Author without punctuation and separators."""
    return F.regexp_replace(x, r"[\p{P}\p{Z}]", "")


def full_name(name: Column, author: Column, given: Column) -> Column:
    """The given complete name, else name and author put together without repeating either."""
    a = blank_to_null(author)
    return F.when(blank_to_null(given).isNotNull(), F.trim(given)).when(a.isNull() | name.endswith(a), name).when(a.startswith(name), a).otherwise(F.concat_ws(" ", name, a))


def without_locality(x: Column) -> Column:
    """Name (Locality) becomes Name."""
    return F.regexp_replace(x, r"^(.*\S)\s*\([^()]*\)\s*$", "$1")


def rank_marker(x: Column) -> Column:
    """Whether the text is a rank marker alone."""
    return F.lower(F.trim(x)).isin("spp", "spp.", "sp", "sp.", "sp.nov.")


def doubt_flags(x: Column) -> Column:
    """QUESTION, CONFER and AFFINITY marks in a name; NONE without any."""
    found = F.array_compact(F.array(F.when(x.contains("?"), "QUESTION"), F.when(x.rlike(r"\bcf[. ]"), "CONFER"), F.when(x.rlike(r"\baff[. ]"), "AFFINITY")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("NONE")))


def split_flags(x: Column, marks: str = "|,") -> Column:
    """Distinct trimmed upper-case parts."""
    parts = F.transform(F.split(x, f"[{marks}]"), lambda p: F.upper(F.trim(p)))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def without_author(name: Column, author: Column) -> Column:
    """The name without the first occurrence of its author."""
    at = F.instr(name, author)
    cut = F.trim(F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + F.length(author), F.length(name))))
    return F.when(at > 0, cut).otherwise(name)


#: Words that virus names are also found without; words that a phrase loses.
VIRUS_WORDS, PHRASE_WORDS = " virus| ictv| ICTV", r"&|\bAND\b|\band\b|\bStn\b|\bStation\b|\bMt\b|\bMount\b"


def virus_variants(x: Column) -> Column:
    """The spellings that a virus name is looked up by."""
    bare = F.regexp_replace(x, VIRUS_WORDS, "")
    return F.array_distinct(F.array(x, bare, F.trim(bare)))


def phrase_clean(x: Column) -> Column:
    """A phrase without connecting words and quotation marks, single-spaced."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, PHRASE_WORDS, ""), "['\"]", ""), " +", " "))


def phrase_parts(x: Column) -> Column:
    """genus, rank, phrase, voucher of a phrase name such as `Baeckea sp. Bunney Road (S.Patrick 4059)`; nulls for other names."""
    shape = r"^([A-Z][a-z]+)\s+(sp\.|subsp\.|var\.)\s+([A-Z'\"][^()]*?)\s*(?:\(([^()]*)\))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(x, shape, i), F.lit(""))
    return F.struct(part(1).alias("genus"), part(2).alias("rank"), part(3).alias("phrase"), part(4).alias("voucher"))


def inferred_name(parts: list[tuple[str, Column]]) -> Column:
    """rank, name: the first of the (rank, text) parts that is there, lowest rank first."""
    first = F.when(F.lit(False), F.struct(F.lit("").alias("rank"), F.lit("").alias("name")))
    for rank, x in parts:
        first = first.when(blank_to_null(x).isNotNull(), F.struct(F.lit(rank).alias("rank"), F.trim(x).alias("name")))
    return first


#: Fixed values of the spelling key: replacements after the first letter, in this order; the last one is a literal run of letters.
SPELLING_TAIL = [("AE", "I"), ("IA", "A"), ("OE", "I"), ("OI", "A"), ("MC", "MAC"), ("SC", "S"), ("EOUYKZH", "IAIICS")]


def spelling_key(x: Column) -> Column:
    """Key of names that differ by suspiciously little: sounds as above without `Mc`, no repeated letter, each word's letters in order after its first."""

    def word(w: Column) -> Column:
        return F.concat(F.substring(w, 1, 1), F.array_join(F.array_sort(F.filter(F.split(F.substring(w, 2, 1 << 30), ""), lambda c: c != "")), ""))

    def key(lead: Column) -> Column:
        rest = F.substring(lead, 2, 1 << 30)
        for old, new in SPELLING_TAIL:
            rest = F.replace(rest, F.lit(old), F.lit(new))
        squeezed = F.regexp_replace(F.concat(F.substring(lead, 1, 1), rest), r"(?s)(.)\1+", "$1")
        return F.array_join(F.transform(F.filter(F.split(squeezed, " "), lambda w: w != ""), word), " ")

    return bound(led(F.upper(x), [("Æ", "E"), *[rule for rule in LEADING if rule[0] != "MC"], ("X", "Z")]), key)
