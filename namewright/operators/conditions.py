"""Rules on taxa compiled to Columns: conjunctions of optional tests, their composition, and the text of the rule that holds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from namewright.functions.names import ACCENTED, FOLDED, normalise_spaces


def text_test(x: Column, want: str, mode: str = "EXACT") -> Column:
    """EXACT, INSENSITIVE (case and runs of spaces aside), NORMALISED (punctuation and marks of letters aside too) or REGEX (the whole text, case aside). Null never matches."""
    if mode == "EXACT":
        hit = x == want
    elif mode == "INSENSITIVE":
        hit = F.upper(normalise_spaces(x)) == F.upper(normalise_spaces(F.lit(want)))
    elif mode == "NORMALISED":
        plain = lambda v: normalise_spaces(F.regexp_replace(F.translate(F.upper(v), ACCENTED, FOLDED), r"\p{P}+", " "))
        hit = plain(x) == plain(F.lit(want))
    elif mode == "REGEX":
        hit = x.rlike(f"(?i)^(?:{want})$")
    else:
        raise ValueError(f"unknown match mode {mode}")
    return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """A test and the text that explains it."""

    test: Column
    text: str


def match_rule(name: str | None = None, mode: str = "EXACT", name_column: str = "name", **fields: Sequence) -> Rule:
    """All of: the name test, and for each given column one of its values. Without any test, true."""
    tests, texts = [], []
    if name is not None:
        tests.append(text_test(F.col(name_column), name, mode))
        texts.append(f"{name_column}:{name}")
    for column, values in fields.items():
        tests.append(F.coalesce(F.col(column).isin(list(values)), F.lit(False)))
        texts.append(f"{column}:{','.join(map(str, values))}")
    return Rule(reduce(Column.__and__, tests, F.lit(True)), " ".join(texts))


def all_of(rules: Sequence[Rule]) -> Rule:
    """True without rules."""
    return Rule(reduce(Column.__and__, [r.test for r in rules], F.lit(True)), f"({' AND '.join(r.text for r in rules)})")


def any_of(rules: Sequence[Rule]) -> Rule:
    """False without rules."""
    return Rule(reduce(Column.__or__, [r.test for r in rules], F.lit(False)), f"({' OR '.join(r.text for r in rules)})")


def first_reason(rules: Sequence[Rule]) -> Column:
    """Text of the first rule that holds, else null. Rules of a parent come before a child's own."""
    return F.coalesce(*[F.when(r.test, F.lit(r.text)) for r in rules], F.lit(None).cast("string"))


def same_classification(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Whether each rank that the query has equals the result's, case aside. pairs: (query, result) down to the level."""
    return reduce(Column.__and__, [q.isNull() | F.coalesce(F.lower(q) == F.lower(r), F.lit(False)) for q, r in pairs], F.lit(True))
