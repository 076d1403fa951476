"""Lookups around the match: guards, filters, hints, links to accepted taxa, common names, checks on a query's candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.functions.names import blank_to_null, rank_marker

#: Rank number of species and the last one below it; points of a hint for an accepted taxon.
SPECIES, LAST, ACCEPTED_POINTS = 7000, 9999, 20


def query_error(name: Column) -> Column:
    """Why a name is not looked up: GENERIC without name or with a rank marker alone, SPECIES_PLURAL for spp., else null."""
    return F.when(blank_to_null(name).isNull() | rank_marker(name), "GENERIC").when(F.lower(name).contains(" spp."), "SPECIES_PLURAL")


def rank_allowed(wanted: Column, rank: Column, synonym: Column, local: Column) -> Column:
    """Species and below match any such rank from their own on, other ranks only themselves; synonyms and local names always."""
    return F.when(wanted >= SPECIES, rank.between(wanted, F.lit(LAST))).otherwise(rank == wanted) | synonym | local


def hint_score(terms: Sequence[tuple[Column, Column]], accepted: Column) -> Column:
    """One point per classification term that agrees, more for an accepted taxon: ranks candidates, excludes none."""
    return sum((F.when(F.lower(q) == F.lower(t), 1).otherwise(0) for q, t in terms), F.when(accepted, ACCEPTED_POINTS).otherwise(0))


def best(rows: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their place rn; Spark cuts each partition to k before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def with_accepted(taxa: DataFrame) -> DataFrame:
    """taxa (id, accepted_id, name) with accepted_name: that of the accepted taxon, the own one without."""
    on = taxa.select(F.col("id").alias("accepted_id"), F.col("name").alias("up"))
    return taxa.join(on, "accepted_id", "left").select("id", "accepted_id", "name", F.coalesce("up", "name").alias("accepted_name"))


def copied_ranks(synonyms: DataFrame, accepted: DataFrame, ranks: Sequence[tuple[str, int]]) -> DataFrame:
    """Synonyms (id, accepted_id) with the accepted taxon's names at the ranks strictly above its own; accepted: id, rank_id and a column per rank."""
    up = accepted.withColumnRenamed("id", "accepted_id")
    return synonyms.select("id", "accepted_id").join(up, "accepted_id", "left").select("id", "accepted_id", *[F.when(F.col("rank_id") > no, F.col(r)).alias(r) for r, no in ranks])


def unique_taxon(names: DataFrame) -> DataFrame:
    """name, id for (name, id): the one taxon of a common name; null for a name of several."""
    ends = names.groupBy("name").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return ends.select("name", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("id"))


def common_names(names: DataFrame, languages: Sequence[str]) -> DataFrame:
    """id, preferred, n_names for (id, name, language): the first of the languages' order, ties by name; names differ if they do without case."""
    order = F.array_position(F.array(*map(F.lit, languages)), F.col("language"))
    place = F.when(order == 0, len(languages) + 1).otherwise(order)
    one = names.groupBy("id", F.lower("name").alias("low")).agg(F.min(F.struct(place.alias("place"), F.col("name"))).alias("s"))
    return one.groupBy("id").agg(F.min("s").alias("s"), F.count("*").alias("n_names")).select("id", F.col("s.name").alias("preferred"), "n_names")


def homonym_level(hits: DataFrame, levels: Sequence[str]) -> DataFrame:
    """key, level, n: the first level down to which one hit agrees with the query.

    hits: key and for each level a boolean column, whether the hit agrees there. A hit counts at a level if it agrees there
    and at all levels above. unresolved: several are left at the last level; none: no hit agrees.
    """
    tests = [reduce(Column.__and__, [F.coalesce(F.col(c), F.lit(False)) for c in levels[: i + 1]]) for i in range(len(levels))]
    n = hits.groupBy("key").agg(*[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests)])
    level = F.when(F.lit(False), "")
    for i, c in enumerate(levels):
        level = level.when(F.col(f"n{i}") == 1, c)
    last = F.col(f"n{len(levels) - 1}")
    return n.select("key", level.when(F.col("n0") == 0, "none").otherwise("unresolved").alias("level"), last.alias("n"))


def result_checks(hits: DataFrame) -> DataFrame:
    """qid and what a query's hits (qid, id, accepted_id, kind) say together.

    one_concept: all lead to one accepted taxon. error: EXCLUDED if all hits are excluded and ASSOCIATED_EXCLUDED if some are;
    then MATCH_MISAPPLIED if misapplied hits stand beside others or lead to several taxa, MISAPPLIED if all lead to one.
    """
    target = F.coalesce("accepted_id", "id")
    bad, mis = F.count_if(F.col("kind") == "excluded"), F.count_if(F.col("kind") == "misapplied")
    n = hits.groupBy("qid").agg(F.count("*").alias("n"), bad.alias("bad"), mis.alias("mis"), F.min(target).alias("lo"), F.max(target).alias("hi"))
    error = F.when(F.col("bad") == F.col("n"), "EXCLUDED").when(F.col("bad") > 0, "ASSOCIATED_EXCLUDED")
    error = error.when((F.col("mis") > 0) & ((F.col("mis") < F.col("n")) | (F.col("lo") != F.col("hi"))), "MATCH_MISAPPLIED").when(F.col("mis") > 0, "MISAPPLIED")
    return n.select("qid", "n", (F.col("lo") == F.col("hi")).alias("one_concept"), error.alias("error"))
