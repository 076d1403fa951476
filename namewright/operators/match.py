"""Matching names to taxa: a ranked cascade of equi-joins, as one plan over all queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.functions.names import letters_key, sound_key

#: Candidates a query keeps, and the score above which weaker ones are dropped.
TOP, ENOUGH = 10, 0.5
STAGES = ("exactMatch", "canonicalMatch", "soundexMatch")


def cascade(queries: DataFrame, taxa: DataFrame, top: int = TOP) -> DataFrame:
    """qid, match_type, id, rn for queries (qid, name) and taxa (id, name, priority).

    A query keeps the candidates of the first stage that gives any: exact (case aside), canonical (letters only), then
    sounds-alike on the first three words, where a missing epithet only matches a missing one. Phrase and cultivar
    stages are missing. The best come first by priority, then id.
    """
    def keys(df: DataFrame) -> DataFrame:
        word = F.split(F.trim("name"), " +")
        epithets = [F.coalesce(sound_key(F.get(word, F.lit(i)), True), F.lit("<null>")) for i in (1, 2)]
        sound = F.concat(sound_key(F.get(word, F.lit(0))), F.lit(" "), epithets[0], F.lit(" "), epithets[1])
        return df.withColumn("keys", F.array(F.lower("name"), letters_key(F.col("name")), sound))

    # a query has one key a stage, so the best of a key are the best of the query: taxa are cut to them before the join
    best = Window.partitionBy("stage", "key").orderBy(F.desc("priority"), "id")
    q = keys(queries).select("qid", F.posexplode("keys").alias("stage", "key")).where("key <> ''")
    t = keys(taxa).select("id", "priority", F.posexplode("keys").alias("stage", "key")).where("key <> ''")
    t = t.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= top)
    hits = q.join(t, ["stage", "key"])
    first = Window.partitionBy("qid")
    kept = hits.withColumn("first", F.min("stage").over(first)).where(F.col("stage") == F.col("first"))
    return kept.select("qid", F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage") + 1).alias("match_type"), "id", "rn")


def above_threshold(hits: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """hits (qid, score, ...): those above the threshold if a query has any, else all of its hits."""
    any_ = F.max(F.col("score") > enough).over(Window.partitionBy("qid"))
    return hits.withColumn("any_", any_).where(~F.col("any_") | (F.col("score") > enough)).drop("any_")


def weighted_score(pairs: list[tuple[float, Column, Column]], base: float) -> Column:
    """(base + sum of weight * similarity) / (base + sum of weights) over the terms that a query has: 1 if equal, 0.5 if the taxon has none, else 0."""
    top, bottom = F.lit(base), F.lit(base)
    for w, q, t in pairs:
        like = F.when(t.isNull(), 0.5).when(F.lower(q) == F.lower(t), 1.0).otherwise(0.0)
        top = top + F.when(q.isNull(), 0.0).otherwise(w * like)
        bottom = bottom + F.when(q.isNull(), 0.0).otherwise(w)
    return top / bottom
