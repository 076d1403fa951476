"""Merging source taxonomies: keys, scores, principals, links, discards and issues. Rules are Columns, chains are doubled joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.operators.store import cut

#: Scores stay within these bounds; owners get the highest and forbidden rows the lowest.
MOST = 1_000_000


def key_levels(rows: DataFrame) -> DataFrame:
    """level, n_keys, n_rows: how many keys instances (name, code, rank, author) have as bare, unranked, scientific and concept keys."""
    levels = {"bare": ["name"], "unranked": ["name", "code"], "scientific": ["name", "code", "author"], "concept": ["name", "code", "author", "rank"]}
    out = None
    # the finest keys are counted once; coarser levels are counted from them
    rows = rows.groupBy("name", "code", "author", "rank").agg(F.count("*").alias("m"))
    for level, cols in levels.items():
        keys = rows.groupBy(*cols).agg(F.sum("m").alias("m"))
        one = keys.agg(F.lit(level).alias("level"), F.count("*").alias("n_keys"), F.sum("m").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def adjusted(x: Column, rules: Sequence[tuple[Column, Column]]) -> Column:
    """A key part after rules (test, new value), each applied to what the one before it left."""
    for test, new in rules:
        x = F.when(test, new).otherwise(x)
    return x


def score(base: Column, rules: Sequence[tuple[Column, int]], owner: Column, forbidden: Column) -> Column:
    """Base and the adjustments of all rules that hold, within bounds."""
    total = sum((F.when(test, by).otherwise(0) for test, by in rules), base)
    return F.when(owner, MOST).when(forbidden, -MOST).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(-MOST), total)))


def unique_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with new_id: the key for its first row (smallest order), key, # and the place for repeats: the same in every run."""
    first = rows.groupBy(key).agg(F.min(order).alias("__first"))
    counted = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("__rn", F.row_number().over(counted)).join(first, key)
    return marked.withColumn("new_id", F.when(F.col(order) == F.col("__first"), F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("#"), F.col("__rn")))).drop("__rn", "__first")


def inferred_status(status: Column, parent: Column, accepted: Column) -> Column:
    """A synonym that names no accepted taxon but has a parent counts as accepted."""
    return F.when((status == "synonym") & accepted.isNull() & parent.isNotNull(), "inferredAccepted").otherwise(status)


def principal(rows: DataFrame, key: str, cutoff: int) -> DataFrame:
    """key, id of the principal: above the cutoff before below, then by score, with author before without, then smallest id; by partial maxima."""
    order = F.struct((F.col("score") > cutoff).alias("over"), "score", F.col("author").isNotNull().alias("authored"), (-F.col("id")).alias("k"))
    return rows.groupBy(key).agg(F.max(order).alias("b")).select(key, (-F.col("b.k")).alias("principal"))


def nearest_rank(wanted: DataFrame, concepts: DataFrame) -> DataFrame:
    """key, id of the concept (key, id, rank_id, score) whose rank is nearest to the wanted one (key, rank_id); ties by score, then id."""
    c = concepts.select("key", "id", F.col("rank_id").alias("r"), "score")
    order = F.struct(F.abs(F.col("r") - F.col("rank_id")).alias("gap"), (-F.col("score")).alias("s"), F.col("id"))
    return wanted.join(c, "key").groupBy("key", "rank_id").agg(F.min(order).alias("b")).select("key", "rank_id", F.col("b.id").alias("id"))


def links(rows: DataFrame, default: str) -> DataFrame:
    """id, parent for rows (id, provider, parent_id, parent_name): by id, else by name within the provider, else the default."""
    by_id = rows.select(F.col("id").alias("parent_id"), F.col("id").alias("p1"))
    by_name = rows.groupBy("provider", F.col("name").alias("parent_name")).agg(F.min("id").alias("p2"))
    return rows.join(by_id, "parent_id", "left").join(by_name, ["provider", "parent_name"], "left").select("id", F.coalesce("p1", "p2", F.lit(default)).alias("parent"))


def past_forbidden(rows: DataFrame, steps: int = 64) -> DataFrame:
    """id, parent for rows (id, parent_id, forbidden): the first parent that isn't forbidden, by doubling; null if there is none or the chain loops."""
    jump = rows.where("forbidden").select(F.col("id").alias("at"), F.col("parent_id").alias("on"))
    now, done = rows.select("id", F.col("parent_id").alias("at")), 1
    while done < steps:
        hop = jump.select("at", F.col("on").alias("to"), F.lit(True).alias("hops"))
        now = cut(now.join(hop, "at", "left").select("id", F.when(F.col("hops"), F.col("to")).otherwise(F.col("at")).alias("at")))
        further = jump.select(F.col("at").alias("on"), F.col("on").alias("next"), F.lit(True).alias("goes"))
        jump = cut(jump.join(further, "on", "left").select("at", F.when(F.col("goes"), F.col("next")).otherwise(F.col("on")).alias("on")))
        done *= 2
    left = rows.where("forbidden").select(F.col("id").alias("at"), F.lit(True).alias("still"))
    return now.join(left, "at", "left").select("id", F.when(F.col("still").isNull(), F.col("at")).alias("parent"))


def cycles(edges: DataFrame, steps: int = 64) -> DataFrame:
    """id, cycle (its smallest id) for the rows of edges (id, target) that lie on a loop, by doubling.

    After as many steps as the longest loop and chain take together every walk is on its loop, so the nodes where walks end,
    carried on by a smallest id over as many steps, are the loops.
    """
    now, done = edges.select("id", "target", F.least("id", "target").alias("least")), 1
    while done < steps:
        on = now.select(F.col("id").alias("target"), F.col("target").alias("next"), F.col("least").alias("far"))
        now = cut(now.join(on, "target").select("id", F.col("next").alias("target"), F.least("least", "far").alias("least")))
        done *= 2
    ends = now.select(F.col("target").alias("id")).distinct()
    return now.join(ends, "id", "left_semi").select("id", F.col("least").alias("cycle"))


def break_points(members: DataFrame) -> DataFrame:
    """cycle, id of the member with the lowest score, then smallest id, of members (id, cycle, score)."""
    return members.groupBy("cycle").agg(F.min(F.struct("score", "id")).alias("b")).select("cycle", F.col("b.id").alias("id"))


def placed_under(rows: DataFrame, ids: DataFrame, unknown: str) -> DataFrame:
    """id, parent for rows (id, parent_id): the unknown taxon in place of parents that aren't among ids (id)."""
    known = ids.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    return rows.join(known, "parent_id", "left").select("id", F.when(F.col("parent_id").isNull() | F.col("known"), F.col("parent_id")).otherwise(F.lit(unknown)).alias("parent"))


def discarded(rows: DataFrame) -> DataFrame:
    """What becomes of forbidden rows (id, parent_id, strategy): id, target, becomes (identifier or synonym of the parent); ignored ones leave nothing."""
    kept = rows.where("parent_id is not null and strategy in ('IDENTIFIER_TO_PARENT', 'SYNONYMISE_TO_PARENT')")
    return kept.select("id", F.col("parent_id").alias("target"), F.when(F.col("strategy") == "IDENTIFIER_TO_PARENT", "discarded").otherwise("inferredSynonym").alias("becomes"))


def issues(rows: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """code, id, message: one row for each rule (code, message format over name and id, test) that a row (id, name) breaks; one pass."""
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), F.format_string(text, "name", "id").alias("message"))) for code, text, test in rules]))
    return rows.select("id", F.explode(found).alias("i")).select("i.code", "id", "i.message")


def uncovered(places: DataFrame, closure: DataFrame) -> DataFrame:
    """places (taxon, location) without those inside another place of the taxon; closure: location, ancestor (itself left out)."""
    above = closure.join(places.select("taxon", F.col("location").alias("ancestor")), "ancestor").select("taxon", "location").distinct()
    return places.join(above, ["taxon", "location"], "left_anti")
