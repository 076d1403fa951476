"""Reports and inherited values of merged concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.functions.names import spelling_key
from namewright.operators.store import cut
from namewright.operators.tree import DEEPEST

#: Bounds of a score.
LEAST, MOST = -1_000_000, 1_000_000


def spelling_collisions(names: DataFrame) -> DataFrame:
    """parent, key, n, kind, issue for the children of a parent whose names have one spelling key, if they are more than one.

    names: parent, name, provider, code; a row per concept. The kind is crossCode if the codes differ, else internal if
    one provider has them all, else authorship if the names are equal, else spelling. The issue is a NOTE if there is one
    name or one provider. A null provider or code is a value of its own; rows without parent or name are left out. All
    tests are minima and maxima, combined before the one shuffle.
    """
    known = names.where("parent is not null and name is not null").select("parent", spelling_key(F.col("name")).alias("key"), "name", *[F.coalesce(c, F.lit("\0")).alias(c) for c in ("provider", "code")])
    one = lambda c: (F.min(c) == F.max(c)).alias(f"one_{c}")
    found = known.groupBy("parent", "key").agg(F.count("*").alias("n"), one("name"), one("provider"), one("code")).where("n > 1")
    kind = F.when(~F.col("one_code"), "crossCode").when(F.col("one_provider"), "internal").when(F.col("one_name"), "authorship").otherwise("spelling")
    return found.select("parent", "key", "n", kind.alias("kind"), F.when(F.col("one_name") | F.col("one_provider"), "NOTE").otherwise("COLLISION").alias("issue"))


def inherited_scores(nodes: DataFrame) -> DataFrame:
    """id, score: a node's own specific score, else that of its nearest ancestor through parents of its provider, else the default.

    nodes: id, parent_id, provider, specific, default (the provider's). A chain ends where the provider changes or is
    null, where a parent is missing, and where it loops. Inherited scores and defaults are kept within bounds, specific
    ones are not. Doubling: each join halves the steps that are left.
    """
    p = nodes.select(F.col("id").alias("parent_id"), F.col("provider").alias("p_provider"))
    linked = nodes.join(p, "parent_id", "left")
    up = F.when(F.col("specific").isNull() & (F.col("provider") == F.col("p_provider")) & (F.col("parent_id") != F.col("id")), F.col("parent_id"))
    now, done = cut(linked.select("id", F.col("specific").alias("score"), up.alias("up"))), 1
    while done < DEEPEST:
        on = now.select(F.col("id").alias("up"), F.col("score").alias("up_score"), F.col("up").alias("next"))
        now = cut(now.join(on, "up", "left").select("id", F.coalesce("score", "up_score").alias("score"), F.when(F.coalesce("score", "up_score").isNull(), F.col("next")).alias("up")))
        done *= 2
        if now.where("up is not null").isEmpty():
            break
    bounded = F.greatest(F.least(F.coalesce("score", "default"), F.lit(MOST)), F.lit(LEAST))
    return nodes.join(now.select("id", "score"), "id").select("id", F.coalesce("specific", bounded).alias("score"))


def _chains(starts: DataFrame, taxa: DataFrame, accepted_on: bool) -> DataFrame:
    """start, depth, node, concept: the accepted taxa of start and its ancestors; accepted_on: parents are those of the accepted taxa."""
    step = taxa.select(F.col("id").alias("at"), F.coalesce("accepted_id", "id").alias("node"), F.col("parent_id").alias("own_parent"))
    node = taxa.select(F.col("id").alias("node"), "concept", F.col("parent_id").alias("node_parent"))
    now, out = starts.select("start", F.col("start").alias("at")).distinct(), None
    for depth in range(DEEPEST):
        here = cut(now.join(step, "at").join(node, "node").select("start", F.lit(depth).alias("depth"), "node", "concept", (F.col("node_parent") if accepted_on else F.col("own_parent")).alias("up")))
        if here.isEmpty():
            break
        rows = here.drop("up")
        out = rows if out is None else out.unionByName(rows)
        now = here.where("up is not null").select("start", F.col("up").alias("at"))
    return rows if out is None else out


def least_upper_bounds(pairs: DataFrame, taxa: DataFrame) -> DataFrame:
    """a, b, lub for each pair (a, b): the first accepted taxon of a and its ancestors whose concept b's accepted line has, else null.

    taxa: id, parent_id, accepted_id, concept; one row an id. Synonyms stand for what they are accepted as. Ids that
    aren't known have no line; a hierarchy that loops ends at 1000 levels.
    """
    pairs = pairs.select("a", "b").distinct()
    first = _chains(pairs.select(F.col("a").alias("start")), taxa, False).withColumnRenamed("start", "a")
    second = _chains(pairs.select(F.col("b").alias("start")), taxa, True).select(F.col("start").alias("b"), "concept").distinct()
    met = pairs.join(first, "a").join(second, ["b", "concept"]).groupBy("a", "b").agg(F.min_by("node", "depth").alias("lub"))
    return pairs.join(met, ["a", "b"], "left")
