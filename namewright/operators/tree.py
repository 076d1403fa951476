"""Hierarchies as tables (id, parent_id): levels, nested sets, resolved links. One join a level, never a walk on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namewright.operators.store import cut

#: Levels of a hierarchy and steps of a chain of links, at most.
DEEPEST, STEPS = 1000, 40


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (id, parent_id) by depth, roots (no parent; accepted or not isn't asked) first; nodes that no root reaches are in none."""
    out = [nodes.where("parent_id is null").select("id", "parent_id", F.lit(0).alias("depth"))]
    while len(out) < DEEPEST:
        above = out[-1].select(F.col("id").alias("parent_id"))
        below = nodes.join(above, "parent_id", "left_semi").select("id", "parent_id", F.lit(len(out)).alias("depth"))
        below = cut(below)
        if below.isEmpty():
            break
        out.append(below)
    return out


def nested_set(nodes: DataFrame) -> DataFrame:
    """id, depth, left, right: siblings by id. Sizes are summed from the lowest level up and bounds dealt from the top down."""
    by_depth = levels(nodes)
    sized: list[DataFrame] = []
    below: DataFrame | None = None
    for level in reversed(by_depth):
        here = level.withColumn("size", F.lit(1).cast("long"))
        if below is not None:
            sums = below.groupBy(F.col("parent_id").alias("id")).agg(F.sum("size").alias("more"))
            here = level.join(sums, "id", "left").select("id", "parent_id", "depth", (1 + F.coalesce("more", F.lit(0))).alias("size"))
        sized.append(here)
        below = here
    out: DataFrame | None = None
    above: DataFrame | None = None
    earlier = Window.partitionBy("parent_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    for level in reversed(sized):
        placed = level.withColumn("shift", F.coalesce(F.sum("size").over(earlier), F.lit(0)) * 2)
        if above is None:
            # a root's bounds skip those of the trees before it
            placed = placed.withColumn("left", 2 + F.col("shift"))
        else:
            placed = placed.join(above.select(F.col("id").alias("parent_id"), F.col("left").alias("from")), "parent_id").withColumn("left", F.col("from") + 1 + F.col("shift"))
        above = placed
        rows = placed.select("id", "depth", "left", (F.col("left") + 2 * (F.col("size") - 1)).alias("right"))
        out = rows if out is None else out.unionByName(rows)
    return out


def inherited(nodes: DataFrame, ranks: list[str]) -> DataFrame:
    """id and one column per rank: the name of the node or of its ancestor at that rank. nodes: id, parent_id, rank, name."""
    own = lambda df: [F.when(F.col("rank") == r, F.col("name")).alias(r) for r in ranks]
    level = nodes.where("parent_id is null")
    level = level.select("id", *own(level))
    out = level
    for below in levels(nodes)[1:]:
        above = level.select(F.col("id").alias("parent_id"), *[F.col(r).alias(f"up_{r}") for r in ranks])
        named = nodes.join(below.select("id"), "id", "left_semi").join(above, "parent_id")
        level = named.select("id", *[F.when(F.col("rank") == r, F.col("name")).otherwise(F.col(f"up_{r}")).alias(r) for r in ranks])
        out = out.unionByName(level)
    return out


def resolved(links: DataFrame, steps: int = STEPS) -> DataFrame:
    """id, target: the end of each chain of links (id, target), by doubling; null for chains that loop or exceed the steps. No forbidden branch to the resolved parent."""
    now, done = links.select("id", "target"), 1
    while done < steps:
        on = now.select(F.col("id").alias("target"), F.col("target").alias("next"))
        now = cut(now.join(on, "target", "left").select("id", F.coalesce("next", "target").alias("target")))
        done *= 2
    open_ = links.select(F.col("id").alias("target"), F.lit(True).alias("open"))
    return now.join(open_, "target", "left").select("id", F.when(F.col("open").isNull(), F.col("target")).alias("target"))
