"""Names that arrive as a stream, matched against taxa as they stand; changes applied to a table of taxa batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_stream(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """names (name, any other columns; a stream) with the id of the taxon of that name, case aside, null if none.

    A stream-static join: no state is kept, so any number of names may arrive. A name of several taxa takes the one with
    the highest priority, then the smallest id. taxa: id, name, priority.
    """
    one = taxa.groupBy(F.lower("name").alias("__key")).agg(F.max_by("id", F.struct("priority", -F.col("id"))).alias("matched_id"))
    return names.join(one, F.lower("name") == F.col("__key"), "left").drop("__key")


def changed(taxa: DataFrame, changes: DataFrame) -> DataFrame:
    """taxa (id, accepted_id, ...) after changes (the same columns and op): rows of `add` replace and add, `delete` also takes rows accepted as the id."""
    gone = changes.where("op = 'delete'").select("id").distinct()
    new = changes.where("op = 'add'").drop("op")
    left = taxa.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "accepted_id"), "accepted_id", "left_anti").join(new.select("id"), "id", "left_anti")
    return left.select(taxa.columns).unionByName(new.select(taxa.columns))
