"""Delimited inputs, read by Spark: blank cells are null, required columns are checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions.names import blank_to_null


def read_delimited(spark: SparkSession, path: str, sep: str = ",", required: Sequence[str] = ()) -> DataFrame:
    """All columns as trimmed text, blank as null; ValueError names required columns that are missing."""
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df.select([blank_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])


def priorities(rows: DataFrame) -> DataFrame:
    """key, priority for rows (key, value): a value that is no number counts as 1.0."""
    return rows.select("key", F.coalesce(F.col("value").try_cast("double"), F.lit(1.0)).alias("priority"))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that repeat a key, the one with the highest order, by partial maxima."""
    rest = [c for c in rows.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select(key, "r.*")
