"""A corpus pipeline over the table documents: quality, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a DataFrame that run()
writes as Parquet to the shared folder and reads again as the next one's docs. All stages but the last return the
columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import stored, table
from namewright.llm.line_dedup import dedup_lines
from namewright.llm.near_dedup import near_dedup
from namewright.llm.packing import pack
from namewright.llm.pii import mask_pii
from namewright.llm.quality import ACCEPTED, score, train


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels and the texts of docs alone."""
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= ACCEPTED).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines of any length that another document keeps."""
    return _sized(dedup_lines(docs, min_words=1).select(docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows that repeat an id with the same text are one document; rows without id are kept.
    """
    found = stored(near_dedup(docs), "kept").where("doc_id is not null")
    # written, so that its size is known: Spark sends the removed ids to the texts while they are small, and shuffles the texts beyond that
    removed = stored(found.groupBy("doc_id").agg(F.bool_or("kept").alias("any"), F.count("*").alias("n")).where("not any or n > 1"), "removed")
    kept = docs.join(removed.where("not any").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    if not removed.where("n > 1").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
    return kept


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return _sized(mask_pii(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents."""
    return pack(docs)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_stage), ("PII", pii_stage), ("packing", pack_stage)]

#: The classifier, the field and the tokenizer can't be said in SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
