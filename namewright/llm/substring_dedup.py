"""Substring dedup: near-duplicate paragraphs by MinHash banding, and repeated passages inside long ones.

Paragraphs are lines of at least MIN_WORDS words. Their shingle sketches are banded for high recall (20 bands of 4
registers miss a pair at similarity 0.8 with probability below 3e-5), colliding paragraphs are joined, links are
confirmed by exact Jaccard similarity on full shingle sets, and removals are clustered by connected components.

A passage may also sit inside a long paragraph whose rest differs, where no paragraph similarity shows it. So texts are
also cut into pieces at content-defined anchors: the words whose three-word hash is the smallest of a window of
WINDOW such hashes. Every stretch of 50 words that two texts share holds a whole piece of both, at the same place of the
stretch. Pieces that two documents or more hold are joined into runs; a run of at least RUN_WORDS such words is a
repeated passage. Pieces first seen here and pieces of earlier documents never share a run, and no words in between are
marked, so that only words which an earlier document holds are removed.

Whole pieces may add up to few words of a passage of just over 50. So each piece also has the hash of the RUN_WORDS words
from its start on. A shared stretch of WINDOW - 1 + RUN_WORDS = 44 words or more has its first anchor among its first
WINDOW words and thus holds such a sequence whole, of which the piece is the beginning: repeated sequences are looked for
among repeated pieces only, and none is missed. The edges of a passage outside its anchors (up to 19 words a side) stay.

Of each cluster or piece, the first document (smallest id, then place) keeps it.

Defined results: null or wordless texts and documents without id have no rows; repeated rows of an id are one document
whose paragraphs can link with one another; shorter paragraphs are left to line dedup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import AT_ONCE, grouped, hashed, heavy, powers, ready, released, sequences, stored
from .near_dedup import near_components

#: Words of a paragraph, and of a passage's repeated pieces; anchor window; words that a run may skip.
MIN_WORDS, RUN_WORDS, WINDOW, GAP = 50, 25, 20, 12
BANDS, ROWS = 20, 4


def pieces(h: np.ndarray, bounds: np.ndarray, known: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Text, start, length and hash of the pieces between anchors that tile texts of hashed words (bounds: words before each text, and all); hash of RUN_WORDS words from each start, and whether the text has so many."""
    n, here = np.diff(bounds), np.arange(len(h))
    cut = np.zeros(len(h), bool)
    cut[bounds[:-1][n > 0]] = True
    if len(h) > window + 2:
        low = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[2:] * np.uint64(0x165667B19E3779F9))
        low ^= low >> np.uint64(32)
        low *= np.uint64(0xD6E8FEB86659FD93)
        at, width = here[:-2], 1  # the first smallest of width hashes from each place on, and its place
        while width < window:
            step = min(width, window - width)
            less = low[step:] < low[:-step]
            low, at = np.where(less, low[step:], low[:-step]), np.where(less, at[step:], at[:-step])
            width += step
        last = np.repeat(np.where(n > window + 2, bounds[1:], 0), n)[: len(at)]
        cut[at[here[: len(at)] + window + 2 <= last]] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(h)))
    row = np.searchsorted(bounds, start, "right") - 1
    # no piece alone is a run, so 64 bits do
    key = sequences(h, start, start + length, known) + length.astype(np.uint64)
    long = sequences(h, start, np.minimum(start + RUN_WORDS, len(h)), known)
    return row, start - bounds[row], length, key.view(np.int64), long.view(np.int64), start + RUN_WORDS <= bounds[row + 1]


def _paragraphs(least: int):
    """Lines of at least so many words: the first word's number in the text, words, line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x, cut, start, _ in grouped(batch.column("text")):
                breaks = np.flatnonzero(x == ord("\n"))
                begin, end = np.sort(np.concatenate([cut[:-1], breaks + 1])), np.sort(np.concatenate([breaks, cut[1:]]))
                before = np.searchsorted(start, begin)
                n = np.searchsorted(start, end) - before
                if not len(some := np.flatnonzero(n >= max(least, 1))):
                    continue
                begin, end, before, n = begin[some], end[some], before[some], n[some]
                of = np.searchsorted(cut, begin, "right") - 1
                lines = pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)), pa.py_buffer(b"".join([x[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row + of)), pa.array(before - np.searchsorted(start, cut[of])), pa.array(n), lines], names=["doc_id", "start", "n_words", "text"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = powers(AT_ONCE // 2)
    for batch in batches:
        for row, h, bounds in hashed(batch.column("text")):
            if len(h):
                of, start, length, key, long, whole = pieces(h, bounds, known if len(h) <= len(known[0]) else powers(len(h)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row + of)), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(key), pa.array(long, mask=~whole)], names=["doc_id", "start", "n_words", "h1", "g"])


def similar_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, k: int = 5) -> DataFrame:
    """doc_id, start, n_words, component_id, first_doc, removed for paragraphs that have a near copy."""
    rows = docs.mapInArrow(_paragraphs(min_words), "doc_id long, start long, n_words long, text string")
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()), "paragraphs")  # written once, so ids stay
    found = near_components(rows.select("id", "text"), k, 80, 100, BANDS, ROWS).select("id", F.col("component").alias("c"))
    placed = stored(rows.select("id", "doc_id", "start", "n_words").join(found, "id").drop("id"), "placed")
    released(rows)
    first = placed.groupBy("c").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = placed.join(first, "c")
    at = near.where("doc_id = first_doc").groupBy("c").agg(F.min("start").alias("first_start"))
    near = near.join(at, "c")
    return near.select("doc_id", "start", "n_words", F.col("c").alias("component_id"), "first_doc", ((F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))).alias("removed"))


def _runs(spans: DataFrame, run_words: int) -> DataFrame:
    """doc_id, start, n_words, first_doc, removed: the words under spans (doc_id, start, n_words, first_doc), as stretches without gaps.

    Spans that an earlier document holds and those that the document keeps are runs apart; a run's stretches count if it
    has run_words words under spans.
    """
    own = ["doc_id", "removed"]
    placed = spans.select("doc_id", (F.col("first_doc") < F.col("doc_id")).alias("removed"), F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n_words")).cast("long").alias("end"), "first_doc")
    order = Window.partitionBy(*own).orderBy("start", "end")
    placed = placed.withColumn("upto", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce("upto", "start")), F.lit(0))
    breaks = lambda gap: F.sum(F.coalesce((F.col("start") > F.col("upto") + gap).cast("int"), F.lit(0))).over(order)
    placed = placed.withColumn("new", new).withColumn("run", breaks(GAP)).withColumn("stretch", breaks(0))
    stretches = placed.groupBy(*own, "run", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("new").alias("new"), F.min("first_doc").alias("first_doc"))
    words = F.sum("new").over(Window.partitionBy(*own, "run"))
    return stretches.withColumn("words", words).where(F.col("words") >= run_words).select("doc_id", "start", (F.col("end") - F.col("start")).alias("n_words"), "first_doc", "removed")


def repeated_passages(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, start, n_words, first_doc, removed (an earlier document holds all of its words) for stretches of repeated pieces.

    Pieces are shuffled once, by hash: sequences that are equal begin with equal pieces, so they meet there too. Pieces
    that are very common stay where they are; the documents that hold them first and last are sent to them.
    """
    rows = stored(docs.mapInArrow(_pieces, "doc_id long, start int, n_words int, h1 long, g long"), "pieces")
    piece, long = ["h1"], ["h1", "g"]
    ends = lambda *names: [f("doc_id").alias(n) for f, n in zip((F.min, F.max), names, strict=True)]
    over = lambda keys, *names: [f("doc_id").over(Window.partitionBy(*keys)).alias(n) for f, n in zip((F.min, F.max), names, strict=True)]
    many = heavy(rows, piece, *ends("first_doc", "last_doc"))
    light = rows.join(F.broadcast(many.select(*piece)), piece, "left_anti").select("*", *over(piece, "first_doc", "last_doc")).where("first_doc < last_doc")
    light = light.select("*", *over(long, "long_first", "long_last"))
    common = stored(rows.join(F.broadcast(many.where("first_doc < last_doc")), piece), "common")
    whole = common.where("g is not null")
    many_long = heavy(whole, long, *ends("long_first", "long_last"))
    found = light.unionByName(whole.join(F.broadcast(many_long.select(*long)), long, "left_anti").select("*", *over(long, "long_first", "long_last")))
    found = found.unionByName(whole.join(F.broadcast(many_long), long)).unionByName(common.where("g is null"), allowMissingColumns=True)
    # a repeated sequence covers its piece; where the document keeps the one and not the other, both count
    repeated = F.coalesce(F.col("g").isNotNull() & (F.col("long_first") < F.col("long_last")), F.lit(False))
    one = F.struct("n_words", "first_doc")
    both = F.struct(F.lit(RUN_WORDS).alias("n_words"), "first_doc"), F.struct(F.lit(RUN_WORDS).alias("n_words"), F.col("long_first").alias("first_doc"))
    same = (F.col("first_doc") < F.col("doc_id")) == (F.col("long_first") < F.col("doc_id"))
    spans = F.when(~repeated, F.array(one)).when(same, F.array(both[0])).otherwise(F.array(one, both[1]))
    seen = stored(found.select("doc_id", "start", F.inline(spans)), "seen")
    released(rows, common, many, many_long)
    return _runs(seen, run_words)


def find_repeats(docs: DataFrame) -> DataFrame:
    """Rows for every near-duplicate paragraph and repeated passage of docs (doc_id, text); removed: another place keeps it."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    a = similar_paragraphs(docs).select("doc_id", F.lit("paragraph").alias("kind"), "start", "n_words", "component_id", "first_doc", "removed")
    b = repeated_passages(docs).select("doc_id", F.lit("passage").alias("kind"), "start", "n_words", F.col("first_doc").alias("component_id"), "first_doc", "removed")
    return a.unionByName(b)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without the removed spans; what stays of a text is joined by single spaces if anything is removed."""
    spans = find_repeats(docs).where("removed").groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words")).alias("__spans")).withColumnRenamed("doc_id", "__of")
    words = F.split(F.trim(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+", " ")), " ")
    kept = F.filter(words, lambda _, i: ~F.exists(F.col("__spans"), lambda s: (i >= s["start"]) & (i < s["start"] + s["n_words"])))
    out = docs.join(spans, docs["doc_id"].cast("long") == spans["__of"], "left")
    return out.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(kept, " "))).select(docs.columns)
