"""Line dedup by distinct-site spread, in DataFrame functions only.

A line's key is its text trimmed and lower-cased. HyperLogLog sketches of the sites (sources) that show a line are made
per line hash and merged by aggregation. Lines whose estimate is clearly below the threshold stay, those clearly above
are boilerplate, and those near it get exact distinct counts. Boilerplate is removed from every document but the one
with the smallest id that shows it, so that no line leaves the corpus altogether.

Two aggregations come before the sketches: a line's smallest and largest site (one site cannot reach the threshold) and
the sites per line, combined before the shuffle. Only line numbers to be removed return to the documents; texts move
once. Hot lines are partial sums before they are shuffled, and joins on them are plain sort-merge joins, which adaptive
execution splits.

Defined results: a null text stays null with no lines; lines are those between line feeds, so an empty text has one
empty line; lines of fewer than min_words words are never boilerplate, nor blank ones if min_words is 1; null sites count as one site of their own;
repeated rows of an id are treated alike, each keeping the lines that its id keeps. A line repeated within its keeping
document stays there. Rows without id keep all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Sites that make a line boilerplate, words that it has at least, sketch size, and the share around the threshold counted exactly.
MIN_SITES, MIN_WORDS, LG_K, NEAR = 5, 4, 10, 0.25


def line_key(line: Column) -> Column:
    return F.lower(F.trim(line))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, keeper) of boilerplate lines and (doc_id, pos, h1, h2) of all lines long enough; docs: doc_id, text, site."""
    lines = docs.where("doc_id is not null").select("doc_id", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", line_key(F.col("line")))
    lines = lines.where(F.size(F.split("line", " +", -1)) >= min_words)
    if min_words < 2:
        lines = lines.where(F.col("line").rlike(r"\S"))
    lines = lines.select("doc_id", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2"), F.xxhash64(F.coalesce("site", F.lit("\0"))).alias("site"))
    lines = stored(lines, "lines")
    key = ["h1", "h2"]
    ends = lines.groupBy(*key).agg(F.min("site").alias("a"), F.max("site").alias("b"), F.min("doc_id").alias("keeper")).where("a < b" if min_sites > 1 else "true").select(*key, "keeper")
    spread = stored(lines.join(ends, key).groupBy(*key, "site").agg(F.min("keeper").alias("keeper")), "spread")
    sketched = spread.groupBy(*key).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("keeper").alias("keeper")).withColumn("estimate", F.hll_sketch_estimate("sketch"))
    sketched = stored(sketched.where(F.col("estimate") >= min_sites * (1 - NEAR)).select(*key, "keeper", "estimate"), "sketched")
    near = sketched.where(F.col("estimate") <= min_sites * (1 + NEAR)).select(*key, "keeper")
    exact = spread.select(*key, "site").join(near, key).groupBy(*key).agg(F.countDistinct("site").alias("n"), F.min("keeper").alias("keeper")).where(F.col("n") >= min_sites)
    sure = sketched.where(F.col("estimate") > min_sites * (1 + NEAR)).select(*key, "keeper")
    return exact.select(*key, "keeper").unionByName(sure), lines


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text, site and any other columns) with boilerplate lines removed; n_lines and n_removed are appended."""
    bad, lines = boilerplate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(site).cast("string").alias("site")), min_sites, min_words)
    gone = lines.join(bad, ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    own = docs.columns
    to = lambda name: name if name not in own else to(name + "_")
    at, n, k = to("__gone"), to("n_lines"), to("n_removed")
    gone = gone.withColumnRenamed("gone", at).withColumnRenamed("doc_id", "__of")
    out = docs.join(gone, docs["doc_id"].cast("long") == gone["__of"], "left").drop("__of")
    parts = F.split(F.col("text").cast("string"), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(at), i)), "\n")
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(kept).alias("text")
    return out.select(*[text if c == "text" else F.col(f"`{c}`") for c in own], F.coalesce(F.size(parts), F.lit(0)).cast("long").alias(n), F.coalesce(F.array_size(at), F.lit(0)).cast("long").alias(k))


#: The rows of op3 in SQL: exact counts of distinct sites.
SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), keyed AS (
  SELECT doc_id, source, raw, pos, lower(trim(raw)) AS line FROM lines
), spread AS (
  SELECT line, min(doc_id) AS keeper FROM keyed
  WHERE len(string_split_regex(line, ' +')) >= {MIN_WORDS}
  GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= {MIN_SITES}
), marked AS (
  SELECT k.doc_id, k.raw, k.pos, s.line IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN spread s ON k.line = s.line
), texts AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, t.text, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id
"""
