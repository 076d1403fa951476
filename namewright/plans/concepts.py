"""Queries of spelling reports, inherited scores and least upper bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions import names as N
from namewright.operators import concepts as C
from namewright.plans.queries import _TREE, _table, _tree, query

_LEAD = [("Æ", "E"), *[r for r in N.LEADING if r[0] != "MC"], ("X", "Z")]


def _key_sql(x: str) -> str:
    lead = " ".join(f"WHEN starts_with(upper({x}), '{old}') THEN '{new}' || substr(upper({x}), {len(old) + 1})" for old, new in _LEAD)
    tail = "substr(led, 2)"
    for old, new in N.SPELLING_TAIL:
        tail = f"replace({tail}, '{old}', '{new}')"
    squeeze = "array_to_string(list_transform(list_filter(range(1, length(said) + 1), lambda i: i = 1 OR said[i] <> said[i - 1]), lambda i: said[i]), '')"
    word = "w[1] || array_to_string(list_sort(list_transform(range(2, length(w) + 1), lambda i: w[i])), '')"
    words = f"array_to_string(list_transform(list_filter(string_split({squeeze}, ' '), lambda w: w <> ''), lambda w: {word}), ' ')"
    return f"(SELECT {words} FROM (SELECT substr(led, 1, 1) || {tail} AS said FROM (SELECT CASE {lead} ELSE upper({x}) END AS led)))"


@query(f"SELECT p_partkey AS id, {_key_sql('p_name')} AS key, {_key_sql('p_type')} AS type_key FROM part")
def fn_spelling_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-07."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.spelling_key(F.col("p_name")).alias("key"), N.spelling_key(F.col("p_type")).alias("type_key"))


@query(f"""WITH named AS (SELECT p_brand AS parent, {_key_sql('p_name')} AS key, p_name AS name, p_type AS provider, CASE WHEN p_size > 40 THEN 'B' ELSE 'A' END AS code FROM part)
SELECT parent, key, count(*) AS n, CASE WHEN count(DISTINCT code) > 1 THEN 'crossCode' WHEN count(DISTINCT provider) = 1 THEN 'internal' WHEN count(DISTINCT name) = 1 THEN 'authorship' ELSE 'spelling' END AS kind,
  CASE WHEN count(DISTINCT name) = 1 OR count(DISTINCT provider) = 1 THEN 'NOTE' ELSE 'COLLISION' END AS issue FROM named GROUP BY parent, key HAVING count(*) > 1""")
def agg_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04."""
    part = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("parent"), F.col("p_name").alias("name"), F.col("p_type").alias("provider"), F.when(F.col("p_size") > 40, "B").otherwise("A").alias("code"))
    return C.spelling_collisions(part)


_SCORED = f"""{_TREE}, scored AS (SELECT id, parent_id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 4 = 3 AND id[1] = 's' THEN 'B' ELSE 'A' END AS provider,
  CASE WHEN id[1] = 'n' AND CAST(substr(id, 2) AS BIGINT) % 5 = 0 THEN 200 WHEN id[1] = 'r' AND id LIKE '%1' THEN 2000000 END AS specific,
  CASE WHEN CAST(substr(id, 2) AS BIGINT) % 4 = 3 AND id[1] = 's' THEN 80 ELSE 100 END AS dflt FROM tree)"""


@query(f"""WITH RECURSIVE {_SCORED}, up(id, above, provider, found) AS (
  SELECT id, parent_id, provider, specific FROM scored
  UNION ALL SELECT u.id, s.parent_id, u.provider, s.specific FROM up u JOIN scored s ON u.above = s.id AND u.provider = s.provider WHERE u.found IS NULL
), best AS (SELECT id, max(found) AS found FROM up GROUP BY id)
SELECT s.id, coalesce(s.specific, least(greatest(coalesce(b.found, s.dflt), -1000000), 1000000)) AS score FROM scored s JOIN best b ON s.id = b.id""")
def tree_inherited_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TREE-11."""
    mark, number = F.substring("id", 1, 1), F.substring("id", 2, 20).cast("long")
    other = (number % 4 == 3) & (mark == "s")
    nodes = _tree(spark, sf_dir).select(
        "id", "parent_id", F.when(other, "B").otherwise("A").alias("provider"),
        F.when((mark == "n") & (number % 5 == 0), 200).when((mark == "r") & F.col("id").endswith("1"), 2_000_000).alias("specific"),
        F.when(other, 80).otherwise(100).alias("default"),
    )
    return C.inherited_scores(nodes)


@query(f"""WITH RECURSIVE {_TREE}, numbered AS (SELECT id, parent_id, CAST(substr(id, 2) AS BIGINT) AS k FROM tree
), taxa AS (SELECT t.id, t.parent_id, a.id AS accepted_id, t.id AS concept FROM numbered t LEFT JOIN numbered a ON t.id[1] = 's' AND t.k % 7 = 0 AND a.id = 's' || lpad(CAST(t.k - 1 AS VARCHAR), 12, '0')
), pairs AS (SELECT a.id AS a, b.id AS b FROM numbered a LEFT JOIN numbered b ON b.id = 's' || lpad(CAST(a.k + 10 AS VARCHAR), 12, '0') WHERE a.id[1] = 's'
), one(start, depth, own) AS (SELECT DISTINCT a, 0, a FROM pairs UNION ALL SELECT o.start, o.depth + 1, t.parent_id FROM one o JOIN taxa t ON o.own = t.id WHERE t.parent_id IS NOT NULL
), first AS (SELECT o.start, o.depth, r.id AS node, r.concept FROM one o JOIN taxa t ON o.own = t.id JOIN taxa r ON r.id = coalesce(t.accepted_id, t.id)
), two(start, node) AS (SELECT DISTINCT p.b, coalesce(t.accepted_id, t.id) FROM pairs p JOIN taxa t ON p.b = t.id
  UNION ALL SELECT w.start, coalesce(u.accepted_id, u.id) FROM two w JOIN taxa t ON w.node = t.id JOIN taxa u ON t.parent_id = u.id
), met AS (SELECT p.a, p.b, arg_min(f.node, f.depth) AS lub FROM pairs p JOIN first f ON f.start = p.a JOIN two w ON w.start = p.b JOIN taxa c ON c.id = w.node AND c.concept = f.concept GROUP BY p.a, p.b)
SELECT p.a, p.b, m.lub FROM pairs p LEFT JOIN met m ON p.a = m.a AND p.b = m.b""")
def tree_least_upper_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TREE-10, for pairs; a customer and the one ten numbers on, each seventh a synonym of the one before."""
    pad = lambda col: F.concat(F.lit("s"), F.lpad(col.cast("string"), 12, "0"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    known = c.select(pad(F.col("k")).alias("accepted_id"))
    tree = _tree(spark, sf_dir)
    number = F.substring("id", 2, 20).cast("long")
    wanted = F.when(F.col("id").startswith("s") & (number % 7 == 0), pad(number - 1))
    taxa = tree.withColumn("accepted_id", wanted).join(known.withColumn("known", F.lit(True)), "accepted_id", "left")
    taxa = taxa.select("id", "parent_id", F.when(F.col("known"), F.col("accepted_id")).alias("accepted_id"), F.col("id").alias("concept"))
    pairs = c.select(pad(F.col("k")).alias("a"), pad(F.col("k") + 10).alias("b")).join(known.select(F.col("accepted_id").alias("b"), F.lit(True).alias("known")), "b", "left")
    return C.least_upper_bounds(pairs.select("a", F.when(F.col("known"), F.col("b")).alias("b")), taxa)
