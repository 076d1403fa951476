"""Queries of the merge operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.operators import merge as M
from namewright.plans.queries import _table, query


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("provider"), F.col("p_type").alias("status"), F.col("p_size").alias("rank_id"))


@query("""SELECT 'bare' AS level, count(DISTINCT p_name) AS n_keys, count(*) AS n_rows FROM part UNION ALL SELECT 'unranked', (SELECT count(*) FROM (SELECT DISTINCT p_name, p_type FROM part)), count(*) FROM part
  UNION ALL SELECT 'scientific', (SELECT count(*) FROM (SELECT DISTINCT p_name, p_type, p_brand FROM part)), count(*) FROM part
  UNION ALL SELECT 'concept', (SELECT count(*) FROM (SELECT DISTINCT p_name, p_type, p_brand, p_size FROM part)), count(*) FROM part""")
def agg_key_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, LTC-02, LTC-03."""
    return M.key_levels(_part(spark, sf_dir).select("name", F.col("status").alias("code"), F.col("provider").alias("author"), F.col("rank_id").alias("rank")))


@query("""SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'VIRUS' WHEN p_size < 10 THEN 'FAMILY' ELSE p_name END AS key,
  CASE WHEN p_partkey % 50 = 0 THEN 1000000 WHEN p_type = 'SMALL' THEN -1000000 ELSE 100 + CASE WHEN p_size > 20 THEN 50 ELSE 0 END + CASE WHEN p_brand < 'Brand#3' THEN -30 ELSE 0 END END AS score FROM part""")
def ltc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LTC-05, LTC-06: key rules in sequence, score adjustments and bounds."""
    key = M.adjusted(F.col("name"), [(F.col("rank_id") < 10, F.lit("FAMILY")), (F.col("status") == "PROMO", F.lit("VIRUS"))])
    score = M.score(F.lit(100), [(F.col("rank_id") > 20, 50), (F.col("provider") < "Brand#3", -30)], F.col("id") % 50 == 0, F.col("status") == "SMALL")
    return _part(spark, sf_dir).select("id", key.alias("key"), score.alias("score"))


@query("""SELECT p_name AS taxon_id, p_partkey AS id, CASE WHEN rn = 1 THEN p_name ELSE p_name || '#' || rn END AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)""")
def ltc_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LTC-01, in part: repeated ids get new ones, the same in every run."""
    return M.unique_ids(_part(spark, sf_dir).select(F.col("name").alias("taxon_id"), "id"), "taxon_id", "id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 THEN 'inferredAccepted' WHEN o_orderstatus = 'F' THEN 'synonym' ELSE 'accepted' END AS status FROM orders""")
def ltc_inferred_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LTC-20."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "synonym").otherwise("accepted")
    return _table(spark, sf_dir, "orders").select(k.alias("id"), M.inferred_status(status, F.when(k % 3 > 0, k), F.when(k % 2 > 0, k)).alias("status"))


@query("""SELECT key, arg_min(id, rn) AS principal FROM (SELECT p_name AS key, p_partkey AS id, row_number() OVER (PARTITION BY p_name ORDER BY p_size > 20 DESC, p_size DESC, p_type <> 'SMALL' DESC, p_partkey) AS rn FROM part) GROUP BY key""")
def rnk_name_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-05, RNK-06, RNK-07, LTC-12."""
    rows = _part(spark, sf_dir).select(F.col("name").alias("key"), "id", F.col("rank_id").alias("score"), F.when(F.col("status") != "SMALL", F.col("status")).alias("author"))
    return M.principal(rows, "key", 20)


@query("""WITH w AS (SELECT DISTINCT p_name AS key, 25 AS rank_id FROM part)
SELECT w.key, w.rank_id, arg_min(p_partkey, (abs(p_size - 25), -p_retailprice, p_partkey)) AS id FROM w JOIN part ON p_name = w.key GROUP BY w.key, w.rank_id""")
def rnk_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-08, LTC-11 in part."""
    p = _table(spark, sf_dir, "part")
    wanted = p.select(F.col("p_name").alias("key"), F.lit(25).alias("rank_id")).distinct()
    return M.nearest_rank(wanted, p.select(F.col("p_name").alias("key"), F.col("p_partkey").alias("id"), F.col("p_size").alias("rank_id"), F.col("p_retailprice").alias("score")))


@query("""WITH r AS (SELECT p_partkey AS id, p_brand AS provider, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 3 END AS parent_id, CASE WHEN p_partkey % 3 = 1 THEN p_name END AS parent_name FROM part)
SELECT r.id, coalesce(a.id, b.id, -1) AS parent FROM r LEFT JOIN r a ON r.parent_id = a.id LEFT JOIN (SELECT provider, name, min(id) AS id FROM r GROUP BY ALL) b ON r.provider = b.provider AND r.parent_name = b.name""")
def jn_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-17 (no classification branch), JN-18, LTC-08."""
    k = F.col("id") % 3
    rows = _part(spark, sf_dir).select("id", "provider", "name", F.when(k == 0, F.expr("id div 3")).alias("parent_id"), F.when(k == 1, F.col("name")).alias("parent_name"))
    return M.links(rows, -1).select("id", "parent")


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent_id, p_type = 'PROMO' AS forbidden FROM part),
  w(id, pos, k) AS (SELECT id, parent_id, 0 FROM r UNION ALL SELECT w.id, r.parent_id, k + 1 FROM w JOIN r ON w.pos = r.id WHERE r.forbidden)
SELECT id, arg_max(coalesce(pos, -1), k) AS parent FROM w GROUP BY id""")
def tree_past_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TREE-06."""
    rows = _part(spark, sf_dir).select("id", F.when(F.col("id") > 1, F.expr("id div 2")).alias("parent_id"), (F.col("status") == "PROMO").alias("forbidden"))
    return M.past_forbidden(rows, 16).select("id", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS id, (n_nationkey * n_nationkey + 1) % 25 AS target FROM nation),
  w(id, pos, low, k) AS (SELECT id, target, least(id, target), 1 FROM e UNION ALL SELECT w.id, e.target, least(low, e.target), k + 1 FROM w JOIN e ON w.pos = e.id WHERE k < 25),
  m AS (SELECT id, min(low) AS cycle FROM w WHERE w.id IN (SELECT x.id FROM w x WHERE x.id = x.pos) GROUP BY id)
SELECT cycle, arg_min(id, (id * 7 % 5, id)) AS id FROM m GROUP BY cycle""")
def tree_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TREE-07, RNK-11: loops of links and where they are broken."""
    n = F.col("n_nationkey").cast("long")
    edges = _table(spark, sf_dir, "nation").select(n.alias("id"), ((n * n + 1) % 25).alias("target"))
    return M.break_points(M.cycles(edges, 32).withColumn("score", F.col("id") * 7 % 5))


@query("""SELECT c_custkey AS id, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey // 2) THEN c_custkey // 2 ELSE -1 END AS parent FROM customer""")
def tree_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TREE-09, LTC-07: rows whose parent is missing go under the unknown taxon."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey div 2").alias("parent_id"))
    return M.placed_under(rows, _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), -1)


@query("""SELECT p_partkey AS id, p_partkey // 2 AS target, CASE p_type WHEN 'PROMO' THEN 'discarded' ELSE 'inferredSynonym' END AS becomes FROM part WHERE p_type IN ('PROMO', 'LARGE') AND p_partkey % 5 > 0""")
def ltc_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LTC-17."""
    strategy = F.when(F.col("status") == "PROMO", "IDENTIFIER_TO_PARENT").when(F.col("status") == "LARGE", "SYNONYMISE_TO_PARENT").otherwise("IGNORE")
    return M.discarded(_part(spark, sf_dir).select("id", F.when(F.col("id") % 5 > 0, F.expr("id div 2")).alias("parent_id"), strategy.alias("strategy")))


@query("""SELECT 'noParent' AS code, p_partkey AS id, p_name || ' (' || p_partkey || ') has no parent' AS message FROM part WHERE p_partkey % 7 = 0
  UNION ALL SELECT 'synonymWithParent', p_partkey, p_name || ' (' || p_partkey || ') is a synonym with a parent' FROM part WHERE p_type = 'SMALL' AND p_partkey % 7 > 0""")
def ltc_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-11 (two of its rules), LTC-21, LTC-22."""
    none = F.col("id") % 7 == 0
    return M.issues(_part(spark, sf_dir), [("noParent", "%s (%d) has no parent", none), ("synonymWithParent", "%s (%d) is a synonym with a parent", (F.col("status") == "SMALL") & ~none)])


@query("""WITH p AS (SELECT DISTINCT s_nationkey % 3 AS taxon, 'n' || s_nationkey AS location FROM supplier UNION SELECT 1, 'r' || r_regionkey FROM region WHERE r_regionkey < 3)
SELECT taxon, location FROM p WHERE NOT EXISTS (SELECT 1 FROM p q JOIN nation ON q.location = 'r' || n_regionkey WHERE q.taxon = p.taxon AND p.location = 'n' || n_nationkey)""")
def ltc_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LTC-18, JN-21: places that another place of the taxon holds go."""
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    name = lambda mark, col: F.concat(F.lit(mark), F.col(col).cast("string"))
    places = s.select((F.col("s_nationkey") % 3).alias("taxon"), name("n", "s_nationkey").alias("location")).unionByName(r.where("r_regionkey < 3").select(F.lit(1).alias("taxon"), name("r", "r_regionkey").alias("location"))).distinct()
    return M.uncovered(places, n.select(name("n", "n_nationkey").alias("location"), name("r", "n_regionkey").alias("ancestor")))
