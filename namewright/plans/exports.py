"""Queries of exports, set operations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions.similarity import edit_similarity
from namewright.plans.queries import _table, query


@query("""SELECT event_type AS code, count(*) AS n FROM events GROUP BY event_type""")
def agg_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, SNK-07: events by code."""
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"))


@query("""SELECT p_brand AS provider, greatest(0.25, max(p_size) * 2.0 / (SELECT max(p_size) FROM part)) AS boost,
  CAST(round(greatest(0.25, max(p_size) * 2.0 / (SELECT max(p_size) FROM part)) * 1000) AS BIGINT) AS priority FROM part GROUP BY p_brand""")
def agg_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, IDX-05: scores on the scale of the highest one."""
    p = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("provider")).agg(F.max("p_size").alias("m"))
    boost = F.greatest(F.lit(0.25), F.col("m") * 2.0 / F.col("top"))
    # one row of one number: the only table that a cross join may take here
    return p.crossJoin(F.broadcast(p.agg(F.max("m").alias("top")))).select("provider", boost.alias("boost"), F.round(boost * 1000).cast("long").alias("priority"))


@query("""SELECT p_brand AS id, list_sort(list(DISTINCT p_name)) AS names, coalesce(max(p_size) FILTER (WHERE p_type = 'PROMO'), 1) AS priority FROM part GROUP BY p_brand""")
def agg_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-02, JN-15: a taxon's variant names and their highest priority."""
    p = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id"))
    return p.agg(F.array_sort(F.collect_set("p_name")).alias("names"), F.coalesce(F.max(F.when(F.col("p_type") == "PROMO", F.col("p_size"))), F.lit(1)).alias("priority"))


@query("""SELECT id, identifier FROM (SELECT p_partkey AS id, 'a' || p_partkey AS identifier FROM part UNION ALL SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, 'a' || p_partkey FROM part WHERE p_size > 20) GROUP BY ALL""")
def set_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02, SET-05, SNK-04: supplied and derived identifiers without repeats."""
    own = F.concat(F.lit("a"), F.col("p_partkey").cast("string"))
    cols = F.array_distinct(F.array(own, F.col("p_brand"), F.when(F.col("p_size") > 20, own).otherwise(own)))
    # ids are unique, so what repeats is in one row: no shuffle
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(cols).alias("identifier"))


@query("""SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier""")
def set_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01, SET-03."""
    c = _table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = _table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier""")
def set_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-07: sources that nothing uses."""
    s = _table(spark, sf_dir, "supplier")
    return _table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_nationkey").distinct()


@query("""SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1""")
def sql_homonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL-14."""
    return _table(spark, sf_dir, "part").groupBy("p_name").count().where("count > 1").select("p_name")


@query("""SELECT DISTINCT n_name, c_mktsegment, CASE WHEN r_name = 'ASIA' THEN 1 ELSE 0 END AS flag FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 0""")
def sql_common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL-13."""
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    few = c.where("c_mktsegment = 'BUILDING' or c_acctbal > 0").select("c_nationkey", "c_mktsegment").distinct()
    return few.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "c_mktsegment", F.when(F.col("r_name") == "ASIA", 1).otherwise(0).alias("flag")).distinct()


@query("""SELECT n_nationkey, CASE WHEN upper(r_name) LIKE '%AMERICA%' THEN '' ELSE r_name END AS family FROM nation JOIN region ON n_regionkey = r_regionkey""")
def sql_genus_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL-15."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.when(F.upper("r_name").contains("AMERICA"), "").otherwise(F.col("r_name")).alias("family"))


@query("""SELECT r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey NOT IN (1, 9) UNION ALL VALUES (1, 'new'), (9, 'added')""")
def sql_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL-16, SNK-15: rows replaced by key and added."""
    new = spark.createDataFrame([(1, "new"), (9, "added")], "id int, name string")
    old = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name"))
    return old.join(new, "id", "left_anti").unionByName(new)


@query("""SELECT a.p_partkey AS id, b.p_partkey AS other, round(1 - levenshtein(a.p_name, b.p_name) / greatest(len(a.p_name), len(b.p_name)), 4) AS alike FROM part a JOIN part b
  ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND left(a.p_name, 2) = left(b.p_name, 2) AND a.p_partkey < b.p_partkey AND a.p_name <> b.p_name""")
def sql_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL-09, SQL-10, SQL-11: pairs of unlike names under one key; names are paired once, then their rows."""
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", F.substring("p_name", 1, 2).alias("k"))
    a, b = p.alias("a"), p.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("p_brand", "p_type", "k")]
    pairs = a.join(b, on[0] & on[1] & on[2] & (F.col("a.id") < F.col("b.id")) & (F.col("a.p_name") != F.col("b.p_name")))
    return pairs.select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.round(edit_similarity(F.col("a.p_name"), F.col("b.p_name")), 4).alias("alike"))


@query("""SELECT c.c_custkey AS id, replace(replace(c_name, '#', ''), '0', 'o') AS name, coalesce(s_name, '') AS other, CASE WHEN s_suppkey IS NULL THEN 'accepted' ELSE 'synonym' END AS status
  FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON c_custkey = s_suppkey AND c_nationkey <> s_nationkey""")
def sql_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL-12, SQL-17."""
    c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    both = c.join(s, (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") != F.col("s_nationkey")), "left")
    name = F.replace(F.replace("c_name", F.lit("#"), F.lit("")), F.lit("0"), F.lit("o"))
    return both.select(F.col("c_custkey").alias("id"), name.alias("name"), F.coalesce("s_name", F.lit("")).alias("other"), F.when(F.col("s_suppkey").isNull(), "accepted").otherwise("synonym").alias("status"))
