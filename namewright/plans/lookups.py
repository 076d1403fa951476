"""Queries of name functions, similarities and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions import names as N
from namewright.functions import similarity as S
from namewright.operators import lookup as L
from namewright.plans.queries import _SQUEEZE, _table, query


def _sql_ngram(a: str, b: str, n: int) -> str:
    pad = " " * (n - 1)
    grams = lambda x: f"list_transform(range(1, greatest(len({x}) + {n}, 2)), lambda i: substr('{pad}' || {x} || '{pad}', i, {n}))"
    numbered = lambda x: f"(SELECT list_transform(g, lambda e, i: e || len(list_filter(g[1:i], lambda h: h = e))) FROM (SELECT {grams(x)} AS g))"
    return f"round(2.0 * len(list_intersect({numbered(a)}, {numbered(b)})) / (len({a}) + len({b}) + {2 * (n - 1)}), 4)"


@query(f"""SELECT p_partkey, {_sql_ngram("upper(p_name)", "upper(p_type)", 2)} AS bigram, {_sql_ngram("upper(p_name)", "upper(p_type)", 3)} AS trigram,
  round(1 - levenshtein(upper(p_name), upper(p_type)) / greatest(len(p_name), len(p_type)), 6) AS edit FROM part""")
def fn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL-01, SIM-03."""
    a, b = F.upper("p_name"), F.upper("p_type")
    return _table(spark, sf_dir, "part").select("p_partkey", S.ngram_similarity(a, b, 2).alias("bigram"), S.ngram_similarity(a, b, 3).alias("trigram"), F.round(S.edit_similarity(a, b), 6).alias("edit"))


@query("""SELECT c_custkey, CAST(CASE WHEN n_name IS NULL THEN NULL WHEN c_mktsegment = '' THEN 0.5 WHEN lower(c_mktsegment) = 'building' THEN 1.0 ELSE 0.25 END AS DOUBLE) AS term,
  CAST(CASE WHEN starts_with(n_name, 'IN') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(n_name, ' IN') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(n_name, 'IN') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS points
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def fn_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM-04 (with a constant in place of the similarity of unlike terms), SIM-05."""
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    term = F.when(F.col("n_name").isNotNull(), S.term_ladder(F.lit("building"), F.col("c_mktsegment"), F.lit(0.25)))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", term.alias("term"), S.wildcard_score(F.col("n_name"), F.lit("IN")).alias("points"))


@query("""WITH e AS (SELECT p_partkey, split_part(p_name, ' ', 1) || CASE p_size % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'um' ELSE 'a' END AS x FROM part)
SELECT p_partkey, CASE WHEN x LIKE '%us' THEN regexp_replace(x, '[us]+$', '') || 'a' WHEN x LIKE '%um' THEN regexp_replace(x, '[um]+$', '') || 'a' ELSE x END AS neutral FROM e""")
def fn_gender_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL-02, SQL-05."""
    k = F.col("p_size") % 3
    x = F.concat(N.normalise_spaces(F.get(F.split("p_name", " "), F.lit(0))), F.when(k == 0, "us").when(k == 1, "um").otherwise("a"))
    return _table(spark, sf_dir, "part").select("p_partkey", S.gender_neutral(x).alias("neutral"))


def _sql_near(x: str, epithet: bool) -> str:
    lead = " ".join(f"WHEN starts_with(w, '{a}') THEN '{b}' || substr(w, {len(a) + 1})" for a, b in [("PH", "F"), *N.LEADING, ("X", "Z")])
    rest = "substr(y, 2)"
    for a, b in S.DIGRAPHS:
        rest = f"replace({rest}, '{a}', '{b}')"
    rest = f"translate({rest}, '{S.LETTERS}', '{S.INSTEAD}')"
    key = _SQUEEZE.replace("(x,", f"(substr(y, 1, 1) || {rest},")
    end = "CASE WHEN len(k) > 4 THEN regexp_replace(k, '(IS|IM|AS)$', 'A') ELSE k END" if epithet else "k"
    return f"(SELECT {end} FROM (SELECT {key} AS k FROM (SELECT CASE {lead} ELSE w END AS y FROM (SELECT {x} AS w))))"


@query(f"SELECT p_partkey, {_sql_near('''upper(split_part(p_name, ' ', 1))''', False)} AS genus, {_sql_near('''upper(split_part(p_name, ' ', 2))''', True)} AS epithet FROM part")
def fn_near_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL-06."""
    word = F.split(F.upper("p_name"), " ")
    return _table(spark, sf_dir, "part").select("p_partkey", S.near_match(F.get(word, F.lit(0))).alias("genus"), S.near_match(F.get(word, F.lit(1)), True).alias("epithet"))


@query(r"""SELECT s_suppkey, trim(regexp_replace('Mount ' || s_name || ' and ''Stn'' Road', '&|\bAND\b|\band\b|\bStn\b|\bStation\b|\bMt\b|\bMount\b|[''"]', '', 'g').regexp_replace(' +', ' ', 'g')) AS phrase,
  'Baeckea' AS genus, 'Road ' || s_name AS named, 'S.Patrick ' || s_suppkey AS voucher FROM supplier""")
def fn_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-13, FN-15 without commentary and source."""
    s = _table(spark, sf_dir, "supplier")
    parts = N.phrase_parts(F.concat(F.lit("Baeckea sp. Road "), "s_name", F.lit(" (S.Patrick "), F.col("s_suppkey").cast("string"), F.lit(")")))
    phrase = N.phrase_clean(F.concat(F.lit("Mount "), "s_name", F.lit(" and 'Stn' Road")))
    return s.withColumn("p", parts).select("s_suppkey", phrase.alias("phrase"), "p.genus", F.col("p.phrase").alias("named"), "p.voucher")


@query("""SELECT DISTINCT s_suppkey AS qid, p_partkey AS id FROM (SELECT s_suppkey, unnest([p_name || ' virus', p_name]) AS key FROM supplier JOIN part ON s_suppkey = p_partkey) q
  JOIN (SELECT p_partkey, p_name FROM part) t ON q.key = t.p_name""")
def jn_virus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-11, JN-06: virus names by each of their spellings."""
    p, s = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")
    q = s.join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("qid"), F.explode(N.virus_variants(F.concat("p_name", F.lit(" virus")))).alias("key"))
    return q.join(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("key")), "key").select("qid", "id").distinct()


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'species' WHEN c_custkey % 3 = 1 THEN 'family' ELSE 'kingdom' END AS rank,
  CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN n_name ELSE r_name END AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def fn_inferred_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-35: name and rank from the parts that a query has."""
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey") % 3
    parts = [("species", F.when(k == 0, F.col("c_name"))), ("family", F.when(k == 1, F.col("n_name")).otherwise(" ")), ("kingdom", F.col("r_name"))]
    both = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return both.withColumn("x", N.inferred_name(parts)).select("c_custkey", "x.rank", "x.name")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'GENERIC' WHEN p_size % 4 = 1 THEN 'SPECIES_PLURAL' END AS error,
  CASE WHEN p_size >= 25 THEN p_size + 6980 BETWEEN 7005 AND 9999 ELSE p_size + 6980 = 6985 END OR p_type = 'PROMO' AS allowed FROM part""")
def prd_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-07, PRD-09, FN-36."""
    k = F.col("p_size") % 4
    name = F.when(k == 0, " sp.").when(k == 1, F.concat("p_name", F.lit(" spp."))).otherwise(F.col("p_name"))
    wanted = F.when(F.col("p_size") >= 25, 7005).otherwise(6985)
    allowed = L.rank_allowed(wanted, F.col("p_size") + 6980, F.col("p_type") == "PROMO", F.lit(False))
    return _table(spark, sf_dir, "part").select("p_partkey", L.query_error(name).alias("error"), allowed.alias("allowed"))


@query("""WITH h AS (SELECT s_suppkey AS qid, c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END + CASE WHEN c_acctbal > 5000 THEN 20 ELSE 0 END AS score
  FROM supplier JOIN customer ON s_nationkey = c_nationkey)
SELECT qid, id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM h) WHERE rn <= 10""")
def jn_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-02, RNK-01, RNK-03: candidates ranked by classification hints, ten a query."""
    s, c = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "customer")
    # a query's candidates depend on its nation alone, so each nation is cut to ten before the join
    scored = c.select("c_nationkey", F.col("c_custkey").alias("id"), L.hint_score([(F.lit("building"), F.col("c_mktsegment"))], F.col("c_acctbal") > 5000).alias("score"))
    top = L.best(scored, "c_nationkey", [F.desc("score"), F.asc("id")], 10)
    return s.join(top, F.col("s_nationkey") == F.col("c_nationkey")).select(F.col("s_suppkey").alias("qid"), "id", "score", "rn")


@query("""SELECT c.c_custkey AS id, c.c_custkey % 97 AS accepted_id, c.c_name AS name, coalesce(a.c_name, c.c_name) AS accepted_name FROM customer c LEFT JOIN customer a ON c.c_custkey % 97 = a.c_custkey""")
def jn_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08, JN-09."""
    return L.with_accepted(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 97).alias("accepted_id"), F.col("c_name").alias("name")))


@query("""SELECT c_custkey AS id, c_nationkey AS accepted_id, CASE WHEN n_regionkey * 1000 > 1000 THEN n_name END AS kingdom, CASE WHEN n_regionkey * 1000 > 3000 THEN n_name END AS phylum
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def jn_copied_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16, IDX-04."""
    syn = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("accepted_id"))
    acc = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") * 1000).alias("rank_id"), F.col("n_name").alias("kingdom"), F.col("n_name").alias("phylum"))
    return L.copied_ranks(syn, acc, [("kingdom", 1000), ("phylum", 3000)])


@query("""SELECT p_name AS name, CASE WHEN min(p_brand) = max(p_brand) THEN min(p_brand) END AS id FROM part GROUP BY p_name""")
def mat_unique_vernacular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11, MAT-16: a common name of several taxa names none."""
    return L.unique_taxon(_table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("id")))


@query("""WITH o AS (SELECT p_brand AS id, p_name, lower(p_name) AS low, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END AS place FROM part)
SELECT id, (SELECT p_name FROM o x WHERE x.id = o.id ORDER BY place, p_name LIMIT 1) AS preferred, count(DISTINCT low) AS n_names FROM o GROUP BY id""")
def jn_common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12, RNK-15."""
    return L.common_names(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("language")), ["PROMO", "SMALL"])


@query("""WITH n AS (SELECT p_name AS key, count(*) FILTER (WHERE p_size < 25) AS a, count(*) FILTER (WHERE p_size < 25 AND p_type = 'PROMO') AS b FROM part GROUP BY p_name)
SELECT key, CASE WHEN a = 1 THEN 'kingdom' WHEN b = 1 THEN 'phylum' WHEN a = 0 THEN 'none' ELSE 'unresolved' END AS level, b AS n FROM n""")
def agg_homonym_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13, AGG-08."""
    return L.homonym_level(_table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), (F.col("p_size") < 25).alias("kingdom"), (F.col("p_type") == "PROMO").alias("phylum")), ["kingdom", "phylum"])


@query("""WITH h AS (SELECT o_custkey AS qid, o_orderkey % 3 AS t, CASE o_orderstatus WHEN 'P' THEN 'excluded' WHEN 'F' THEN 'misapplied' ELSE 'match' END AS kind FROM orders),
  n AS (SELECT qid, count(*) AS n, count(*) FILTER (WHERE kind = 'excluded') AS bad, count(*) FILTER (WHERE kind = 'misapplied') AS mis, count(DISTINCT t) AS k FROM h GROUP BY qid)
SELECT qid, n, k = 1 AS one_concept, CASE WHEN bad = n THEN 'EXCLUDED' WHEN bad > 0 THEN 'ASSOCIATED_EXCLUDED' WHEN mis > 0 AND (mis < n OR k > 1) THEN 'MATCH_MISAPPLIED' WHEN mis > 0 THEN 'MISAPPLIED' END AS error FROM n""")
def agg_result_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, AGG-09, AGG-10, MAT-04, MAT-06."""
    kind = F.when(F.col("o_orderstatus") == "P", "excluded").when(F.col("o_orderstatus") == "F", "misapplied").otherwise("match")
    return L.result_checks(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("accepted_id"), kind.alias("kind")))
