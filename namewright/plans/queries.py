"""Queries of the name-matching operators over whole tables, each with SQL for the same rows.

The tables stand for taxa: regions, nations and customers form a hierarchy, parts are names with types as authors, and
supplier names are looked up among customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namewright.functions import names as N
from namewright.operators.conditions import all_of, any_of, first_reason, match_rule, same_classification
from namewright.operators.match import above_threshold, cascade, weighted_score
from namewright.operators.tree import inherited, nested_set, resolved
from namewright.sources.delimited import last_of_each

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, rank, name: ids are padded so that their order is that of their numbers."""
    pad = lambda mark, col: F.concat(F.lit(mark), F.lpad(F.col(col).cast("string"), 12, "0"))
    r = _table(spark, sf_dir, "region").select(pad("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("kingdom").alias("rank"), F.col("r_name").alias("name"))
    n = _table(spark, sf_dir, "nation").select(pad("n", "n_nationkey").alias("id"), pad("r", "n_regionkey").alias("parent_id"), F.lit("family").alias("rank"), F.col("n_name").alias("name"))
    c = _table(spark, sf_dir, "customer").select(pad("s", "c_custkey").alias("id"), pad("n", "c_nationkey").alias("parent_id"), F.lit("species").alias("rank"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


_TREE = """tree AS (
  SELECT 'r' || lpad(CAST(r_regionkey AS VARCHAR), 12, '0') AS id, CAST(NULL AS VARCHAR) AS parent_id, 'kingdom' AS rank, r_name AS name FROM region
  UNION ALL SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 12, '0'), 'r' || lpad(CAST(n_regionkey AS VARCHAR), 12, '0'), 'family', n_name FROM nation
  UNION ALL SELECT 's' || lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 'n' || lpad(CAST(c_nationkey AS VARCHAR), 12, '0'), 'species', c_name FROM customer
)"""


@query(f"""WITH RECURSIVE {_TREE}, walk(id, parent_id, depth, path) AS (
  SELECT id, parent_id, 0, id FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT t.id, t.parent_id, w.depth + 1, w.path || '/' || t.id FROM tree t JOIN walk w ON t.parent_id = w.id
), ordered AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS p FROM walk
), sized AS (SELECT o.id, o.depth, o.p, (SELECT count(*) FROM walk x WHERE starts_with(x.path, o.path || '/')) AS n FROM ordered o WHERE o.depth < 2
  UNION ALL SELECT id, depth, p, 0 FROM ordered WHERE depth = 2)
SELECT id, depth, 2 + 2 * p - depth AS "left", 2 + 2 * p - depth + 2 * n AS "right" FROM sized""")
def tree_nested_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TREE-01, TREE-04 in part: a root is a node without parent, whether accepted or synonym."""
    return nested_set(_tree(spark, sf_dir).select("id", "parent_id"))


@query(f"""WITH {_TREE}
SELECT t.id, CASE t.rank WHEN 'kingdom' THEN t.name WHEN 'family' THEN u.name ELSE v.name END AS kingdom,
  CASE t.rank WHEN 'family' THEN t.name WHEN 'species' THEN u.name END AS family, CASE t.rank WHEN 'species' THEN t.name END AS species
FROM tree t LEFT JOIN tree u ON t.parent_id = u.id LEFT JOIN tree v ON u.parent_id = v.id WHERE t.parent_id IS NULL OR v.id IS NOT NULL OR t.rank = 'family' AND u.id IS NOT NULL""")
def tree_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TREE-03."""
    return inherited(_tree(spark, sf_dir), ["kingdom", "family", "species"])


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS id, p_partkey // 2 AS target FROM part WHERE p_partkey > 0), walk(id, target, k) AS (
  SELECT id, target, 1 FROM l UNION ALL SELECT w.id, l.target, w.k + 1 FROM walk w JOIN l ON w.target = l.id WHERE w.k < 40)
SELECT id, arg_max(target, k) AS target FROM walk GROUP BY id""")
def tree_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TREE-05 in part: chains of links to their ends, without the forbidden branch to the resolved parent."""
    return resolved(_table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("target")))


_SQUEEZE = "x"
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _SQUEEZE = f"regexp_replace({_SQUEEZE}, '{_c}+', '{_c}', 'g')"


def _sql_sound(x: str, epithet: bool) -> str:
    n = f"nullif(trim(regexp_replace(upper({x}), '[^A-Z .]', '', 'g')), '')"
    lead = " ".join(f"WHEN starts_with({n}, '{a}') THEN '{b}' || substr({n}, {len(a) + 1})" for a, b in [*N.LEADING])
    lead = f"CASE {lead} WHEN starts_with({n}, 'X') THEN 'Z' || substr({n}, 3) ELSE {n} END"
    rest = "substr(y, 2)"
    for a, b in N.TAIL:
        rest = f"replace({rest}, '{a}', '{b}')"
    squeezed = _SQUEEZE.replace("(x,", f"(substr(y, 1, 1) || {rest},")
    out = f"regexp_replace({squeezed}, '(IS|IM|AS)$', 'A')" if epithet else squeezed
    return f"(SELECT {out} FROM (SELECT {lead} AS y))"


@query(f"""SELECT p_partkey, {_sql_sound("split_part(p_name, ' ', 1)", False)} AS genus_key, {_sql_sound("split_part(p_name, ' ', 2)", True)} AS epithet_key FROM part""")
def fn_sound_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-05, FN-06."""
    word = F.split("p_name", " ")
    return _table(spark, sf_dir, "part").select("p_partkey", N.sound_key(F.get(word, F.lit(0))).alias("genus_key"), N.sound_key(F.get(word, F.lit(1)), True).alias("epithet_key"))


@query(r"""SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS common, regexp_replace(lower(c_name), '[^a-z]', '', 'g') AS letters,
  replace(c_name, '#', '') AS author, c_name || ' ' || c_mktsegment AS full_name, c_name AS bare, false AS marker FROM customer""")
def fn_search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-08, FN-09, FN-10, FN-12, FN-25, FN-36."""
    name, author = F.col("c_name"), F.col("c_mktsegment")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", N.common_key(name).alias("common"), N.letters_key(name).alias("letters"), N.author_key(name).alias("author"), N.full_name(name, author, F.lit("")).alias("full_name"),
        N.without_locality(F.concat_ws(" ", name, F.concat(F.lit("("), author, F.lit(")")))).alias("bare"), N.rank_marker(name).alias("marker"),
    )


@query(f"""WITH q0 AS (SELECT s_suppkey AS qid, CASE s_suppkey % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') ELSE replace(p_name, 'e', 'i') END AS name FROM supplier JOIN part ON s_suppkey = p_partkey),
  t0 AS (SELECT p_partkey AS id, p_name AS name, p_size AS priority FROM part),
  q1 AS (SELECT *, split_part(name, ' ', 1) AS p1, split_part(name, ' ', 2) AS p2 FROM q0), t1 AS (SELECT *, split_part(name, ' ', 1) AS p1, split_part(name, ' ', 2) AS p2 FROM t0),
  qs AS (SELECT *, {_sql_sound("p1", False)} || ' ' || coalesce({_sql_sound("nullif(p2, '')", True)}, '<null>') || ' <null>' AS sx FROM q1),
  ts AS (SELECT *, {_sql_sound("p1", False)} || ' ' || coalesce({_sql_sound("nullif(p2, '')", True)}, '<null>') || ' <null>' AS sx FROM t1),
  h AS (SELECT qid, 0 AS stage, id, priority FROM qs q JOIN ts t ON lower(q.name) = lower(t.name)
    UNION ALL SELECT qid, 1, id, priority FROM qs q JOIN ts t ON regexp_replace(lower(q.name), '[^a-z]', '', 'g') = regexp_replace(lower(t.name), '[^a-z]', '', 'g')
    UNION ALL SELECT qid, 2, id, priority FROM qs q JOIN ts t ON q.sx = t.sx),
  f AS (SELECT * FROM h QUALIFY stage = min(stage) OVER (PARTITION BY qid)),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY priority DESC, id) AS rn FROM f)
SELECT qid, CASE stage WHEN 0 THEN 'exactMatch' WHEN 1 THEN 'canonicalMatch' ELSE 'soundexMatch' END AS match_type, id, rn FROM r WHERE rn <= 10""")
def mat_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAT-01 (no phrase and cultivar stages), JN-01, JN-05, IDX-03, RNK-01: the best ten candidates of the first stage that gives any."""
    part = _table(spark, sf_dir, "part")
    k = F.col("s_suppkey") % 3
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.translate("p_name", " ", "-")).otherwise(F.translate("p_name", "e", "i"))
    q = _table(spark, sf_dir, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("qid"), name.alias("name"))
    return cascade(q, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("priority")))


_SCORED = """s AS (SELECT o_orderkey AS id, o_custkey AS qid, round((0.1 + CASE WHEN lower(o_orderstatus) = lower('o') THEN 4.0 ELSE 0.0 END
  + CASE WHEN o_orderpriority = '1-URGENT' THEN 2.0 ELSE 0.0 END) / (0.1 + 4.0 + 2.0), 6) AS score FROM orders)"""


@query(f"WITH {_SCORED} SELECT id, qid, score FROM s QUALIFY score > 0.5 OR NOT max(score > 0.5) OVER (PARTITION BY qid)")
def rnk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, MAT-13, PRD-10: weighted scores, and those above the threshold where a query has any."""
    score = weighted_score([(4.0, F.lit("o"), F.col("o_orderstatus")), (2.0, F.lit("1-URGENT"), F.col("o_orderpriority"))], 0.1)
    return above_threshold(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("qid"), F.round(score, 6).alias("score")))


@query("""SELECT c_nationkey AS concept, c_custkey AS principal, c_acctbal AS score FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1""")
def rnk_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-03, RNK-04: the member with the highest score of each concept, by partial maxima."""
    c = _table(spark, sf_dir, "customer")
    best = c.groupBy("c_nationkey").agg(F.max(F.struct("c_acctbal", (-F.col("c_custkey")).alias("k"))).alias("b"))
    return best.select(F.col("c_nationkey").alias("concept"), (-F.col("b.k")).alias("principal"), F.col("b.c_acctbal").alias("score"))


@query("""SELECT p_name AS name, count(DISTINCT p_brand) AS n_codes, count(*) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1""")
def agg_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: names that stand under several codes."""
    return _table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.countDistinct("p_brand").alias("n_codes"), F.count("*").alias("n")).where("n_codes > 1")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def set_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04, SNK-14, JN-14, PRD-08: rows not on the list to delete, with a loaded partner."""
    s, o = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "orders")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(s, c.c_custkey == s.s_suppkey, "left_anti").join(o, c.c_custkey == o.o_custkey, "left_semi")


@query("""SELECT s_suppkey AS qid, coalesce(p_partkey, s_suppkey) AS id, p_name AS name FROM supplier LEFT JOIN part ON s_suppkey * 2 = p_partkey""")
def jn_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-07: ids by their aliases."""
    s, p = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return s.join(p, s.s_suppkey * 2 == p.p_partkey, "left").select(F.col("s_suppkey").alias("qid"), F.coalesce("p_partkey", "s_suppkey").alias("id"), F.col("p_name").alias("name"))


@query("""SELECT p_partkey, regexp_matches(p_name, '^(?:.*e.*)$', 'i') AND p_size IN (1, 2, 3, 4, 5) OR p_type = 'PROMO' AS matched,
  CASE WHEN p_type = 'PROMO' THEN 'p_type:PROMO' WHEN p_size IN (1, 2, 3) THEN 'p_size:1,2,3' END AS reason FROM part""")
def prd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-01, PRD-02, PRD-04, PRD-05, PRD-06."""
    promo = match_rule(p_type=["PROMO"])
    rule = any_of([all_of([match_rule(".*e.*", "REGEX", "p_name"), match_rule(p_size=[1, 2, 3, 4, 5])]), promo])
    return _table(spark, sf_dir, "part").select("p_partkey", rule.test.alias("matched"), first_reason([promo, match_rule(p_size=[1, 2, 3])]).alias("reason"))


@query("""SELECT c_custkey, c_name AS name, nullif(c_nationkey, c_custkey) AS accepted FROM customer""")
def fn_instance_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-30: a row accepted as itself has no accepted row; the author leaves the name."""
    name, author = F.concat_ws(" ", "c_name", "c_mktsegment"), F.col("c_mktsegment")
    return _table(spark, sf_dir, "customer").select("c_custkey", N.without_author(name, author).alias("name"), F.nullif(F.col("c_nationkey"), F.col("c_custkey")).alias("accepted"))


@query("""SELECT c_custkey, c_mktsegment = 'BUILDING' AND (n_name IS NULL OR c_nationkey = s_nationkey) AS same FROM customer
  JOIN supplier ON c_custkey = s_suppkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def prd_same_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-14."""
    c, s, n = (_table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    of_s = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("other"))
    both = c.join(s, c.c_custkey == s.s_suppkey).join(n, c.c_nationkey == n.n_nationkey, "left").join(of_s, F.col("s_nationkey") == F.col("k"), "left")
    return both.select("c_custkey", same_classification([(F.lit("building"), F.col("c_mktsegment")), (F.col("n_name"), F.col("other"))]).alias("same"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def src_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22: of repeated keys the last row."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus").withColumn("n", F.col("o_orderkey"))
    return last_of_each(o, "o_custkey", "n")
