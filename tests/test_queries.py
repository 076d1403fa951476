"""Each query against its SQL on the smallest tables, and golden values of the name functions."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from namewright.functions import names as N
from namewright.functions import similarity as S
from namewright.operators.concepts import inherited_scores, least_upper_bounds
from namewright.operators.conditions import all_of, any_of, first_reason, match_rule, text_test
from namewright.operators.match import cascade
from namewright.operators.tree import nested_set, resolved
from namewright.plans.catalog import QUERIES, SQL
from namewright.sources.archive import all_taxa, find_sources, open_source, read_archive, with_extension, write_archive
from namewright.sources.delimited import priorities, read_delimited
from namewright.streaming.match import changed, match_stream

SF = "/root/testdata/sf0.001"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return Counter(tuple(str(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(SQL[name])
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    assert got == rows([c[0] for c in want.description], want.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("f", "text", "want"), [
    (N.normalise_spaces, "  Ozothamnus   diosmifolius ", "Ozothamnus diosmifolius"),
    (N.sound_normal, "Æschna é-1", "AESCHNA E"),
    (N.sound_normal, "12", None),
    (N.rank_marker, " Sp. ", True),
    (N.without_locality, "Name (Here)", "Name"),
    (N.doubt_flags, "Munida cf. amathea?", ["QUESTION", "CONFER"]),
    (N.split_flags, "a|B, a", ["A", "B"]),
])
def test_names(spark, f, text, want):
    assert one(spark, f(F.lit(text))) == want


def test_rule_modes(spark):
    hit = lambda text, want, mode: one(spark, text_test(F.lit(text), want, mode))
    assert hit("Acácia-Dealbata ", "acacia dealbata", "NORMALISED") and not hit("Acacia", "Acaciae", "NORMALISED")
    assert not hit(None, "a", "NORMALISED")


def test_similarity_golden_values(spark):
    assert [one(spark, S.ngram_similarity(F.lit("SMITH"), F.lit("SMYTH"), n)) for n in (2, 3)] == [0.6667, 0.5714]
    assert [one(spark, S.ngram_similarity(F.lit("ACACIA"), F.lit("ACASIA"), n)) for n in (2, 3)] == [0.7143, 0.625]
    assert one(spark, S.edit_similarity(F.lit(""), F.lit(""))) == 1


@pytest.mark.parametrize(("word", "epithet", "want"), [("Acacia", False, "ACACA"), ("Eucalyptus", False, "UCALIPTIS"), ("Xanthorrhoea", False, "ZNTARIA"), ("Macropus", False, "MACRAPIS"),
    ("Psephotus", False, "SIPATIS"), ("Mcleania", False, "MACLIANA"), ("rufum", True, "RIFA"), ("novaehollandiae", True, "NAVIALANDI"), ("haemorrhoïdalis", True, "HIMARADALA")])
def test_sound_keys(spark, word, epithet, want):
    assert one(spark, N.sound_key(F.lit(word), epithet)) == want


def test_three_words_match_by_sound_in_all_of_them(spark):
    taxa = spark.createDataFrame([(1, "Acacia rufa alba", 1), (2, "Acacia rufa", 1)], "id long, name string, priority int")
    q = spark.createDataFrame([(1, "Acacia rufus albus"), (2, "Acacia rufum")], "qid long, name string")
    assert {(r.qid, r.id) for r in cascade(q, taxa).collect()} == {(1, 1), (2, 2)}


def test_phrase_names(spark):
    p = one(spark, N.phrase_parts(F.lit("Baeckea sp. Bunney Road (S.Patrick 4059)")))
    assert tuple(p) == ("Baeckea", "sp.", "Bunney Road", "S.Patrick 4059")
    assert one(spark, N.phrase_parts(F.lit("Thelymitra sp. adorata"))).genus is None


def test_archive_round_trip(spark, tmp_path):
    taxa = spark.createDataFrame([("t2", "Acacia\tdealbata", None), ("t1", "Acacia", "x")], "taxonID string, scientificName string, note string")
    places = spark.createDataFrame([("t1", "here"), ("t1", "there")], "taxonID string, locality string")
    folder = str(tmp_path / "a" / "archive")
    write_archive(folder, taxa, {"Distribution": places})
    got = read_archive(spark, folder)
    assert list(got) == ["Taxon", "Distribution"]
    assert {(r.core_id, r.scientificName, r.note) for r in got["Taxon"].collect()} == {("t2", "Acacia\tdealbata", None), ("t1", "Acacia", "x")}
    joined = {r.taxonID: r.d for r in with_extension(got["Taxon"], got["Distribution"], "d").collect()}
    assert sorted(x.locality for x in joined["t1"]) == ["here", "there"] and joined["t2"] is None
    (tmp_path / "b.csv").write_text("taxonID,scientificName\n1, Acacia \n2,\n")
    assert find_sources(str(tmp_path)) == [str(tmp_path / "b.csv"), folder]
    with pytest.raises(ValueError, match="nomenclaturalCode"):
        open_source(spark, folder)
    both = all_taxa([open_source(spark, str(tmp_path / "b.csv"), ["taxonID"])["Taxon"], got["Taxon"]])
    assert both.count() == 4 and both.where("scientificName is null").count() == 1


def test_stream_of_names(spark, tmp_path):
    taxa = spark.createDataFrame([(1, "Acacia", 1), (2, "acacia", 5), (3, "Macropus", 1)], "id long, name string, priority int")
    spark.createDataFrame([("ACACIA",), ("Nothing",)], "name string").write.json(str(tmp_path / "in"))
    stream = match_stream(spark.readStream.schema("name string").json(str(tmp_path / "in")), taxa)
    run = stream.writeStream.format("memory").queryName("matched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("matched").collect()} == {("ACACIA", 2), ("Nothing", None)}


def test_changes(spark):
    taxa = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, None, "c")], "id long, accepted_id long, name string")
    changes = spark.createDataFrame([("delete", 1, None, None), ("add", 3, None, "d"), ("add", 4, None, "e")], "op string, id long, accepted_id long, name string")
    assert {(r.id, r.name) for r in changed(taxa, changes).collect()} == {(3, "d"), (4, "e")}


def test_null_stays_null(spark):
    for f in (N.normalise_spaces, N.sound_key, N.common_key, N.author_key):
        assert one(spark, f(F.lit(None).cast("string"))) is None


def test_nested_set_and_links(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("z", None)], "id string, parent_id string")
    assert {(r.id, r.left, r.right) for r in nested_set(tree).collect()} == {("a", 2, 8), ("b", 3, 5), ("d", 4, 4), ("c", 7, 7), ("z", 10, 10)}
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "id int, target int")
    assert {(r.id, r.target) for r in resolved(links).collect()} == {(1, 3), (2, 3), (5, None), (6, None)}


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1," Acacia ""x"" "\n2,  \n')
    df = read_delimited(spark, str(tmp_path / "a.csv"), required=["id"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'Acacia "x"'), ("2", None)]
    with pytest.raises(ValueError, match="rank"):
        read_delimited(spark, str(tmp_path / "a.csv"), required=["rank"])
    rows = spark.createDataFrame([("a", "2.5"), ("b", "much"), ("c", None)], "key string, value string")
    assert {tuple(r) for r in priorities(rows).collect()} == {("a", 2.5), ("b", 1.0), ("c", 1.0)}


def test_rules(spark):
    df = spark.createDataFrame([("Acacia  dealbata", "species"), (None, None)], "name string, rank string")
    rules = [match_rule("acacia DEALBATA", "INSENSITIVE"), match_rule(rank=["species", "genus"]), all_of([]), any_of([])]
    assert [tuple(r) for r in df.select(*[r.test for r in rules]).collect()] == [(True, True, True, False), (False, False, True, False)]
    assert [r[0] for r in df.select(first_reason(rules[:2])).collect()] == ["name:acacia DEALBATA", None]


@pytest.mark.parametrize(("text", "want"), [("Æschna", "EAHNS"), ("xanthorrhoea", "ZAAHHINORT"), ("Acacia  dealbata", "AAACC DAAABELT"), ("", ""), (None, None)])
def test_spelling_key(spark, text, want):
    assert one(spark, N.spelling_key(F.lit(text).cast("string"))) == want


def test_scores_stop_at_other_providers_and_loops(spark):
    rows_ = [("r", None, "A", 7, 1), ("x", "r", "A", None, 1), ("y", "x", "B", None, 2), ("z", "y", "B", None, 2), ("l", "m", "A", None, 3), ("m", "l", "A", None, 3), ("o", "none", None, None, 9)]
    nodes = spark.createDataFrame(rows_, "id string, parent_id string, provider string, specific int, default int")
    assert {r.id: r.score for r in inherited_scores(nodes).collect()} == {"r": 7, "x": 7, "y": 2, "z": 2, "l": 3, "m": 3, "o": 9}


def test_least_upper_bound_of_a_synonym(spark):
    taxa = spark.createDataFrame([("r", None, None, "R"), ("f", "r", None, "F"), ("g", "r", None, "G"), ("a", "f", None, "A"), ("b", "g", "a", "B")], "id string, parent_id string, accepted_id string, concept string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "g"), ("a", "g"), ("a", None), ("no", "a")], "a string, b string")
    assert {(r.a, r.b): r.lub for r in least_upper_bounds(pairs, taxa).collect()} == {("a", "b"): "a", ("b", "g"): "g", ("a", "g"): "r", ("a", None): None, ("no", "a"): None}
