import math
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as ix
from lodestone.operators import ranking as rk
from lodestone.operators import reports
from lodestone.plans.engine import Engine
from lodestone.sources import corpus as corpus_source
from lodestone.streaming.ingest import append_postings, document_stream

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id string, parent_file string, city string, lang string, headline string, text string"


def corpus(spark, rows):
    return spark.createDataFrame([(d, "f", None, "en", h, t) for d, h, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    docs = corpus(spark, [("d1", "Alpha beta", "alpha beta alpha gamma"), ("d2", "", "beta delta"), ("d3", "Other", "alpha gamma gamma")])
    return ix.build(docs)


def topics(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, title string, description string")


def test_worked_ranking(spark, small):
    stats = small.corpus_stats.first()
    assert (stats["avl"], stats["n_docs"], stats["total_terms"]) == (3, 3, 9)
    bare = ix.Index(**{**vars(small), "headers": small.headers.limit(0)})
    rows = rk.search(bare, topics(spark, ("q", "alpha", ""))).collect()
    assert [(r["doc_id"], round(r["score"], 6), r["rank"]) for r in rows] == [("d1", 2.409556, 1), ("d3", 1.775843, 2)]


def test_headline_raises(spark, small):
    rows = {r["doc_id"]: r["score"] for r in rk.search(small, topics(spark, ("q", "alpha", ""))).collect()}
    assert rows["d1"] == pytest.approx(2.409556 + 8.55 * 0.5, abs=1e-6)


def test_term_in_most_documents_weighs_nothing(spark):
    index = ix.build(corpus(spark, [(f"d{k}", "", "alpha" + " beta" * (k == 0)) for k in range(4)]))
    rows = rk.search(index, topics(spark, ("q", "alpha", ""))).collect()
    assert all(r["score"] == 0 for r in rows)
    assert [r["doc_id"] for r in rows] == ["d3", "d2", "d1", "d0"]  # ties: id descending


def test_reference_cutoff(spark):
    index = ix.build(corpus(spark, [(f"d{k}", "", "alpha") for k in range(9)]))
    assert rk.search(index, topics(spark, ("q", "alpha", "")), reference_cutoff=True).count() == 5


def test_expansion(spark):
    desc = spark.createDataFrame([("q", k, t, False) for k, t in enumerate("a b c d e f".split())], "query_id string, pos int, term string, is_upper boolean")
    terms = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 5)], "term string, df long")
    rows = sorted((r["term"], r["df"]) for r in rk.expansion(desc, terms).collect())
    assert rows == [("b", 1), ("c", 2), ("d", 5), ("f", -1)]
    rows = sorted(r["term"] for r in rk.expansion(desc.filter("term <> 'd'"), terms).collect())
    assert rows == ["c", "f"]


def test_minus_title(spark):
    make = lambda ts: spark.createDataFrame([("q", k, t, False) for k, t in enumerate(ts)], "query_id string, pos int, term string, is_upper boolean")
    rows = rk.minus_title(make("x document y x document".split()), make(["x"])).collect()
    assert sorted(r["term"] for r in rows) == ["document", "y"]


def test_city_filter(spark):
    docs = corpus(spark, [("d1", "", "Lisbon alpha"), ("d2", "", "alpha lisbon"), ("d3", "", "Porto alpha"), ("d4", "", "beta"), ("d5", "", "beta"), ("d6", "", "beta"), ("d7", "", "gamma")])
    index = ix.build(docs, cities=spark.createDataFrame([("porto",), ("lisbon",)], "city string"))
    assert [tuple(r) for r in index.city_docs.collect()] == [("PORTO", "d3", 1)]  # lisbon isn't always capitalised
    assert [r["doc_id"] for r in rk.search(index, topics(spark, ("q", "alpha", "")), cities=["Porto"]).collect()] == ["d3"]


def test_synonyms(spark):
    title = spark.createDataFrame([("q", 0, "a", False), ("q", 1, "b", False)], "query_id string, pos int, term string, is_upper boolean")
    synonyms = spark.createDataFrame([("a", "x", 1), ("a", "none", 2), ("a", "y", 3), ("a", "z", 4), ("b", "x", 1), ("b", "z", 2)], "term string, related string, rank int")
    terms = spark.createDataFrame([(t,) for t in "xyz"], "term string")
    rows = sorted((r["origin"], r["term"]) for r in rk.synonym_terms(title, synonyms, terms).collect())
    assert rows == [("a", "x"), ("a", "y")]


@pytest.mark.parametrize("analyzer", ["simple", "full"])
def test_invariants(spark, analyzer):
    from lodestone.sources.corpus import from_tables

    docs = from_tables(spark, SF)
    index = ix.build(docs, analyzer=analyzer)
    sums = index.postings.groupBy("doc_id").agg(F.sum("tf").alias("n")).join(index.doc_stats, "doc_id")
    assert sums.filter("n <> doc_len").isEmpty()
    n = docs.count()
    assert index.terms.filter(f"df > {n} OR max_tf > total_tf OR df > total_tf").isEmpty()
    assert index.entities.filter("rank > 5 OR entity <> upper(entity)").isEmpty()
    low = ix.occurrences(docs, analyzer=analyzer).filter("NOT is_upper").select("term").distinct()
    assert index.terms.filter("is_entity").join(low, "term").isEmpty()


def test_ranks_have_no_gaps(spark):
    from lodestone.plans.catalog import topk_per_query

    rows = topk_per_query(spark, SF)
    bad = rows.groupBy("query_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).filter("m <> n")
    assert bad.isEmpty()


def test_engine_round_trip(spark, tmp_path):
    docs = corpus(spark, [("d1", "River trade", "Ashley Cummins sold grain for $450,000"), ("d2", "", "river grain"), ("d3", "", "salt"), ("d4", "", "salt"), ("d5", "", "iron")])
    path = str(tmp_path / "index")
    engine = Engine.build(spark, docs, path)
    terms = {r["term"]: r["total_tf"] for r in engine.terms().collect()}
    assert terms["450,000 Dollars"] == 1 and terms["ASHLEY CUMMINS"] == 2
    found = Engine.open(spark, path).search("river grain")
    assert {r["doc_id"] for r in found.collect()} == {"d1", "d2"}
    assert engine.to_trec(found).first()["line"].startswith("single query 0 d")
    assert reports.to_listing(found).first()["line"] == "----QUERY ID: single query----"
    assert [r["entity"] for r in engine.entities("d1").collect()][-1] == "ASHLEY CUMMINS"
    query = spark.createDataFrame([("grain",)], "term string")
    rows = ix.posting_rows(engine.index, query)
    assert {r["doc_id"] for r in rows.filter("term = 'grain'").collect()} == {"d1", "d2"}
    assert "bucket#" in rows._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert [r["doc_id"] for r in engine.index.doc_stats.collect()] == ["d1", "d2", "d3", "d4", "d5"]
    with pytest.raises(ValueError, match="text"):
        engine.search(" ")
    with pytest.raises(ValueError, match="lack"):
        engine.search_topics(topics(spark, ("q", "a", "b")).drop("title"))
    with pytest.raises(ValueError, match="no index"):
        Engine.open(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="confirm"):
        Engine.drop(spark, path)
    Engine.drop(spark, path, confirm=True)
    with pytest.raises(ValueError, match="no index"):
        Engine.drop(spark, path, confirm=True)


def test_dropped_terms_find_nothing(spark, small):
    less = ix.Index(**{**vars(small), "terms": small.terms.filter("term <> 'alpha'")})
    assert {r["doc_id"] for r in rk.search(less, topics(spark, ("q", "alpha", ""))).collect()} == set()


def test_city_dictionary(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "f", "Lisbon", "en", "", "Lisbon alpha"), ("d2", "f", "Nowhere", "en", "", "beta")], SCHEMA)
    feed = spark.createDataFrame([('[{"name": "Portugal", "capital": "Lisbon", "population": 10300000, "currencies": [{"code": "EUR"}, {"code": "X"}], "more": 1}, {"name": "Peru", "capital": "Lima"}]',), ("broken",), (None,)], "json string")
    countries = corpus_source.countries_from_json(feed)
    assert sorted(tuple(r) for r in countries.collect()) == [("Peru", "Lima", None, None), ("Portugal", "Lisbon", 10300000, "EUR")]
    engine = Engine.build(spark, docs, str(tmp_path / "index"), countries=countries)
    assert [tuple(r) for r in engine.city_dictionary().collect()] == [("LISBON", "Portugal", "EUR", "M10.3"), ("NOWHERE", None, None, None)]


def test_without_training_part(tmp_path):
    """In a copy without the training-data subpackage (and with or without the pipeline) the queries are still there."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for gone in ((), ("corpus_pipeline.py",)):
        copy = tmp_path / f"copy{len(gone)}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *gone))
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert "bm25_single_query" in said.stdout and "op1_" not in said.stdout and "pipeline" not in said.stdout, said.stderr


def test_stemmed_index(spark):
    index = ix.build(corpus(spark, [("d1", "", "trading ships"), ("d2", "", "trade ship")]), analyzer="full", stemming=True)
    assert {r["term"]: r["df"] for r in index.terms.collect()} == {"trade": 2, "ship": 2}


def test_weights_by_hand(spark, small):
    w = 2.5 * 2 / (2 + 1.5 * (1 - 0.37 + 0.37 * 4 / 3)) * math.log(2)
    assert w == pytest.approx(0.940498, abs=1e-6)


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in"))
    query = append_postings(document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert {r["term"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"alpha", "beta"}


def test_registered():
    import __spark_entry__ as entry

    assert {k for k in entry.oracle_sql()} <= set(entry.queries())
    assert "bm25_single_query" in entry.queries()
