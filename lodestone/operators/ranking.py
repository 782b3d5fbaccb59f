"""Retrieval: all queries in one plan, scored by a BM25 variant with headline matches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.index import Index, occurrences, posting_rows, probe
from lodestone.operators.stop_words import STOP_WORDS

# Fixed values of the ranking formula.
K, B = 1.5, 0.37
TITLE, DESCRIPTION, HEADLINE = 0.70 * 1.83, 0.05, 0.2 * 37 + 0.05 * 23
LIMIT = 50
SYNONYMS = 2
NOT_EXPANDED = "document"


def query_terms(topics: DataFrame, column: str, stop_words: Iterable[str] = STOP_WORDS, analyzer: str = "simple", stemming: bool = False) -> DataFrame:
    """query_id, pos, term, is_upper of a text column of topics, by the documents' own rules."""
    texts = topics.select(F.col("query_id").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    return occurrences(texts, stop_words, analyzer, stemming).select(F.col("doc_id").alias("query_id"), "pos", "term", "is_upper")


def distinct_terms(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "term", "is_upper").distinct()


def minus_title(desc: DataFrame, title: DataFrame) -> DataFrame:
    """Description terms that aren't title terms, and not the word 'document' once."""
    left = desc.join(title.select("query_id", "term", "is_upper").distinct(), ["query_id", "term", "is_upper"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id", "term", "is_upper").orderBy("pos"))
    return left.withColumn("_n", nth).filter(~((F.col("term") == NOT_EXPANDED) & (F.col("_n") == 1))).drop("_n")


def wants_expansion(title: DataFrame, desc: DataFrame) -> DataFrame:
    """query_id of topics whose description has at least twice as many terms as the title, repeats included."""
    n = title.groupBy("query_id").agg(F.count("*").alias("t"))
    m = desc.groupBy("query_id").agg(F.count("*").alias("d"))
    both = n.join(m, "query_id", "full").select("query_id", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("d", F.lit(0)).alias("d"))
    return both.filter("d >= 2 * t").select("query_id")


def expansion(desc: DataFrame, terms: DataFrame) -> DataFrame:
    """Of each topic's description terms one for each document frequency (the last to stand; unseen: -1), without the middle one if their number is odd."""
    with_df = desc.join(terms.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(-1)))
    last = with_df.groupBy("query_id", "df").agg(F.max_by(F.struct("term", "is_upper"), "pos").alias("t"))
    w = Window.partitionBy("query_id")
    ranked = last.withColumn("k", F.row_number().over(w.orderBy("df"))).withColumn("n", F.count("*").over(w))
    return ranked.filter("n % 2 = 0 OR k <> (n + 1) / 2").select("query_id", "t.term", "t.is_upper", "df")


def synonym_terms(title: DataFrame, synonyms: DataFrame, terms: DataFrame, most: int = SYNONYMS) -> DataFrame:
    """For each title term its first related words that the corpus has and that no earlier title term brought: query_id, term, is_upper, origin, rank."""
    first = title.groupBy("query_id", "term").agg(F.min("pos").alias("at"))
    found = first.join(synonyms.withColumnRenamed("term", "of"), F.col("term") == F.col("of"))
    found = found.select("query_id", F.col("term").alias("origin"), "at", F.lower("related").alias("term"), "rank").join(terms.select("term"), "term", "left_semi")
    fresh = F.row_number().over(Window.partitionBy("query_id", "term").orderBy("at", "rank"))
    found = found.withColumn("_n", fresh).filter("_n = 1").drop("_n")
    nth = F.row_number().over(Window.partitionBy("query_id", "origin").orderBy("rank", "term"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= most).select("query_id", "term", F.lit(False).alias("is_upper"), "origin", "rank")


def candidates(query: DataFrame, post: DataFrame, stats: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """Query terms with the documents that have them; cities: doc_id of the documents that are allowed."""
    rows = query.join(post.select("term", "doc_id", "tf"), "term")
    if cities is not None:
        rows = rows.join(cities.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.join(stats.select("doc_id", "doc_len"), "doc_id")


def term_weights(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds df (documents left for the query's term) and w, the term's BM25 weight in the document; corpus has one row."""
    per = rows.groupBy("query_id", "term", "is_upper").agg(F.count("*").alias("df"))
    rows = rows.join(per, ["query_id", "term", "is_upper"])
    n_docs, avl = corpus.select("n_docs").scalar(), corpus.select("avl").scalar()
    idf = F.log(F.floor((n_docs + 1) / F.col("df")).cast("double"))
    w = (K + 1) * F.col("tf") / (F.col("tf") + K * (1 - B + B * F.col("doc_len") / avl)) * idf
    return rows.withColumn("w", w)


def bm25(rows: DataFrame) -> DataFrame:
    """s1 (weights of all terms, doubled for original title terms) and s2 (those of description terms) of each document."""
    w = F.when(F.col("in_title"), F.col("w") * 2).otherwise(F.col("w"))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(w).alias("s1"), F.sum(F.when(F.col("in_desc"), w).otherwise(0.0)).alias("s2"))


def headline_scores(query: DataFrame, desc: DataFrame, headers: DataFrame) -> DataFrame:
    """query_id, doc_id, h: share of the headline's terms that the query has, raised by multi-word terms."""
    size = headers.groupBy("doc_id").agg(F.count("*").alias("size"))
    texts = headers.select("term", "doc_id").distinct()
    long = F.when(F.col("term").rlike("[^ -][ -]+[^ -]"), 2).otherwise(0)
    hits = query.join(texts, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("n1"), F.sum(long).alias("b1"))
    more = desc.join(texts, "term").groupBy("query_id", "doc_id").agg(F.sum(long).alias("b2"))
    rows = hits.join(more, ["query_id", "doc_id"], "full").join(size, "doc_id")

    def raised(v, by):
        return v * F.when(F.coalesce(by, F.lit(0)) != 0, by).otherwise(1)

    h = raised(raised(F.coalesce("n1", F.lit(0)) / F.col("size"), F.col("b1")), F.col("b2"))
    return rows.select("query_id", "doc_id", h.alias("h"))


def ranked(scores: DataFrame, limit: int | None = LIMIT, reference_cutoff: bool = False) -> DataFrame:
    """query_id, rank, doc_id, score: score descending, then doc_id descending."""
    w = Window.partitionBy("query_id")
    out = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.desc("doc_id"))))
    if reference_cutoff:  # half of the documents and one more, if that is less
        out = out.withColumn("n", F.count("*").over(w)).filter(F.col("rank") <= F.floor(F.col("n") / 2) + 1)
    if limit is not None:
        out = out.filter(F.col("rank") <= limit)
    return out.select("query_id", "rank", "doc_id", "score")


def search(
    index: Index,
    topics: DataFrame,
    stop_words: Iterable[str] = STOP_WORDS,
    analyzer: str = "simple",
    stemming: bool = False,
    cities: list[str] | None = None,
    synonyms: DataFrame | None = None,
    limit: int | None = LIMIT,
    reference_cutoff: bool = False,
) -> DataFrame:
    """Ranks the documents of an index for topics (query_id, title, description)."""
    title = query_terms(topics, "title", stop_words, analyzer, stemming)
    desc = query_terms(topics, "description", stop_words, analyzer, stemming)
    gate = wants_expansion(title, desc).withColumn("gate", F.lit(True))
    rest = minus_title(desc, title)
    added = expansion(rest, index.terms).join(gate.select("query_id"), "query_id", "left_semi")
    desc = desc.join(gate, "query_id", "left_anti").unionByName(rest.join(gate.select("query_id"), "query_id", "left_semi"))
    original = distinct_terms(title)
    everything = original.unionByName(added.select("query_id", "term", "is_upper"))
    if synonyms is not None:
        everything = everything.unionByName(synonym_terms(title, synonyms, index.terms).select("query_id", "term", "is_upper"))
    keys = ["query_id", "term", "is_upper"]
    query = everything.distinct().join(original.withColumn("in_title", F.lit(True)), keys, "left").join(distinct_terms(desc).withColumn("in_desc", F.lit(True)), keys, "left").na.fill(False)
    allowed = None if not cities else index.city_docs.filter(F.col("city").isin([c.upper() for c in cities]))
    found = probe(query, index.terms)
    rows = term_weights(candidates(found, posting_rows(index, found), index.doc_stats, allowed), index.corpus_stats)
    scores = bm25(rows).join(headline_scores(query, distinct_terms(desc), index.headers), ["query_id", "doc_id"], "left")
    score = F.lit(TITLE) * F.col("s1") + F.lit(DESCRIPTION) * F.col("s2") + F.lit(HEADLINE) * F.coalesce("h", F.lit(0.0))
    return ranked(scores.select("query_id", "doc_id", score.alias("score")), limit, reference_cutoff)
