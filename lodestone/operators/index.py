"""The index as tables: one shuffle by (document, term) makes postings, and all else is aggregated from them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.terms import with_terms
from lodestone.operators.stop_words import STOP_WORDS
from lodestone.operators.storage import materialize

TABLES = ("postings", "terms", "doc_stats", "headers", "entities", "city_docs", "cities", "corpus_stats", "languages")
BUCKETS = 64
ENTITIES = 5


def simple_terms(docs: DataFrame, stop_words: Iterable[str], text_col: str) -> DataFrame:
    """doc_id, pos, term, is_upper with built-in functions only: single words, no look-ahead.

    Tokens are exploded first, so that the rules run in generated code and not inside a lambda.
    """
    stop = sorted({*stop_words, *X.DROPPED})
    rows = docs.select("doc_id", F.posexplode(X.tokenize(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "raw"))
    rows = rows.withColumn("c", X.clean_token(F.col("raw"))).filter(X.long_enough(F.col("raw"), F.col("c")))
    rows = rows.select("doc_id", "pos", F.lower("c").alias("term"), X.is_capital(F.col("c")).alias("is_upper"))
    return rows.filter(~F.col("term").isin(stop) & X.accepted(F.col("term")))


def occurrences(docs: DataFrame, stop_words: Iterable[str] = STOP_WORDS, analyzer: str = "simple", stemming: bool = False, text_col: str = "text") -> DataFrame:
    """doc_id, pos, term, is_upper of every term that stands."""
    if analyzer == "full":
        made = with_terms(docs.select("doc_id", text_col), text_col, stop_words, stemming)
        rows = made.select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.pos", "t.term", "t.is_upper")
    elif analyzer == "simple" and not stemming:
        rows = simple_terms(docs, stop_words, text_col)
    else:
        raise ValueError("analyzer is 'simple' (without stemming) or 'full'")
    return rows.withColumn("spelling", F.col("term")).withColumn("term", F.lower("term"))


def postings(occ: DataFrame) -> DataFrame:
    """term, doc_id, tf, all_upper, last_pos, spelling; partially aggregated before its shuffle."""
    return occ.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.bool_and("is_upper").alias("all_upper"), F.max("pos").alias("last_pos"), F.min("spelling").alias("spelling"))


def term_dictionary(post: DataFrame, n_docs: int) -> DataFrame:
    """Per term: display form, entity flag, document of the greatest tf (least id on ties), totals. Rare terms of large corpora go."""
    out = post.groupBy("term").agg(
        F.bool_and("all_upper").alias("is_entity"),
        F.min("spelling").alias("spelling"),
        F.min_by("doc_id", F.struct((-F.col("tf")).alias("k"), "doc_id")).alias("max_tf_doc"),
        F.max("tf").alias("max_tf"),
        F.sum("tf").alias("total_tf"),
        F.count("*").alias("df"),
    )
    out = out.filter(common(n_docs))
    return out.select("term", X.display(F.col("spelling"), F.col("is_entity")).alias("display_term"), "is_entity", "max_tf_doc", "max_tf", "total_tf", "df")


def common(n_docs: int) -> Column:
    """Not rare: found in enough documents, or more than three times."""
    return ~((F.col("df") < n_docs // 100_000 + 1) & (F.col("total_tf") <= 3))


def doc_stats(post: DataFrame, docs: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Per document: most frequent term (the first to reach its count), distinct terms, length, headline terms."""
    most = F.struct((-F.col("tf")).alias("k"), "last_pos", "term")
    out = post.groupBy("doc_id").agg(F.min_by("term", most).alias("most_freq_term"), F.max("tf").alias("max_tf"), F.count("*").alias("n_unique"), F.sum("tf").alias("doc_len"))
    out = docs.select("doc_id", "parent_file", "city").join(out, "doc_id")
    if headers is not None:
        own = headers.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "is_upper"))).alias("headers"))
        out = out.join(own, "doc_id", "left")
    else:
        out = out.withColumn("headers", F.lit(None).cast("array<struct<term:string,is_upper:boolean>>"))
    return out.withColumn("headers", F.coalesce("headers", F.array().cast("array<struct<term:string,is_upper:boolean>>")))


def header_index(docs: DataFrame, stop_words: Iterable[str] = STOP_WORDS, analyzer: str = "simple", stemming: bool = False) -> DataFrame:
    """term, doc_id, is_upper of headline terms that begin with a letter."""
    occ = occurrences(docs, stop_words, analyzer, stemming, "headline")
    return occ.filter(F.col("term").rlike(r"^\p{L}")).select("term", "doc_id", "is_upper").distinct()


def corpus_stats(stats: DataFrame) -> DataFrame:
    """avl (mean length in whole terms), n_docs, total_terms."""
    total, n = F.coalesce(F.sum("doc_len"), F.lit(0)), F.count("*")
    return stats.agg(F.when(n > 0, F.floor(total / F.greatest(n, F.lit(1)))).otherwise(0).cast("long").alias("avl"), n.alias("n_docs"), total.alias("total_terms"))


def doc_entities(post: DataFrame, terms: DataFrame, most: int = ENTITIES) -> DataFrame:
    """A document's entities with the greatest tf, in upper case."""
    mine = post.join(terms.filter("is_entity").select("term"), "term")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term"))
    return mine.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", F.upper("term").alias("entity"), "tf", "rank")


def city_docs(post: DataFrame, terms: DataFrame, cities: DataFrame) -> DataFrame:
    """city, doc_id, tf: documents with a term that is always capitalised and names a city (but china)."""
    named = terms.filter("is_entity AND term <> 'china'").select("term").join(cities.select(F.lower("city").alias("term")).distinct(), "term", "left_semi")
    return post.join(named, "term").select(F.upper("term").alias("city"), "doc_id", "tf")


@dataclass
class Index:
    """The index tables of one corpus. buckets: of a written index, into how many parts its postings are dealt by term."""

    postings: DataFrame
    terms: DataFrame
    doc_stats: DataFrame
    headers: DataFrame
    entities: DataFrame
    city_docs: DataFrame
    cities: DataFrame
    corpus_stats: DataFrame
    languages: DataFrame
    buckets: int = 0


def build(docs: DataFrame, stop_words: Iterable[str] = STOP_WORDS, analyzer: str = "simple", stemming: bool = False, cities: DataFrame | None = None, countries: DataFrame | None = None) -> Index:
    """All tables of a corpus (doc_id, parent_file, city, lang, headline, text). What others are made of is written once; the rest is lazy.

    cities (city) are known besides those of the documents; countries (name, capital, population, currency_code) say more of them.
    """
    from lodestone.sources.corpus import city_info, languages

    post = materialize(postings(occurrences(docs, stop_words, analyzer, stemming)), "postings")
    n_docs = docs.count()
    terms = materialize(term_dictionary(post, n_docs), "terms")
    headers = materialize(header_index(docs, stop_words, analyzer, stemming), "headers")
    stats = materialize(doc_stats(post, docs, headers), "stats")
    known = docs.select("city").filter("city IS NOT NULL").distinct()
    known = known if cities is None else known.unionByName(cities.select("city")).distinct()
    if countries is None:
        countries = docs.sparkSession.createDataFrame([], "name string, capital string, population long, currency_code string")
    dictionary = city_info(known.select(F.upper("city").alias("city")).distinct(), countries)
    totals = materialize(corpus_stats(stats), "corpus")
    return Index(post, terms, stats, headers, doc_entities(post, terms), city_docs(post, terms, known), dictionary, totals, languages(docs))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


#: Tables that are written in an order of their own.
ORDERS = {"terms": "term", "doc_stats": "doc_id", "cities": "city", "languages": "lang"}


def write(index: Index, path: str, buckets: int = BUCKETS) -> None:
    """Writes the tables below path; postings are parted by a hash of the term and sorted by it, so a query reads few of them."""
    for name in TABLES:
        table = getattr(index, name)
        if name == "postings":
            table = table.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "term")
            table.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            table = table.orderBy(ORDERS[name]) if name in ORDERS else table
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    index.postings.sparkSession.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")


def open_index(spark: SparkSession, path: str) -> Index:
    """The tables of a written index; a path without one is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/layout/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise ValueError(f"no index at {path}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return Index(**tables, buckets=spark.read.parquet(f"{path}/layout").first()[0])


def posting_rows(index: Index, query: DataFrame) -> DataFrame:
    """term, doc_id, tf of the postings that a query's terms can have. Of a written index only these terms' parts are
    read: their numbers, of which there are no more than buckets, come to the driver and prune the scan."""
    rows = index.postings
    if index.buckets:
        wanted = [r[0] for r in query.select(bucket_of(F.col("term"), index.buckets)).distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(wanted)) if len(wanted) < index.buckets else rows
    return rows.select("term", "doc_id", "tf")


def probe(query: DataFrame, terms: DataFrame) -> DataFrame:
    """The query's rows whose term the dictionary has; rare terms, which it drops, find nothing."""
    return query.join(terms.select("term"), "term", "left_semi")


def drop_index(spark: SparkSession, path: str, confirm: bool = False) -> None:
    """Deletes an index's folder; only with confirm, and only where it holds the tables."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not confirm:
        raise ValueError("pass confirm=True to delete the index")
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/layout")):
        raise ValueError(f"no index at {path}")
    fs.delete(fs_path, True)
