"""Reports over an index: dictionary views, extremes, run summary, judgements and run files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dictionary(terms: DataFrame) -> DataFrame:
    """term and total_tf in the dictionary's order."""
    return terms.select(F.col("display_term").alias("term"), "total_tf").orderBy(F.lower("term"))


def extreme_terms(terms: DataFrame, n: int = 10, most: bool = True) -> DataFrame:
    order = [F.desc("total_tf"), F.asc("term")] if most else [F.asc("total_tf"), F.asc("term")]
    return terms.select("term", "total_tf").orderBy(*order).limit(n)


def greatest_tf(post: DataFrame) -> DataFrame:
    """The posting with the greatest tf; ties: least term, then least document."""
    return post.select("term", "doc_id", "tf").orderBy(F.desc("tf"), "term", "doc_id").limit(1)


def run_summary(terms: DataFrame, stats: DataFrame) -> DataFrame:
    one = terms.agg(F.count("*").alias("n")).withColumn("what", F.lit("terms"))
    two = stats.agg(F.count("*").alias("n")).withColumn("what", F.lit("documents"))
    return one.unionByName(two).select("what", "n")


def city_summary(cities: DataFrame) -> DataFrame:
    """Cities, and those without a country."""
    return cities.agg(F.count("*").alias("n_cities"), F.count_if(F.col("country").isNull()).alias("n_unknown"))


def judged_files(qrels: DataFrame, stats: DataFrame) -> DataFrame:
    """Relevant documents with their files."""
    return qrels.filter("relevance = 1").join(stats.select("doc_id", "parent_file"), "doc_id").select("query_id", "doc_id", "parent_file")


def to_trec(ranked: DataFrame) -> DataFrame:
    """Lines of a run file, in rank order within each query."""
    line = F.concat_ws(" ", F.col("query_id"), F.lit("0"), F.col("doc_id"), F.lit("1"), F.lit("float-sim"), F.lit("mt"))
    return ranked.orderBy("query_id", "rank").select(line.alias("line"))


def to_listing(ranked: DataFrame) -> DataFrame:
    """A readable list: a heading for each query, then its documents by rank."""
    heads = ranked.select("query_id").distinct().select("query_id", F.lit(0).alias("rank"), F.concat(F.lit("----QUERY ID: "), "query_id", F.lit("----")).alias("line"))
    rows = ranked.select("query_id", "rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("doc_id").cast("string")).alias("line"))
    return heads.unionByName(rows).orderBy("query_id", "rank").select("line")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files whose names sort as the lines do; each task writes its range of them."""
    lines.write.mode("overwrite").text(path)
