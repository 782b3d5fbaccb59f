"""Sources: SGML news files, topic files, relevance judgements, stop lists and driver tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.terms import clean

STOP_FILE = "stop_words.txt"
DOCUMENT = "doc_id string, parent_file string, city string, lang string, headline string, text string"


def _piece(line: str, at: str, k: int) -> str | None:
    parts = [p for p in re.split("[" + re.escape(at) + "]", line) if p]
    return parts[k] if k < len(parts) else None


def parse_document(block: str) -> dict[str, str | None] | None:
    """One <DOC> block to a record; None where it has no document number.

    City and language are those of this block alone. A line that only opens or closes a tag is no
    text; headline, field and date lines inside <TEXT> are.
    """
    out: dict[str, str | None] = {"doc_id": None, "city": None, "lang": None}
    headline: list[str] = []
    text: list[str] = []
    in_text = wants_headline = False
    for line in block.splitlines():
        if line in ("<DOC>", "</TEXT>", "</DOC>"):
            continue
        if line == "<TEXT>":
            in_text = True
            continue
        if wants_headline:
            if line.startswith("<"):
                continue
            headline.append(line)
            wants_headline = False
        if line.startswith("<F P=106>"):
            line = _piece(line, "><", 1) or ""
        if "P>" in line:
            line = _piece(line, ">", 1) or line
        if line == "<HEADLINE>":
            wants_headline = True
        elif line.startswith("<H3> <TI>"):
            headline.append(_piece(line, "><", 3) or "")
        elif re.match("<H[1-5]>", line):
            headline.append(_piece(line, "><", 1) or "")
        if not in_text and line.startswith("<F P=104>") and len(line.split()) >= 4:
            out["city"] = clean(line.split()[2].upper()) or None
        if "<F P=105>" in line:
            after = line.partition("P=105")[2]
            lang = (_piece(after, "> <", 0) or "").upper()
            out["lang"] = lang or out["lang"]
        if line.startswith("<DOCNO>"):
            out["doc_id"] = _piece(line, "<> ", 1)
        if in_text and not (line.startswith("<") and not line.startswith(("<H", "<F", "<DATE"))):
            text.append(line)
    if not out["doc_id"]:
        return None
    return out | {"headline": " ".join(headline), "text": " ".join(text)}


def read_sgml(spark: SparkSession, path: str) -> DataFrame:
    """Every document below a folder. Files are split at </DOC>, so large ones are read in parallel."""
    blocks = spark.read.option("recursiveFileLookup", "true").option("lineSep", "</DOC>").text(path)
    blocks = blocks.select(F.col("_metadata.file_name").alias("file"), "value").filter(F.col("file") != STOP_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True)
            rows = [r | {"parent_file": f} for f, v in pairs if (r := parse_document(v))]
            names = [c.split()[0] for c in DOCUMENT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.string()) for n in names], names=names)

    return blocks.mapInArrow(run, DOCUMENT)


def languages(docs: DataFrame) -> DataFrame:
    """Distinct languages in order, without numeric ones."""
    return docs.select("lang").filter("lang IS NOT NULL AND NOT lang RLIKE '^[0-9.,]+$'").distinct().orderBy("lang")


def read_stop_words(spark: SparkSession, path: str) -> frozenset[str]:
    """The words of a stop list of one word a line; a missing file is an error."""
    return frozenset(r[0] for r in spark.read.text(path).collect())


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """query_id, title, description, narrative of a topic file; what follows the last topic is no query."""
    blocks = spark.read.option("lineSep", "</top>").text(path)

    def section(tag: str) -> F.Column:
        return F.trim(F.regexp_replace(F.regexp_extract("value", rf"(?s)<{tag}>[^\n]*\n(.*?)(?=<[a-z]+>|$)", 1), r"\s+", " "))

    number = F.regexp_extract("value", r"<num>\s*\S+\s+(\S+)", 1)
    out = blocks.select(number.alias("query_id"), F.trim(F.regexp_extract("value", r"<title>[ ]*([^\n]*)", 1)).alias("title"), section("desc").alias("description"), section("narr").alias("narrative"))
    return out.filter("query_id <> ''")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Relevance judgements: query_id, iter, doc_id, relevance."""
    return spark.read.schema("query_id int, iter string, doc_id string, relevance int").option("sep", " ").csv(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out anew where a table has fewer splits than there are cores (one small file); large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as a corpus."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    return docs.select("doc_id", F.col("source").alias("parent_file"), F.lit(None).cast("string").alias("city"), "lang", F.lit("").alias("headline"), "text")


def from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``pages`` table as a corpus: titles as headlines, what isn't markup as text."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    head = F.concat_ws(" ", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1))
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), F.lit(None).cast("string").alias("parent_file"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("lang"), head.alias("headline"), body.alias("text"))


def related_words(spark: SparkSession, json: DataFrame) -> DataFrame:
    """Synonyms from rows of (term, json), a JSON array of objects with a word each: term, related, rank."""
    words = F.from_json("json", "array<struct<word:string>>")
    return json.select("term", F.posexplode(words).alias("rank", "w")).select("term", F.col("w.word").alias("related"), (F.col("rank") + 1).alias("rank"))


COUNTRY = "array<struct<name:string,capital:string,population:bigint,currencies:array<struct<code:string>>>>"


def countries_from_json(feed: DataFrame, json_col: str = "json") -> DataFrame:
    """name, capital, population, currency_code (the first of several) from rows of JSON arrays of countries; unreadable rows give none."""
    found = feed.select(F.inline(F.from_json(json_col, COUNTRY)))
    return found.select("name", "capital", "population", F.get("currencies.code", F.lit(0)).alias("currency_code"))


def city_info(cities: DataFrame, countries: DataFrame) -> DataFrame:
    """Cities with country, currency and population of the country whose capital they are: by full name, else by its first word."""
    from lodestone.functions.text import population_text

    capitals = countries.select(F.lower("capital").alias("capital"), F.col("name").alias("country"), F.col("currency_code").alias("currency"), population_text(F.col("population")).alias("population"))
    first = capitals.withColumn("capital", F.split("capital", " ")[0]).groupBy("capital").agg(*[F.min(c).alias(c + "_1") for c in ("country", "currency", "population")])
    out = cities.withColumn("_k", F.lower("city"))
    out = out.join(capitals, out["_k"] == capitals["capital"], "left").drop("capital")
    out = out.join(first, out["_k"] == first["capital"], "left").drop("capital")
    return out.select("city", *[F.coalesce(c, c + "_1").alias(c) for c in ("country", "currency", "population")])

