"""The engine's surface: build, open, search, look up, report, drop."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import index as ix
from lodestone.operators import ranking, reports
from lodestone.operators.stop_words import STOP_WORDS


class Engine:
    """An index with its analysis settings. ``path`` has one index for each setting of stemming."""

    def __init__(self, spark: SparkSession, index: ix.Index, stop_words: Iterable[str] = STOP_WORDS, analyzer: str = "full", stemming: bool = False) -> None:
        self.spark, self.index = spark, index
        self.settings = {"stop_words": frozenset(stop_words), "analyzer": analyzer, "stemming": stemming}

    @staticmethod
    def _path(path: str, stemming: bool) -> str:
        return f"{path}/{'stemmed' if stemming else 'plain'}"

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, path: str, stop_words: Iterable[str] = STOP_WORDS, analyzer: str = "full", stemming: bool = False, cities: DataFrame | None = None, countries: DataFrame | None = None) -> Engine:
        """Indexes a corpus into path and opens the index. cities and countries as in index.build()."""
        if not path:
            raise ValueError("an index needs a path")
        if not stop_words:
            raise ValueError("an index needs a stop list")
        ix.write(ix.build(docs, stop_words, analyzer, stemming, cities, countries), cls._path(path, stemming))
        return cls.open(spark, path, stop_words, analyzer, stemming)

    @classmethod
    def open(cls, spark: SparkSession, path: str, stop_words: Iterable[str] = STOP_WORDS, analyzer: str = "full", stemming: bool = False) -> Engine:
        if not path:
            raise ValueError("an index needs a path")
        return cls(spark, ix.open_index(spark, cls._path(path, stemming)), stop_words, analyzer, stemming)

    @classmethod
    def drop(cls, spark: SparkSession, path: str, stemming: bool = False, confirm: bool = False) -> None:
        ix.drop_index(spark, cls._path(path, stemming), confirm)

    def terms(self) -> DataFrame:
        return reports.dictionary(self.index.terms)

    def search(self, text: str, **options) -> DataFrame:
        """One free-text query, without a description; an empty one is an error."""
        if not (text or "").strip():
            raise ValueError("a query needs a text")
        topics = self.spark.createDataFrame([("single query", text, "")], "query_id string, title string, description string")
        return self.search_topics(topics, **options)

    def search_topics(self, topics: DataFrame, **options) -> DataFrame:
        """All topics (query_id, title, description) in one plan. Options: cities, synonyms, limit, reference_cutoff."""
        if missing := {"query_id", "title", "description"} - set(topics.columns):
            raise ValueError(f"topics lack {sorted(missing)}")
        return ranking.search(self.index, topics, **self.settings, **options)

    def entities(self, doc_id) -> DataFrame:
        """The top entities of a document, least frequent first."""
        return self.index.entities.filter(F.col("doc_id") == F.lit(doc_id)).orderBy("tf", "entity").select("entity", "tf")

    def cities(self) -> DataFrame:
        return self.index.city_docs.select("city").distinct().orderBy("city")

    def city_dictionary(self) -> DataFrame:
        """city, country, currency, population."""
        return self.index.cities.orderBy("city")

    def to_trec(self, ranked: DataFrame) -> DataFrame:
        return reports.to_trec(ranked)
