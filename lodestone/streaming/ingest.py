"""Postings of documents as they arrive: a stream of files, indexed micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.index import occurrences, postings
from lodestone.operators.stop_words import STOP_WORDS


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def append_postings(stream: DataFrame, out: str, checkpoint: str, stop_words: Iterable[str] = STOP_WORDS, analyzer: str = "simple") -> StreamingQuery:
    """Appends each batch's postings to ``out``; a batch that is run again replaces its own rows."""

    def save(batch: DataFrame, epoch: int) -> None:
        made = postings(occurrences(batch, stop_words, analyzer))
        made.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
