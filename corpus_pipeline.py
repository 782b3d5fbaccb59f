"""A corpus pipeline over ``documents``: toxicity, line dedup, near-dedup, source mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup as lines
from lodestone.llm import minhash_dedup as near
from lodestone.llm import mixing, pieces, toxicity
from lodestone.llm.base import drop, read, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT = 0.5
#: Chunks that an encoding task keeps, beside what the stages before have left in use of an executor.
MOST_CHUNKS = 80_000


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under REJECT; the model learns from the labelled ones.

    Null and empty texts are scored as empty ones. Rows that repeat an id or a text are judged alike; null
    ids have no label and are scored. Without labels none goes. Further columns are left out.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), model, score_col="_toxicity")
    return scored.filter(F.col("_toxicity") < REJECT).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; a document all of whose lines go, goes. Null and empty texts stay as they are."""
    out = lines.line_dedup(docs.select(*COLUMNS))
    left = (F.col("lines_removed") == 0) | (F.col("lines_removed") < F.col("lines_total"))
    return _documents(out.filter(left))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five words, similarity 0.8): that of the least id, once where rows repeat it.

    Rows that share a kept id but not its text stay, null ids among them. Texts without words link with nothing and stay.
    Where decisions don't fit a broadcast the texts are dealt by id once, and repeated rows are found where they then lie, by
    two hashes of the text.
    """
    judged = near.near_dedup(docs)
    kept = judged.filter("kept").select("doc_id").distinct()
    mine = docs.select(*COLUMNS, F.xxhash64("text").alias("_h"), F.hash("text").alias("_h2"))
    out = mine.join(kept.filter("doc_id IS NOT NULL"), "doc_id")
    if not docs.filter("doc_id IS NULL").isEmpty() and not kept.filter("doc_id IS NULL").isEmpty():
        out = out.unionByName(mine.filter("doc_id IS NULL"))
    if not docs.select("doc_id").groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_h", "_h2"])
    return out.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one without words has no weight and isn't counted, but taken like its neighbours in size."""
    mixed = mixing.mix(docs, carry=("text", "lang", "source", "n_chars"))
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the piece ids of each text, their number, and whether they decode to the text. A null text has null ids and number 0."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.encode_and_decode(docs.select("doc_id", "source", "text"), path, most_chunks=MOST_CHUNKS)
    same = F.col("decoded").eqNullSafe(F.col("text"))
    return both.select("doc_id", "source", "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_ids"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("SentencePiece encoding", encode),
]
#: Toxicity, near-dedup by signatures and encoding aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{k}")
        drop(before)
    return docs
