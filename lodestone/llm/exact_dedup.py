"""Exact dedup by progressive refinement, with DataFrame functions only.

Three narrow steps, each over what the step before left: rows that share their length with another;
of these, rows that share length and prefix hash; of these, rows that share the hash of the whole text.
Only hashes, lengths and ids are shuffled, never a text.

Whole texts are read for the rows that are left after two steps. Their (length, prefix hash) keys go to
the scan as a broadcast while they are at most ``broadcast_bytes``. More keys than that don't travel:
then the scan makes each row's whole hash beside its prefix hash, and those of rows that didn't
survive are dropped. What comes out is the same either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import HOT_ROWS, ascii_lower, hot_join, read, written

PREFIX_CHARS = 256
#: Of keys that are broadcast: KEY_BYTES a key in Spark's table.
BROADCAST_BYTES = 64 << 20
KEY_BYTES = 64


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    broadcast_bytes: int = BROADCAST_BYTES,
    digest_all: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Groups of rows whose texts are equal after lower-casing A-Z; a null text counts as empty.

    Returns one row for each row of docs: doc_id, keep_id (largest id of the group), group_size,
    kept, text_sha256. The hash is null where a text was found alone before it was needed, unless
    digest_all. Ids sort with null lowest; a group of null ids keeps its null. Rows with both the
    same id and equal texts are the same document and all carry the group's result. Very long texts
    are hashed in their scan and travel as 32 bytes. An empty table gives an empty result; further columns are not read,
    whatever their names.
    """
    more = {} if hot_rows is None else {"hot_rows": hot_rows}
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.sha2(ascii_lower(F.col("_text")).cast("binary"), 256)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars))).alias("_head"),
        text.alias("_text"),
    )
    scanned = keyed.select("doc_id", "_len", "_head", *([whole.alias("text_sha256")] if digest_all else []))
    scanned = written(scanned, "exact-scan")
    lengths = scanned.groupBy("_len").agg(F.count("*").alias("_n")).filter("_n > 1")
    heads = hot_join(scanned.select("_len", "_head"), written(lengths, "exact-lengths"), "_len", "_n", **more)
    heads = written(heads.groupBy("_len", "_head").agg(F.count("*").alias("_m")).filter("_m > 1"), "exact-heads")
    n, rows = heads.count(), scanned
    if not digest_all:
        if n * KEY_BYTES <= broadcast_bytes:
            marked = keyed.join(F.broadcast(heads.withColumn("_more", F.lit(True))), ["_len", "_head"], "left")
            rows = marked.select("doc_id", "_len", "_head", F.when(F.coalesce("_more", F.lit(False)), whole).alias("text_sha256"))
        else:
            rows = keyed.select("doc_id", "_len", "_head", whole.alias("text_sha256"))
        rows = written(rows, "exact-rows")
    # One narrow join marks the rows that are left: hot keys by broadcast, the others as Spark sees fit.
    marks = heads.withColumn("_more", F.lit(True))
    hot = F.broadcast(marks.filter(F.col("_m") > (hot_rows or HOT_ROWS)))
    cold = marks.filter(F.col("_m") <= (hot_rows or HOT_ROWS))
    early = rows.join(hot.drop("_m"), ["_len", "_head"], "left")
    left = early.filter("_more IS NULL").drop("_more").join(cold.drop("_m"), ["_len", "_head"], "left")
    marked = written(early.filter("_more").unionByName(left).select("doc_id", "text_sha256", F.coalesce("_more", F.lit(False)).alias("_more")), "exact-marked")
    survivors = marked.filter("_more").drop("_more")
    same = survivors.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = written(same, "exact-same")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    joined = hot_join(survivors, same, "text_sha256", "group_size", **more).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    digest = F.col("text_sha256") if digest_all else F.lit(None).cast("string").alias("text_sha256")
    alone = marked.filter("NOT _more").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    return joined.select(*out).unionByName(alone.select(*out))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
