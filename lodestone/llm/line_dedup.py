"""Line dedup by distinct-site spread, with DataFrame functions only.

Each distinct line gets a HyperLogLog sketch of the sites that have it; sketches are built before the
shuffle and merged after it. Lines whose estimate is near the threshold get exact distinct counts.
A line on min_sites sites or more is boilerplate, a long one on passage_sites: its first occurrence stays, all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import HOT_ROWS, WORD, hot_join, read, written

MIN_SITES = 3
MIN_CHARS = 12
#: Lines of so many words are passages, for which fewer sites are enough.
PASSAGE_WORDS = 50
PASSAGE_SITES = 2
LG_K = 12
#: Three standard errors of a sketch of 2^LG_K registers.
BAND = 3 * 1.04 / 2 ** (LG_K / 2)
#: So many lines at most are handed to the tasks as a table in memory (some 60 bytes a line).
BROADCAST_LINES = 200_000
BUCKETS = 1 << 14
KEY = ["key", "check"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> tuple[Column, Column]:
    """A line's identity: 64 bits of one hash and 32 of another."""
    return F.xxhash64(F.trim(line)), F.hash(F.trim(line))


def _keyed(lines: DataFrame, min_chars: int, *columns: str) -> DataFrame:
    key, check = line_key(F.col("line"))
    return lines.filter(F.length(F.trim("line")) >= min_chars).select(*columns, key.alias("key"), check.alias("check"))


def shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, broadcast_lines: int = BROADCAST_LINES, passage_words: int = PASSAGE_WORDS, passage_sites: int = PASSAGE_SITES) -> DataFrame:
    """Lines on enough sites: key, check, n (occurrences), sites, first (struct of doc_id and pos). docs: doc_id, text, site."""
    exploded = docs.select("doc_id", "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    least = F.when(F.regexp_count("line", F.lit(WORD)) >= passage_words, passage_sites).otherwise(min_sites)
    lines = _keyed(exploded.withColumn("least", least), min_chars, "doc_id", "site", "pos", "least")
    sketched = lines.groupBy(*KEY).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"), F.min("least").alias("least"), F.count("*").alias("n"))
    spread = sketched.select(*KEY, "n", "first", "least", F.hll_sketch_estimate("sketch").alias("sites"))
    # Of a few sites a sketch holds each one, so its estimate is off by less than half a site.
    low, high = F.col("least") * (1 - BAND) - 0.5, F.col("least") * (1 + BAND) + 0.5
    wide = written(spread.filter(F.col("sites") >= low), "line-spread")
    near = wide.filter(F.col("sites") <= high)
    keys = near.select(*KEY)
    if near.count() <= broadcast_lines:
        pairs = lines.join(F.broadcast(keys), KEY, "left_semi").select(*KEY, "site").distinct()
    else:  # a line that is anywhere has one row a site and task here
        pairs = lines.select(*KEY, "site").distinct().join(keys, KEY, "left_semi")
    exact = pairs.groupBy(*KEY).agg(F.count("*").alias("exact"))
    counted = near.join(exact, KEY).filter(F.col("exact") >= F.col("least")).select(*KEY, "n", F.col("exact").alias("sites"), "first")
    clear = wide.filter(F.col("sites") > high).select(*KEY, "n", "sites", "first")
    return written(clear.unionByName(counted), "line-shared")


def _table(shared: DataFrame) -> DataFrame:
    """One row: an array of BUCKETS arrays of (key, check, first), by key modulo BUCKETS."""
    spark = shared.sparkSession
    entries = shared.groupBy(F.pmod("key", F.lit(BUCKETS)).alias("bucket")).agg(F.collect_list(F.struct("key", "check", "first")).alias("items"))
    every = spark.range(0, BUCKETS, 1, 1).withColumnRenamed("id", "bucket").join(entries, "bucket", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "items"))), lambda x: x["items"]).alias("table"))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
    broadcast_lines: int = BROADCAST_LINES,
    passage_words: int = PASSAGE_WORDS,
    passage_sites: int = PASSAGE_SITES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows of docs, their texts without boilerplate lines, and lines_total and lines_removed.

    Lines are what newlines part, compared without blanks at their ends; lines of fewer than min_chars
    characters always stay. A line is boilerplate on min_sites sites, one of passage_words words or more on passage_sites. A null site counts as one site. A null text stays null and has 0 lines; an
    empty one has one empty line. Of a boilerplate line the occurrence with the least id, then the least place, stays (a null id is
    least); rows that share the id keep that place alike. Columns of docs called lines_total or lines_removed are replaced.

    While there are at most broadcast_lines boilerplate lines, each task looks lines up in a table in
    memory and no text is shuffled; beyond that lines and boilerplate are joined by key.
    """
    columns = [c for c in docs.columns if c not in ("lines_total", "lines_removed")]
    site = F.coalesce(F.col(site_col).cast("string"), F.lit("\0"))
    shared = shared_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), site.alias("site")), min_sites, min_chars, broadcast_lines, passage_words, passage_sites)
    if shared.count() <= broadcast_lines:
        table = _table(shared).scalar()
        rows = docs.select(F.struct(*columns).alias("_doc"), table.alias("_table"))

        def stays(line: Column, pos: Column) -> Column:
            key, check = line_key(line)
            bucket = F.get(F.col("_table"), F.pmod(key, F.lit(BUCKETS)).cast("int"))
            first = F.struct(F.col(f"_doc.{id_col}").alias("doc_id"), pos.alias("pos"))
            gone = F.exists(bucket, lambda x: (x["key"] == key) & (x["check"] == check) & ~x["first"].eqNullSafe(first))
            return (F.length(F.trim(line)) < min_chars) | ~F.coalesce(gone, F.lit(False))

        kept = F.filter(_lines(F.col(f"_doc.{text_col}")), stays)
    else:
        rows = written(docs.select(F.struct(*columns).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "line-docs")
        lines = rows.select("_row", F.col(f"_doc.{id_col}").alias("doc_id"), F.posexplode(_lines(F.col(f"_doc.{text_col}"))).alias("pos", "line"))
        lines = _keyed(lines, min_chars, "_row", "doc_id", "pos")
        gone = hot_join(lines, shared, KEY, "n", hot_rows).filter(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
        rows = rows.join(gone.groupBy("_row").agg(F.collect_set("pos").alias("_gone")), "_row", "left")
        kept = F.filter(_lines(F.col(f"_doc.{text_col}")), lambda _, pos: ~F.coalesce(F.array_contains("_gone", pos), F.lit(False)))
    total = F.coalesce(F.size(_lines(F.col(f"_doc.{text_col}"))), F.lit(0))
    rows = rows.select("_doc", kept.alias("_kept"), F.greatest(total, F.lit(0)).cast("long").alias("lines_total"))
    removed = F.when(F.col("_kept").isNull(), 0).otherwise(F.col("lines_total") - F.size("_kept")).cast("long")
    text = F.array_join("_kept", "\n", "")
    out = [text.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in columns]
    return rows.select(*out, "lines_total", removed.alias("lines_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines_total, lines_removed, kept_chars, text_sha256 of the text that stays."""
    out = line_dedup(read(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lines_total", "lines_removed", F.length(text).cast("long").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM d),
s AS (
  SELECT trim(line) AS line, min((doc_id, pos)) AS f FROM l WHERE length(trim(line)) >= {MIN_CHARS}
  GROUP BY trim(line)
  HAVING count(DISTINCT site) >= CASE WHEN len(regexp_extract_all(trim(line), '[^\x20\x09-\x0D]+')) >= {PASSAGE_WORDS} THEN {PASSAGE_SITES} ELSE {MIN_SITES} END),
m AS (SELECT l.*, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.f AS gone FROM l LEFT JOIN s ON trim(l.line) = s.line),
g AS (
  SELECT rid, any_value(doc_id) AS doc_id, count(*) AS lines_total, count(*) FILTER (gone) AS lines_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM m GROUP BY rid)
SELECT doc_id, lines_total, lines_removed, length(t) AS kept_chars, sha256(t) AS text_sha256 FROM g
"""
