"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import WORD, global_rank, read, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
#: Expected copies are held in units of 2^-32, so that prefix sums are exact.
UNIT = 1 << 32


def fill(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds target to rows of (source_size, weight): shares of all sizes by weight, at most ``most`` times the size.

    What is above is shared again by weight among the others until none is above. Each round is one
    aggregate over the sources and ends when no further source reaches its limit.
    """
    whole = F.sum("source_size").cast("decimal(38,0)")
    total = sources.agg(whole).head()[0] or 0
    capped_size, free_weight, reached = 0, None, -1
    while True:
        if free_weight is None:
            over = F.lit(False)
        else:  # most * size <= weight * rest / free_weight, in whole numbers
            rest = F.lit(total - most * capped_size).cast("decimal(38,0)")
            over = F.col("source_size").cast("decimal(38,0)") * most * F.lit(free_weight) <= F.col("weight") * rest
        n, capped, free = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))
        ).head()
        if n == reached:
            break
        reached, capped_size, free_weight = n, int(capped or 0), int(free or 0)
        if not free_weight:
            over = F.lit(True)
            break
    rest = total - most * capped_size
    share = (F.col("weight") * F.lit(int(rest))).cast("double") / F.lit(float(free_weight or 1))
    return sources.withColumn("target", F.when(over, (F.col("source_size") * most).cast("double")).otherwise(share))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often each document goes into the mix.

    Documents stand in each source by (size, id). A document's expected copies are its source's
    target over its source's size; their prefix sums, moved by one random offset for the source (from the
    seed and its name, so reruns agree), cross a whole number once for each copy taken. As sizes ascend, any run of documents of like size gets
    its exact share to within one copy, and so words come near the target.

    Returns doc_id, size (words; null text: 0), source_size, target, copies, taken (size * copies) and
    the columns in carry. Sources weigh ``weights`` in turn by code point, null last. A source whose
    size is 0 has target 0 and its documents no copies. Rows with equal id, source and size stand in the order
    of two hashes of their texts, so reruns take the same text; rows equal in all of these are the same document. A text of any
    length counts whole. Further columns are ignored, whatever their names.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    same = F.xxhash64(F.col(text_col)), F.hash(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), size.alias("size"), same[0].alias("_h"), same[1].alias("_h2"), *carry)
    if not carry:  # narrow rows: written once, so that words aren't counted again where ranges are sampled
        rows = written(rows, "mix-narrow")
    order = [F.col("_source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_h2")]
    ranked = global_rank(rows, order, "_rank", "mix-rows")
    by_source = ranked.groupBy("_source").agg(F.sum("size").alias("source_size"), F.min("_rank").alias("_first"))
    by_source = global_rank(by_source, [F.col("_source").asc_nulls_last()], "_place", "mix-sources")
    turn = F.array(*[F.lit(w) for w in weights])
    by_source = by_source.withColumn("weight", turn[(F.col("_place") % len(weights)).cast("int")].cast("long"))
    targets = written(fill(by_source, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("decimal(20,0)")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_source"), F.lit("")))
    offset = F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("decimal(20,0)")
    targets = targets.select("_source", "source_size", "target", "_first", rate.alias("_rate"), offset.alias("_offset"))
    joined = ranked.join(targets, ranked["_source"].eqNullSafe(targets["_source"])).drop(targets["_source"])

    def crossed(k: Column) -> Column:
        return F.floor((F.col("_offset") + k.cast("decimal(18,0)") * F.col("_rate")) / UNIT)

    k = F.col("_rank") - F.col("_first")
    copies = (crossed(k + 1) - crossed(k)).cast("long")
    out = joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select("doc_id", "size", "source_size", "target", "copies", "taken", *carry)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("copies")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM d GROUP BY source),
tot AS (SELECT sum(source_size)::BIGINT AS total, sum(weight)::BIGINT AS w FROM s),
cut AS (
  SELECT 0 AS round, -1::BIGINT AS n, total AS rest, w AS free FROM tot
  UNION ALL
  SELECT round + 1, k, r, f FROM (
    SELECT c.round, c.n,
      (SELECT count(*) FROM s WHERE 3 * s.source_size::HUGEINT * c.free <= s.weight * c.rest::HUGEINT)::BIGINT AS k,
      ((SELECT total FROM tot) - 3 * coalesce((SELECT sum(source_size) FROM s WHERE 3 * s.source_size::HUGEINT * c.free <= s.weight * c.rest::HUGEINT), 0))::BIGINT AS r,
      coalesce((SELECT sum(weight) FROM s WHERE NOT 3 * s.source_size::HUGEINT * c.free <= s.weight * c.rest::HUGEINT), 0)::BIGINT AS f
    FROM cut c) WHERE k <> n AND f > 0),
last AS (SELECT rest, free FROM cut ORDER BY round DESC LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN 3 * source_size::HUGEINT * free <= weight * rest::HUGEINT THEN (3 * source_size)::DOUBLE
         ELSE (weight * rest)::DOUBLE / free::DOUBLE END AS target
  FROM s, last),
r AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size * 4294967296 ELSE 0 END)::HUGEINT AS rate,
    ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 8))::HUGEINT AS u
  FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS k FROM d)
SELECT doc_id, size, source_size, target,
  (size * ((u + (k + 1) * rate) // 4294967296 - (u + k * rate) // 4294967296))::BIGINT AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
"""
