"""What several operators share: written tables in the shared folder, global ranks, text rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.storage import drop, shared_dir
from lodestone.operators.storage import materialize as written

__all__ = ["HOT_ROWS", "UPPER", "WORD", "ascii_lower", "crc_fold", "drop", "global_rank", "hot_join", "read", "release", "shared_dir", "slices", "with_arrow", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word, in Java's and in RE2's syntax.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in, which there does the same."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def global_rank(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """Adds a 0-based rank (long) over the whole table; order must be a total order but for equal rows.

    Rows are dealt by ranges of the order, sorted within each range and written once; a range's
    first rank is the number of rows in the ranges before it. No task sees more than its range, and
    the driver gets one count for each range.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    inner = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", inner)
    kept = written(dealt, name)
    part = F.shiftright("_at", 33)
    counts = sorted(kept.groupBy(part.alias("p")).count().collect())
    first, n = [0] * (counts[-1][0] + 1 if counts else 1), 0
    for p, k in counts:
        first[p] = n
        n += k
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    at = local + F.get(F.lit(first).cast("array<bigint>"), part.cast("int"))
    return kept.withColumn(rank, at).drop("_at")


#: Keys with more rows than this are joined by broadcast; there are at most rows / HOT_ROWS of them.
HOT_ROWS = 200_000


def hot_join(rows: DataFrame, keys: DataFrame, on: str | list[str], size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows with keys, which has one row for each value of ``on`` and in ``size`` how many rows have it.

    The rows of a hot key never meet in one task: hot keys, of which there can be no more than the rows'
    number over hot_rows, are broadcast, and the other keys are joined as Spark sees fit.
    """
    hot = keys.filter(F.col(size) > hot_rows)
    if hot.isEmpty():
        return rows.join(keys, on)
    names = [on] if isinstance(on, str) else on
    apart = rows.join(F.broadcast(hot.select(*names)), on, "left_anti")
    return apart.join(keys.filter(F.col(size) <= hot_rows), on).unionByName(rows.join(F.broadcast(hot), on))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about so many bytes of a column, one row at least."""
    if batch.num_rows:
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most_bytes
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        begin = 0
        for end in ends:
            yield batch.slice(begin, end - begin)
            begin = end


def release() -> None:
    """Gives a task's memory back, as a Python worker lives on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def with_arrow(df: DataFrame, inputs: list[str], fields: str, make: Callable[[], Callable[..., list[pa.Array]]], most_bytes: int = 1 << 20) -> DataFrame:
    """df with further columns that Python makes from Arrow columns, about most_bytes of the first input at a time.

    ``make`` runs once for each task and returns what turns the inputs' arrays into the new columns;
    ``fields`` is their DDL. Columns of the same names are replaced.
    """
    new = T.StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name not in new.names]
    schema = T.StructType(kept + new.fields)
    names = [f.name for f in kept]
    needed = [c for c in inputs if c not in names]
    rows_in = df.select(*[f"`{c}`" for c in names], *[F.col(f"`{c}`").alias(f"_in_{c}") for c in needed])
    first = f"_in_{inputs[0]}" if inputs[0] in needed else inputs[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for whole in batches:
            for batch in slices(whole, first, most_bytes):
                columns = [batch.column(f"_in_{c}" if c in needed else c) for c in inputs]
                made = convert(*columns)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=schema.names)
                del made, columns, batch
            del whole  # else two batches are held while the next one comes
            pa.default_memory_pool().release_unused()
        del convert
        release()

    return rows_in.mapInArrow(run, schema)
