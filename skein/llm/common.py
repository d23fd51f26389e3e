"""Shared pieces: the shared folder, written intermediate tables, row identity, batch slicing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..sources import shared
from ..sources.shared import fresh_path, shared_dir  # noqa: F401

#: Bytes of text that one vectorised step works on; bounds a Python worker's memory.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1 << 15


#: Rows of whole texts that Spark hands to a Python worker at once while a table is written; its default is meant for narrow rows.
BATCH_ROWS = 1000


def written(df: DataFrame, name: str) -> DataFrame:
    """As shared.written, in smaller Arrow batches; the session has its own setting back when the table is there."""
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        return shared.written(df, name)
    finally:
        spark.conf.set(setting, before)


def key_type(df: DataFrame, column: str) -> str:
    """The type in which an id travels: whole numbers as bigint, strings and any others as they are."""
    kind = df.select(column).schema[0].dataType
    return "bigint" if isinstance(kind, (T.IntegralType, T.NullType)) else kind.simpleString()


def key(df: DataFrame, column: str, name: str) -> Column:
    """An id column in the type in which it travels."""
    return F.col(column).cast(key_type(df, column)).alias(name)


#: Tasks of one step at most; beyond that each gets more rows.
MOST_TASKS = 50_000


def spread(df: DataFrame, rows: int, of: int, *columns: str) -> DataFrame:
    """df in tasks of about `of` of its rows, for steps whose work follows the rows and not the bytes."""
    return df.repartition(min(MOST_TASKS, max(1, -(-rows // of))), *columns)


def running(df: DataFrame, group: str, order: list[str], amount: str, name: str, most: bool = False) -> DataFrame:
    """df with the sum (or the most, null where there is none) of amount over the rows of its group before each, in order.

    Rows are sorted in ranges that cut large groups, too; what a range adds to the next is one row a range. df should be a
    written table: its ranges are found in a pass of their own.
    """
    fold = F.max if most else F.sum
    part, inner, before = (fresh(df, x) for x in ("rg_part", "rg_inner", "rg_before"))
    r = written(df.repartitionByRange(group, *order).withColumn(part, F.spark_partition_id()), "ranges")
    w = W.partitionBy(part, group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # of a range's groups only the first can have begun before it, and only the last can go on: two rows a range
    ends = r.groupBy(F.col(part).alias("p")).agg(F.min(F.struct(group)).alias("lo"), F.max(F.struct(group)).alias("hi"))
    ends = ends.select("p", F.explode(F.array_distinct(F.array(F.col(f"lo.{group}"), F.col(f"hi.{group}")))).alias("g"))
    same = (F.col(part) == F.col("p")) & F.col(group).eqNullSafe(F.col("g"))
    total = r.join(F.broadcast(ends), same).groupBy("p", "g").agg(fold(amount).alias(inner))
    carried = total.select("p", "g", fold(inner).over(W.partitionBy("g").orderBy("p").rowsBetween(W.unboundedPreceding, -1)).alias(before))
    out = r.join(F.broadcast(carried), same, "left")
    own = fold(amount).over(w)
    both = F.coalesce(F.greatest(own, before), own, before) if most else F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))
    return out.select(*df.columns, both.alias(name))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever extra columns it came with."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def text_key(text: Column) -> Column:
    """Tells rows of the same doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES):
    """Consecutive row ranges of a batch with at most `size` bytes of text each; a longer text stands alone, whole."""
    n = batch.num_rows
    if not n:
        return
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, k in enumerate(length.tolist()):
        if i > start and (total + k > size or i - start == SLICE_ROWS):
            yield batch.slice(start, i - start)
            pa.default_memory_pool().release_unused()
            start, total = i, 0
        total += k
    yield batch.slice(start, n - start)
    release()


def release() -> None:
    """Gives memory that is free back to the system: workers stay, idle, after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Normalised words of each text: white-space separated, lower case, letters and digits only, empty ones dropped.

    Returns the distinct words, each word's code into them, and offsets by text. Null texts have no words.
    """
    lists = pc.utf8_split_whitespace(pc.fill_null(text, ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    raw = lists.flatten().dictionary_encode()
    norm = pc.replace_substring_regex(pc.utf8_lower(raw.dictionary), r"[^\p{L}\p{N}]+", "").dictionary_encode()
    code = norm.indices.to_numpy()[raw.indices.to_numpy()] if len(raw) else np.zeros(0, np.int32)
    distinct = norm.dictionary
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:
        keep = code != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        code = code[keep]
    return distinct, code, offsets.astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], ..., starts[i] + lengths[i] - 1 for each i in turn."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def by_segment(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets; 0 for empty segments."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]
