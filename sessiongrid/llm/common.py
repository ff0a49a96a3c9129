"""Words, bounded bitmaps and ordered numbering shared by the operators."""

from __future__ import annotations

import ctypes
import inspect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessiongrid.sources.storage import stage

WORD = r"[^ \x09-\x0D]+"  # the same in Java, Python and RE2 syntax
SPACE = r"[ \x09-\x0D]+"

BITS = 1 << 24
_PER_ROW = 1 << 15  # bits in one value of bitmap_construct_agg


def release() -> None:
    """Give memory that this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def releasing(function):
    """``function`` of rows, or of batches, that does so when it is done with them.

    Python workers live on for later tasks and keep what they once took; an executor has several.
    """
    if inspect.isgeneratorfunction(function):

        def run(batches):
            try:
                yield from function(batches)
            finally:
                release()
    else:

        def run(rows):
            try:
                return function(rows)
            finally:
                release()

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str) -> Column:
    """Number of words of a text column as a long; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def key_bitmap(keys: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """One bit per hash of ``columns``: at most ``bits`` / 2**15 rows of 4 KiB, whatever the input.

    It only thins out rows before an exact join. With many more keys than bits every bit is
    set, nothing is thinned out, and results stay the same; pass more bits for some ten million keys.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    return (
        keys.select((place / _PER_ROW).cast("int").alias("_word"), (place % _PER_ROW).alias("_bit"))
        .groupBy("_word")
        .agg(F.bitmap_construct_agg("_bit").alias("_map"))
    )


def flag(rows: DataFrame, columns: list[str], bitmap: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """Add boolean ``name``: false only for rows whose key is certainly not in the bitmap."""
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    bit = place % _PER_ROW
    byte = F.conv(F.hex(F.substring("_map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, _shift) & 1") == 1
    return (
        rows.withColumn("_word", (place / _PER_ROW).cast("int"))
        .withColumn("_shift", (bit % 8).cast("int"))
        .join(F.broadcast(bitmap), "_word", "left")
        .withColumn("_byte", byte)
        .withColumn(name, F.coalesce(is_set, F.lit(False)))
        .drop("_word", "_shift", "_byte", "_map")
    )


def whole_row(rows: DataFrame) -> Column:
    """All columns as one, so that names of further columns cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")


def keep_rows(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose non-null ``column`` occurs in ``keys``; others are mostly dropped before the shuffle."""
    keys = keys.select(F.col(column).alias("key")).distinct()
    marked = flag(rows.select(whole_row(rows), F.col(column).alias("key")), ["key"], key_bitmap(keys, ["key"]), "near")
    return marked.filter("near").join(keys, "key", "left_semi").select("row.*")


def drop_rows(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` does not occur in ``keys``; most of them stay where they are."""
    keys = keys.select(F.col(column).alias("key")).distinct()
    marked = flag(rows.select(whole_row(rows), F.col(column).alias("key")), ["key"], key_bitmap(keys, ["key"]), "near")
    near = marked.filter("near").join(keys, "key", "left_anti")
    return marked.filter("not near").select("row.*").unionByName(near.select("row.*"))


def join_unique(rows: DataFrame, table: DataFrame, keys: list[str], hot: int = 1000, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each of the ``keys``; no key is null.

    A key held by more than one row in ``hot`` is spread over ``salts`` tasks, with a copy of its row of the
    table for each. There are fewer than ``hot`` such keys in any table, so they are broadcast.
    ``rows`` has to be a written table: its row numbers are the salts.
    """
    least = max(rows.count() // hot, 100)
    many = F.broadcast(rows.groupBy(*keys).count().filter(F.col("count") > least).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.col("_row"), F.lit(salts))).otherwise(F.lit(0))
    spread = rows.withColumn("_row", F.monotonically_increasing_id()).join(many, keys, "left").withColumn("_salt", salt.cast("int"))
    copies = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    copied = table.join(many, keys, "left").withColumn("_salt", copies).drop("_hot")
    return spread.drop("_hot", "_row").join(copied, [*keys, "_salt"]).drop("_salt")


def ordered_index(rows: DataFrame, *order: Column, partitions: int = 8) -> DataFrame:
    """Add ``index``: 0, 1, 2 ... in ``order`` (total), by ranges, none of them in one task."""
    ranged = stage(
        rows.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()), "ordered"
    )
    ends = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_part").withColumn("index", F.col("_start") + place - 1).drop(
        "_part", "_start"
    )
