"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are compared after white space runs became one space; a null text counts as empty.
Length and prefix hash come from one narrow scan. Only documents whose (length, prefix hash)
is shared have their full content hashed, in a second scan: a bitmap of fixed size tells the
scan which rows to hash, so texts are never shuffled and nothing that grows is broadcast.

Nulls, ties and repeats: an id that is null counts as larger than any other. Of several rows
with the id that stays, exactly one is kept. An empty table gives an empty result. Other
columns of the input are not touched, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.llm.common import BITS, SPACE, drop_rows, flag, join_unique, key_bitmap, whole_row
from sessiongrid.sources.storage import stage

PREFIX = 256


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix: int = PREFIX,
    hash_singles: bool = False,
    bits: int = BITS,
) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, full_hash.

    ``full_hash`` is null where an earlier level has already shown that the text occurs once,
    unless ``hash_singles`` asks for it.
    """
    levels = ["_length", "_prefix"]
    keyed = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_text")).select(
        "_id",
        "_text",
        F.length("_text").alias("_length"),
        F.xxhash64(F.substring("_text", 1, prefix)).alias("_prefix"),
    )
    shared = keyed.groupBy(*levels).count().filter("count > 1")
    survivors = flag(keyed, levels, key_bitmap(shared, levels, bits), "_shared", bits)
    full = F.sha2(F.col("_text"), 256)
    hashed = survivors.select(
        "_id", *levels, "_shared", (full if hash_singles else F.when(F.col("_shared"), full)).alias("_full")
    )
    # Repeated rows of one id are counted here, before any join.
    counted = stage(hashed.groupBy("_id", *levels, "_shared", "_full").agg(F.count("*").alias("_rows")), "hashes")
    same = [*levels, "_full"]
    groups = (
        counted.filter("_shared")
        .groupBy(*same)
        .agg(F.min("_id").alias("keep_id"), F.sum("_rows").alias("group_size"))
    )
    single = counted.filter(~F.col("_shared")).select(
        "*", F.col("_id").alias("keep_id"), F.col("_rows").alias("group_size")
    )
    grouped = join_unique(counted.filter("_shared"), groups, same)  # copies of one text may be many
    turn = F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))
    return (
        grouped.select(single.columns)
        .unionByName(single)
        .select("*", turn.alias("_turn"))
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_turn") == 1)).alias("kept"),
            F.col("_full").alias("full_hash"),
        )
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the smallest id, columns as they are."""

    def key(full):
        return F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), full)

    found = stage(exact_dedup(docs, id_col, text_col).filter(~F.col("kept")), "dropped")
    own = F.col(id_col).eqNullSafe(F.col("keep_id"))
    others, again = (found.filter(f).select(key("full_hash").alias("_key")) for f in (~own, own))
    keyed = docs.select(whole_row(docs), key(F.sha2(normalised(text_col), 256)).alias("_key"))
    rest = drop_rows(keyed, others, "_key")
    # Further rows of an id that stays; other rows have keys of their own.
    marked = flag(rest, ["_key"], key_bitmap(again, ["_key"]), "_near")
    single = marked.filter("_near").dropDuplicates(["_key"])
    return marked.filter(~F.col("_near")).unionByName(single).select("row.*")
