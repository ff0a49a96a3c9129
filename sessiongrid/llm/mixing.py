"""Mixing sources to target weights by capped water-filling.

Targets share the budget by weight; a source whose share exceeds ``max_epochs`` times its size
is clamped there and the excess goes to the others by weight, again and again until no share
is too large. A source is then taken in whole repetitions of all its documents and one
fractional repetition of some of them: those first in a seeded hash order, up to the document
in whose middle the target lies, so the source ends within half a document of its target.

Running sums are taken over hash buckets first, and over single rows only in the one bucket of
each source that holds its target, so a source with any share of all rows is spread evenly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessiongrid.llm.common import whole_row
from sessiongrid.sources.storage import stage

ROWS_PER_BUCKET = 5_000


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source_size, weight) rows. Two sums reach the driver in each round.

    Sources without weight or size get 0. If the budget exceeds all caps, every source gets
    its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(0)).cast("double")
    level, clamped = 0.0, -1
    while True:
        over = (cap <= weight * F.lit(level)) if clamped >= 0 else F.lit(False)
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("full"),
            F.sum(F.when(over, 0.0).otherwise(weight)).alias("weight"),
            F.sum(over.cast("long")).alias("clamped"),
        ).first()
        if not row["weight"]:
            level = math.inf if row["clamped"] else 0.0
            break
        if row["clamped"] == clamped:
            break
        level, clamped = (budget - row["full"]) / row["weight"], row["clamped"]
    share = F.when(weight > 0, weight * F.lit(level)).otherwise(0.0)
    return sources.withColumn("target", F.least(cap, share))


def mix_sources(
    docs: DataFrame,
    sources: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
    max_epochs: float = 2.0,
    seed: int = 0,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    mark_col: str | None = None,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target and ``copies`` to take of it.

    ``sources`` has ``source_col``, source_size and target (see ``water_fill``); a null source is
    a source like any other. The order is a hash of the id and of ``mark_col``, which tells rows
    of one id, or of none, apart (a hash of the text, say); rows equal in both share their place
    in it. Documents without words take no part in the sums. Empty input gives an empty result.
    """
    h = F.xxhash64(F.lit(seed), F.col("_id"), F.col("_mark"))
    buckets = max(1, math.ceil(docs.count() / rows_per_bucket))
    plan = sources.select(
        F.col(source_col).alias("_source"),
        "source_size",
        "target",
        F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(math.floor(max_epochs))).alias("_whole"),
    ).withColumn(
        "_part",
        F.when(F.col("_whole") < max_epochs, F.col("target") - F.col("_whole") * F.col("source_size")).otherwise(0.0),
    )
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        F.col(size_col).alias("_size"),
        (F.col(mark_col) if mark_col else F.lit(0)).alias("_mark"),
    ).withColumn("_bucket", F.pmod(h, F.lit(buckets)))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        rows.groupBy("_source", "_bucket")
        .agg(F.sum("_size").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .withColumnRenamed("_source", "_s")
    )
    cuts = cuts.join(plan, F.col("_s").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "_state",
        F.when(F.col("_base") + F.col("_sum") <= F.col("_part"), "all")
        .when(F.col("_base") >= F.col("_part"), "none")
        .otherwise("some"),
    ).withColumnRenamed("_bucket", "_b")
    placed = rows.join(cuts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    some = F.col("_state") == "some"
    inside = Window.partitionBy("_source", "_bucket").orderBy(h, "_id", "_mark", "_size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    start = F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    cut = placed.filter(some).withColumn("_taken", (start + F.col("_size") / 2 <= F.col("_part")).cast("long"))
    rest = placed.filter(~some).withColumn("_taken", (F.col("_state") == "all").cast("long"))
    return cut.unionByName(rest).select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("_size").alias(size_col),
        "source_size",
        "target",
        (F.col("_whole") + F.col("_taken")).alias("copies"),
        *([F.col("_mark").alias(mark_col)] if mark_col else []),
    )


def source_sizes(docs: DataFrame, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """Size of every source, written once: the rounds of ``water_fill`` read only this table."""
    return stage(docs.groupBy(source_col).agg(F.sum(size_col).alias("source_size")), "sources")


def repeat_rows(docs: DataFrame, copies: DataFrame, key: dict[str, Column], count_col: str = "copies") -> DataFrame:
    """``docs``, each row as often as ``copies`` says for its key: column of ``copies`` to expression.

    ``copies`` has a row for each row of ``docs``. Rows of one key are taken to be equal: together they are
    repeated as often as their counts add up to, shared out evenly. Nulls equal each other; rows
    without copies go. The columns stay as they are.
    """
    counts = copies.groupBy(*key).agg(F.sum(count_col).alias("_sum"), F.count("*").alias("_rows")).filter("_sum > 0")
    even = (F.col("_sum") / F.col("_rows")).cast("long")
    counts = counts.select(*key, even.alias("_each"), (F.col("_sum") - even * F.col("_rows")).alias("_more"))
    rows = docs.select(whole_row(docs), *(e.alias(f"of_{c}") for c, e in key.items()))
    same = [F.col(f"of_{c}").eqNullSafe(F.col(c)) for c in key]
    joined = rows.join(counts, same)
    # Only where the counts of equal rows differ are these numbered: in each source at most one key.
    in_key = Window.partitionBy(*(f"of_{c}" for c in key)).orderBy(F.lit(0))
    uneven = joined.filter("_more > 0").withColumn("_each", F.col("_each") + (F.row_number().over(in_key) <= F.col("_more")).cast("long"))
    every = joined.filter("_more = 0").select("row", "_each").unionByName(uneven.select("row", "_each")).filter("_each > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("_each").cast("int")))).select("row.*")
