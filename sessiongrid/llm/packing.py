"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. In a block of pieces, sorted from long to short, a
piece goes to the open bin that it leaves the least space in. If none can hold it, a bin is
opened at the length that costs least for each word it can be expected to hold: its own words
and as many of the words still to come as fit. At the end every bin shrinks to the shortest
permitted length that holds its contents.

Documents longer than the longest permitted length are cut into pieces of it, no word is lost.
Blocks are made by hash, have a bounded number of pieces and are packed independently.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (256, 512, 1024, 2048, 4096)
PIECES_PER_BLOCK = 20_000
OVERHEAD = 16


def sequence_cost(length: int) -> float:
    """Default cost of a sequence: its words and a fixed amount for having one more of them."""
    return length + OVERHEAD


def best_fit(
    sizes: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float] = sequence_cost
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size (from 1 to the largest capacity), and the length of each bin."""
    capacities = sorted(set(capacities))
    prices = {c: cost(c) for c in capacities}
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    space: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by free words
    some = 0  # bit s is set if an open bin has s words free
    filled: list[int] = []
    left = int(sum(sizes))
    for i in order.tolist():
        size = int(sizes[i])
        left -= size
        fits = some >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = space[free].pop()
            if not space[free]:
                some &= ~(1 << free)
        else:
            _, free = min((prices[c] / (size + min(c - size, left)), c) for c in capacities if c >= size)
            b = len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        if free > size:
            space[free - size].append(b)
            some |= 1 << (free - size)
    lengths = np.asarray(capacities)[np.searchsorted(capacities, filled)] if filled else np.zeros(0, dtype=np.int64)
    return bins, offsets, lengths


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    size_col: str = "size",
    capacities: Sequence[int] = CAPACITIES,
    pieces_per_block: int = PIECES_PER_BLOCK,
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """One row per piece: id, piece, start and n_words in the document; block, bin, its capacity
    and the piece's offset in it.

    A document without words is one piece of 0 words in no bin (nulls). Repeated rows are packed
    as often as they occur; equal sizes keep the order of ids (null first). Empty in, empty out.
    """
    longest = max(capacities)
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    pieces = docs.select(F.col(id_col).alias("_id"), size.alias("_size")).select(
        "_id",
        "_size",
        F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_size") - 1, F.lit(0)), F.lit(longest).cast("long"))).alias("piece", "start"),
    ).withColumn("n_words", F.least(F.col("_size") - F.col("start"), F.lit(longest)))
    sums = pieces.agg(F.count("*")).first()
    blocks = max(1, math.ceil(sums[0] / pieces_per_block))
    kind = docs.schema[id_col].dataType.simpleString()
    limits = sorted(set(capacities))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "_id", "piece"], ascending=[False, True, True], na_position="first", kind="stable")
        bins, offsets, lengths = best_fit(rows["n_words"].to_numpy(), limits, cost)
        return rows.assign(bin=bins, capacity=lengths[bins], offset=offsets)[
            ["_id", "piece", "start", "n_words", "block", "bin", "capacity", "offset"]
        ]

    full = pieces.filter("n_words > 0").select(
        "_id",
        "piece",
        "start",
        "n_words",
        # Repeated rows of one id are spread by the task that reads them.
        F.pmod(F.xxhash64("_id", "piece", F.spark_partition_id()), F.lit(blocks)).cast("int").alias("block"),
    )
    schema = f"_id {kind}, piece int, start long, n_words long, block int, bin long, capacity long, offset long"
    packed = full.groupBy("block").applyInPandas(fill, schema)
    empty = pieces.filter("n_words <= 0").selectExpr(
        "_id", "piece", "start", "n_words", "cast(null as int) block", "cast(null as long) bin",
        "cast(null as long) capacity", "cast(null as long) offset",
    )
    return packed.unionByName(empty).withColumnRenamed("_id", id_col)
