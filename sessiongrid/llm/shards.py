"""Uniform sharding by a hypergeometric communication matrix.

Rows are cut into blocks by a hash of all their columns. How many rows of each block go to each shard
is drawn exactly: the matrix has the block sizes as row sums and the shard sizes, equal up to
one, as column sums, so the counts are those of a uniform shuffle of the whole table. Inside a
block a seeded order says which rows make up each count (permute locally), the rows are
exchanged, and inside a shard they are ordered anew by an independent hash (permute again).

Everything depends on rows, seed and row count alone, so a task that runs again gives the same.
Neither a block nor a part of a shard grows with the table, even if many rows have one id or
none; their number does. Only rows equal in all columns stay together: as many of them as there
are meet in one block, and in one part of each shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessiongrid.sources.storage import stage

ROWS_PER_BLOCK = 50_000
_EXACT = 10**9  # numpy draws smaller populations itself


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones in a sample without replacement, by inversion outwards from the mode."""
    if max(good, bad, sample) < _EXACT:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    low, high = max(0, sample - bad), min(sample, good)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def up(k: int) -> float:
        return (good - k) * (sample - k) / ((k + 1) * (bad - sample + k + 1))

    mode = min(high, max(low, (good + 1) * (sample + 1) // (good + bad + 2)))
    left = right = mode
    p_left = p_right = math.exp(
        log_choose(good, mode) + log_choose(bad, sample - mode) - log_choose(good + bad, sample)
    )
    u = rng.random() - p_left
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= up(right)
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            left -= 1
            p_left /= up(left)
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each block for each shard, drawn block by block from what the shards still need."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    need = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(sizes), shards), dtype=np.int64)
    for b, size in enumerate(sizes):
        rest, left = sum(need), size
        for s in range(shards):
            rest -= need[s]
            take = hypergeometric(rng, need[s], rest, left)
            matrix[b, s] = take
            need[s] -= take
            left -= take
    return matrix


def shuffle_shards(
    rows: DataFrame, id_col: str, shards: int, seed: int = 0, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1, sizes at most one apart) and ``slot`` (gapless from 0 in it).

    Rows are placed by all their columns; rows equal in all of them may trade places. Null ids are
    ordinary values. An empty table gives an empty result. Pass narrow rows: whole ones are moved
    twice. The driver draws the matrix: one count for each ``rows_per_block`` rows and shard, some
    seconds and megabytes for 10**10 rows; raise ``rows_per_block`` beyond that.
    """
    columns = rows.columns

    others = [F.col(c) for c in columns if c != id_col]

    def mixed(salt: int):
        return F.xxhash64(F.lit(seed + salt), F.col(id_col), *others)

    def order(salt: int) -> list:
        return [mixed(salt), F.col(id_col), *others]

    n_blocks = max(1, math.ceil(rows.count() / rows_per_block))
    block = F.pmod(mixed(0), F.lit(n_blocks))
    blocked = rows.withColumn("_block", block)
    sizes = sorted(tuple(r) for r in blocked.groupBy("_block").count().collect())
    ends = communication_matrix([n for _, n in sizes], shards, seed).cumsum(axis=1)
    matrix = rows.sparkSession.createDataFrame(
        [(b, [int(x) for x in e]) for (b, _), e in zip(sizes, ends, strict=True)], "_block long, _ends array<long>"
    )
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order(1)))
    sent = (
        blocked.withColumn("_place", place - 1)
        .join(matrix, "_block")
        .withColumn("shard", F.expr("size(filter(_ends, e -> e <= _place))"))
        .withColumn("_part", F.pmod(mixed(2), F.lit(-(-n_blocks // shards))))
        .select(*columns, "shard", "_part")
    )
    arrived = stage(sent, "shards")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        arrived.groupBy("shard", "_part")
        .count()
        .select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    again = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order(3)))
    return (
        arrived.withColumn("_again", again - 1)
        .join(starts, ["shard", "_part"])
        .select(*columns, "shard", (F.col("_start") + F.col("_again")).alias("slot"))
    )
