"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

Each table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform) and assigns them to the nearest signed axis. For large collections a second
rotation with fewer axes is joined to the first, so buckets keep a bounded mean size. A query
looks into its likeliest buckets of every table; inside a bucket its candidates are ranked by
exact cosine, and the best of all buckets are its neighbours. More buckets take more probes:
their number is measured on seeded pairs, so that vectors of cosine ``AT_COSINE`` meet with
chance ``CHANCE`` or more whatever the number of vectors, axes and tables.

Equal vectors are met once as queries, and only the k + 1 smallest ids of equal candidates are
indexed, since no query can need more. A bucket above ``ROWS_PER_PART`` is cut into parts that
are searched in different tasks. The tables of bucket sizes that reach the driver are bounded
by the number of axes, not by the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TABLES = 12
PROBES = 8  # at least
AT_COSINE = 0.3
CHANCE = 0.95
PAIRS = 1000
ROWS_PER_PART = 20_000
MEAN_BUCKET = 4_000
_TIE = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Hasher:
    """Scores of the signed axes of every table; depends on ``dim`` and ``seed`` alone."""

    def __init__(self, dim: int, tables: int, second: int, seed: int):
        self.dim, self.second = dim, second
        self.padded = max(2, 1 << (dim - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables, 2, 3, self.padded))

    def _axes(self, x: np.ndarray, table: int, part: int, keep: int) -> np.ndarray:
        for signs in self.signs[table, part]:
            x = hadamard(x * signs)
        x = x[:, :keep]
        return np.concatenate([x, -x], axis=1)

    def scores(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Score of every bucket for each row."""
        x = np.zeros((len(unit), self.padded))
        x[:, : self.dim] = unit
        score = self._axes(x, table, 0, self.padded)
        if self.second:
            other = self._axes(x, table, 1, self.second)
            # Both are parts of one unit vector's rotations; the second is scaled to the first.
            score = (score[:, :, None] + other[:, None, :] / math.sqrt(self.padded / self.second)).reshape(len(x), -1)
        return score

    def probes(self, unit: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` likeliest buckets of each row, likeliest first."""
        score = self.scores(unit, table)
        n = min(n, score.shape[1])
        near = np.argpartition(-score, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)


@lru_cache(maxsize=64)
def probes_needed(dim: int, tables: int, second: int, seed: int) -> int:
    """Fewest probes by which ``CHANCE`` of all pairs of cosine ``AT_COSINE`` meet in some table."""
    hasher = Hasher(dim, tables, second, seed)
    buckets = 2 * hasher.padded * (2 * second or 1)
    if dim == 1:
        return buckets
    rng = np.random.default_rng(seed)
    a, b = _unit(rng.normal(size=(PAIRS, dim))), rng.normal(size=(PAIRS, dim))
    b = _unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = AT_COSINE * a + math.sqrt(1 - AT_COSINE**2) * b
    place = np.full(PAIRS, buckets)
    step = max(1, 2_000_000 // buckets)
    for lo in range(0, PAIRS, step):
        own = slice(lo, lo + step)
        for table in range(tables):
            held, score = hasher.probes(b[own], table, 1), hasher.scores(a[own], table)
            before = (score > np.take_along_axis(score, held, 1)).sum(axis=1)
            place[own] = np.minimum(place[own], before + 1)
    return int(np.sort(place)[math.ceil(CHANCE * PAIRS) - 1])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (id, vec) without null, zero or non-finite vectors."""
    vec = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("id"), vec.alias("vec")).filter(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
        & F.expr("exists(vec, x -> x != 0)")
    ).distinct()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine with exactly rounded sums: equal vectors give equal scores, in any order of rows."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = 1,
    mean_bucket: int = MEAN_BUCKET,
) -> DataFrame:
    """query_id, rank (from 1), id and score of the ``k`` nearest found, the query's own id excluded.

    A query is answered among the vectors of its own length; each length has tables of its own.
    Ties go to the smaller id, repeated rows count once. Vectors that ``usable`` rejects take no
    part on either side; without any the result is empty. Other columns are not read. At least
    ``probes`` buckets are searched in each table, more where ``probes_needed`` asks for them.
    """
    base = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col)
    same = Window.partitionBy("vec").orderBy("id")
    indexed = base.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).drop("_n")
    members = asked.groupBy("vec").agg(F.min("id").alias("query"))
    hashers: dict[int, tuple[Hasher, int]] = {}
    for dim, total in base.groupBy(F.size("vec")).count().collect():  # one row for each length
        padded = max(2, 1 << (dim - 1).bit_length())
        wanted = total / (2 * padded * mean_bucket)
        second = 0 if wanted <= 2 else min(padded, 1 << max(0, math.ceil(math.log2(wanted)) - 1))
        hashers[dim] = Hasher(dim, tables, second, seed), max(probes, probes_needed(dim, tables, second, seed))

    def bucketed(asking: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, every in batch.groupby(batch["vec"].map(len)):
                    if dim not in hashers:
                        continue
                    hasher, n = hashers[dim][0], hashers[dim][1] if asking else 1
                    step = max(1, min(512, 8192 // n))  # bounds the rows made at once
                    for lo in range(0, len(every), step):
                        own = every.iloc[lo : lo + step]
                        unit = _unit(_matrix(own["vec"]))
                        for table in range(tables):
                            found = hasher.probes(unit, table, n)
                            row = np.repeat(np.arange(len(own)), found.shape[1])
                            yield pd.DataFrame(
                                {"id": own["id"].to_numpy()[row], "vec": own["vec"].to_numpy()[row], "dim": dim, "table": table, "bucket": found.ravel()}
                            )

        return run

    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, vec array<double>, dim int, table int, bucket int"
    places = ["dim", "table", "bucket"]
    held = indexed.mapInPandas(bucketed(False), schema)
    sizes = held.groupBy(*places).count().filter(F.col("count") > ROWS_PER_PART).collect()
    parts = F.lit(1)
    if sizes:  # at most one entry for each table and bucket
        cut = F.create_map(*(F.lit(x) for r in sizes for x in (f"{r[0]} {r[1]} {r[2]}", math.ceil(r[3] / ROWS_PER_PART))))
        parts = F.coalesce(cut[F.concat_ws(" ", *places)], F.lit(1))
    left = held.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("asks", F.lit(False))
    right = (
        members.select(F.col("query").alias("id"), "vec")
        .mapInPandas(bucketed(True), schema)
        .withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
        .withColumn("asks", F.lit(True))
    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        own, asks = rows[~rows["asks"]], rows[rows["asks"]]
        if len(own) and len(asks):
            ids, x, q = own["id"].to_numpy(), _matrix(own["vec"]), _matrix(asks["vec"])
            unit = _unit(x)
            for lo in range(0, len(q), 256):
                near = _unit(q[lo : lo + 256]) @ unit.T
                last = near.shape[1] - min(k + 1, near.shape[1])
                for i, (query, scores) in enumerate(zip(asks["id"].to_numpy()[lo : lo + 256], near, strict=True)):
                    for j in np.flatnonzero(scores >= np.partition(scores, last)[last] - _TIE):
                        out.append((query, ids[j], cosine(q[lo + i], x[j])))
        return pd.DataFrame(out, columns=["query", "id", "score"])

    found = left.unionByName(right).groupBy(*places, "part").applyInPandas(
        search, f"query {kind}, id {kind}, score double"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = (
        found.groupBy("query", "id")
        .agg(F.max("score").alias("score"))
        .withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") <= k + 1)
        .drop("_n")
    )
    # Every query gets the neighbours of its equal, without itself.
    who = asked.join(members, "vec").select(F.col("id").alias("query_id"), "query")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        who.join(top, "query")
        .filter(F.col("query_id") != F.col("id"))
        .withColumn("rank", F.row_number().over(mine))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
