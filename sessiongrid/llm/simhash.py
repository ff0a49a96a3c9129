"""Near-duplicates by SimHash fingerprints, joined through their bit counts per segment.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles. Two
texts are linked if at most ``DISTANCE`` bits differ.

Segment-popcount embedding: a fingerprint is cut into segments of two bits and mapped to the
number of ones in each, a point of a grid. A differing bit moves a point by at most one step, so the
Manhattan distance of two points is a lower bound of the bits that differ. Points are kept in
unary (0, 1 and 2 ones as 00, 01 and 11), where their Manhattan distance is a count of bits too.

Grid range-join: the axes of the grid are cut into slabs. Points within ``DISTANCE`` steps
coincide in all but ``DISTANCE`` slabs at least, so each point enters one cell for every choice of the others,
and no pair within range misses a common cell. Inside a cell, pairs beyond
the Manhattan distance are dropped, the rest is verified by the bits themselves. A cell with more than
``CELL`` points is not searched: its points go through a grid of more slabs, whose cells pin down
more axes, and so on; only the finest grid takes every cell as it is. So no pair is lost.

Fingerprints that are equal are one point, however many texts have them. A task returns a
spanning forest of the links it finds, never all pairs, so a family of near copies adds rows in
proportion to its size.

A null text is empty; texts without words have fingerprint zero and are linked like any other.
Null ids are kept and do not count as smallest. Repeated rows are returned as often as they occur. An empty table gives
an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.llm.common import join_unique
from sessiongrid.llm.components import components
from sessiongrid.schema import quoted
from sessiongrid.sources.storage import stage

WORDS = 4
SEED = 42
DISTANCE = 4
SLABS = (6, 8, 10, 12)  # of 32 axes, from grid to finer grid
CELL = 4096
_AXES = 32
_LOW = 0x5555555555555555
_HASHES = 1 << 16  # hashes whose bits are counted at once
_ROWS = 50_000  # points searched at once


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the ``words``-word shingles of ``text``, repeats included; unsigned."""
    tokens = (text or "").encode("utf-8").lower().split()  # of bytes: A to Z, and white space of ASCII
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    last = max(len(tokens) - words, 0)
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), last + 1
    for lo in range(0, n, _HASHES):
        hi = min(n, lo + _HASHES)
        hashes = [digest(line[a:b], seed) for a, b in zip(starts[lo:hi], ends[min(words, len(tokens)) - 1 + lo :], strict=False)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, point): the fingerprint of every text as a signed 64-bit integer."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "point": prints.view(np.int64)})

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, point long")


# -- Grid ------------------------------------------------------------------------------------


def embed(x: np.ndarray) -> np.ndarray:
    """Ones of each two-bit segment in unary; differing bits of two results are their Manhattan distance."""
    low, high = x & np.uint64(_LOW), (x >> np.uint64(1)) & np.uint64(_LOW)
    return (low | high) | ((low & high) << np.uint64(1))


def cell_masks(slabs: int, distance: int = DISTANCE) -> list[int]:
    """For every choice of all but ``distance`` slabs, the bits of the axes in them (signed)."""
    edges = [_AXES * i // slabs for i in range(slabs + 1)]
    slab = [sum(3 << (2 * axis) for axis in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = (sum(slab[i] for i in chosen) for chosen in combinations(range(slabs), slabs - distance))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` with the components of a and b joined; labels are smallest members."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def forest(cell: np.ndarray, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between points ``x`` of equal ``cell`` (sorted), reduced to a spanning forest."""
    n = len(x)
    ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, n)
    room = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)
    grid, label = embed(x), np.arange(n)
    own, step = np.flatnonzero(room > 1), 1
    while len(own):
        other = own + step
        near = np.bitwise_count(grid[own] ^ grid[other]) <= distance
        a, b = own[near], other[near]
        same = np.bitwise_count(x[a] ^ x[b]) <= distance
        if same.any():
            label = _merge(label, a[same], b[same])
        step += 1
        own = own[room[own] > step]
    tied = np.flatnonzero(label != np.arange(n))
    return x[tied], x[label[tied]]


def _search(batches: Iterator[pd.DataFrame], distance: int, limit: int | None) -> Iterator[pd.DataFrame]:
    """Links of points that arrive in the order of their cells; b is null for points of cells above ``limit``."""

    def frame(a: np.ndarray, b: np.ndarray | None) -> pd.DataFrame:
        second = pd.array([None] * len(a), dtype="Int64") if b is None else pd.array(b.view(np.int64), dtype="Int64")
        return pd.DataFrame({"a": a.view(np.int64), "b": second})

    kind = np.dtype([("mask", "<i4"), ("cell", "<i8")])
    keys, points = np.zeros(0, kind), np.zeros(0, np.uint64)
    passed = None  # a cell that has turned out too large; the rest of it passes through

    def settle(keys: np.ndarray, points: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(keys):
            return
        number = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
        if limit is not None:
            large = np.bincount(number)[number] > limit
            if large.any():
                yield frame(points[large], None)
                number, points = number[~large], points[~large]
        if len(points):
            a, b = forest(number, points, distance)
            if len(a):
                yield frame(a, b)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        new = np.empty(len(batch), kind)
        new["mask"], new["cell"] = batch["mask"].to_numpy(), batch["cell"].to_numpy()
        held.append((new, batch["point"].to_numpy().view(np.uint64)))
        size += len(batch)
        if size < _ROWS:
            continue
        keys, points = np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([points, *(p for _, p in held)])
        held, size = [], 0
        if passed is not None:
            gone = int(np.argmax(keys != passed)) if (keys != passed).any() else len(keys)
            if gone:
                yield frame(points[:gone], None)
            keys, points = keys[gone:], points[gone:]
            if len(keys):
                passed = None
        if not len(keys):
            continue
        inside = np.flatnonzero(keys != keys[-1])
        cut = int(inside[-1]) + 1 if len(inside) else 0  # the last cell may go on
        yield from settle(keys[:cut], points[:cut])
        keys, points = keys[cut:], points[cut:]
        if limit is not None and len(keys) > limit:
            yield frame(points, None)
            passed, keys, points = keys[-1], keys[:0], points[:0]
    keys, points = np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([points, *(p for _, p in held)])
    if passed is not None:
        gone = keys == passed
        if gone.any():
            yield frame(points[gone], None)
        keys, points = keys[~gone], points[~gone]
    yield from settle(keys, points)


def grid_join(points: DataFrame, slabs: int, distance: int = DISTANCE, limit: int | None = CELL) -> DataFrame:
    """(a, b): a spanning forest of the links within each task; b null for points that need a finer grid."""
    x = F.col("point")
    low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_LOW))
    grid = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    masks = F.array(*[F.lit(m) for m in cell_masks(slabs, distance)])
    cells = points.select("point", grid.alias("_grid")).select("point", "_grid", F.posexplode(masks).alias("mask", "_axes"))
    placed = cells.select("mask", F.col("_grid").bitwiseAND(F.col("_axes")).alias("cell"), "point")
    ordered = placed.repartition("mask", "cell").sortWithinPartitions("mask", "cell")
    return ordered.mapInPandas(lambda batches: _search(batches, distance, limit), "a long, b long")


def linked_points(points: DataFrame, distance: int = DISTANCE, slabs: tuple[int, ...] = SLABS, limit: int = CELL) -> DataFrame:
    """Links (a, b) that connect all distinct ``point`` within ``distance`` bits of each other."""
    links = None
    for turn, n in enumerate(slabs):
        found = stage(grid_join(points, n, distance, limit if turn < len(slabs) - 1 else None), "grid")
        here = found.filter("b IS NOT NULL")
        links = here if links is None else links.unionByName(here)
        points = found.filter("b IS NULL").select(F.col("a").alias("point")).distinct()
        if points.isEmpty():
            break
    return links


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    distance: int = DISTANCE,
    slabs: tuple[int, ...] = SLABS,
    limit: int = CELL,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the smallest id linked to it."""
    prints = stage(fingerprints(docs, id_col, text_col, words), "prints")
    points = stage(prints.groupBy("point").agg(F.min("id").alias("first")), "points")
    roots = components(linked_points(points.select("point"), distance, slabs, limit))
    rooted = stage(
        points.join(roots.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point")), "roots"
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(join_unique(rooted, smallest, ["root"]).select("point", "component_id"), "named")
    return join_unique(prints, named, ["point"]).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id"
    )
