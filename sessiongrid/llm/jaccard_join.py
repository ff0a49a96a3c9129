"""Exact Jaccard join of word shingles by T-occurrence search with DivideSkip.

Two sets of n and m shingles are similar enough only if they share at least T of them, with T
no less than the threshold times either size. The join uses that bound three times:

1. A shingle that occurs in one text only can be in no overlap. Tasks receive shingles by
   ranges of their hash and count, for every text, those that it shares with another; texts
   that share fewer than T of them are settled. Shingles repeated inside a task's input are
   counted there, so a shingle in a third of all texts arrives once per task and not per text.
2. Of the remaining texts, each shows its n - T + 1 rarest shingles. Similar texts show a common
   one, so texts connected by them form blocks, and links never leave a block.
3. Inside a block, inverted lists answer a T-occurrence query per text: short lists are merged
   on a heap, the longest ones only probed by binary search for the texts found (DivideSkip).
   Texts already known to be connected are not searched for again.

Texts with equal sets are one node throughout. A block above ``BLOCK_TEXTS`` is cut into chunks:
all are searched against the first, and then only those texts that did not end up in the block's
main component against all chunks, so a huge family of copies costs a linear number of tasks.

Rows with a null id have a null component. Texts that are null or without words have 0
shingles and are alone. Repeated rows are returned as often as they occur.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.llm.common import keep_rows, releasing
from sessiongrid.llm.components import components
from sessiongrid.llm.shingles import digest, from_planes, shingle_sets, to_planes
from sessiongrid.sources.storage import stage

THRESHOLD = 80  # percent
WIDTH = 5
SHINGLES_PER_RANGE = 1_000_000
SETS_PER_PART = 1_000_000
PACKED = 700_000  # shingles packed at once in a task
BLOCK_TEXTS = 3000
HEAP = 2000  # more list entries than this are merged by sorting them at once


def required(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def required_overlap(n, m, percent: int):
    return -(-(n + m) * percent // (100 + percent))


def _ranges(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash; ``ranges`` is a power of two."""
    return (tokens >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64) if ranges > 1 else np.zeros(len(tokens), np.int64)


def _pack(tokens: np.ndarray, owner: np.ndarray, names: np.ndarray, bits: int, ranges: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows by range of hashes, sorted and cut to ``bits``; and the number of shared ones of each owner.

    A hash that several owners hold here is counted for them and sent on once, marked.
    """
    tokens = tokens >> np.uint64(64 - bits)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    group = np.cumsum(first) - 1
    several = np.bincount(group) > 1
    shared = np.bincount(owner, several[group], len(names)).astype(np.int64)
    tokens, owner, several = tokens[first], owner[first], several
    place = _ranges(tokens << np.uint64(64 - bits), ranges)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
    rows = []
    for lo, hi in itertools.pairwise(cuts.tolist()):
        if hi > lo:
            steps = np.diff(tokens[lo:hi], prepend=np.uint64(0))
            used, own = np.unique(owner[lo:hi], return_inverse=True)
            marked = (own.astype(np.uint64) << np.uint64(1)) | several[lo:hi].astype(np.uint64)
            rows.append((int(place[lo]), to_planes(steps), to_planes(marked), names[used].astype("<i8").tobytes()))
    return pd.DataFrame(rows, columns=["range", "steps", "owners", "names"]), shared


def _nodes(docs: DataFrame, width: int) -> DataFrame:
    """Size and identity of each document's set."""

    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [(len(s), digest(s)) for s in shingle_sets(batch["text"].tolist(), width)]
            yield pd.DataFrame({"id": batch["id"], "n": [n for n, _ in sets], "node": [d for _, d in sets]})

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInPandas(run, f"id {kind}, n long, node binary")


def _shared_counts(docs: DataFrame, width: int, total: int, sets: int) -> DataFrame:
    """(name, shared): at least the number of shingles that a set shares with other sets.

    ``name`` is the first 8 bytes of a node. Hashes are cut to so many bits that about one in
    4096 is taken for shared by mistake; that only lets a few more texts through to the next step.
    """
    bits = min(64, max(24, math.ceil(math.log2(max(total, 2))) + 12))
    ranges = 1 << max(4, math.ceil(math.log2(max(1, total / SHINGLES_PER_RANGE))))
    parts = max(16, math.ceil(sets / SETS_PER_PART))

    # Both kinds of rows fill all columns: a null would turn pandas' longs into doubles.
    columns = ["range", "steps", "owners", "names", "name", "shared"]

    @releasing
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: list[np.ndarray] = []
        names: dict[int, int] = {}
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal sets, names, size
            if sets:
                own = np.array(list(names), dtype=np.int64)
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                rows, shared = _pack(np.concatenate(sets), owner, own, bits, ranges)
                yield rows.assign(name=0, shared=0)[columns]
                some = np.flatnonzero(shared)
                counted = pd.DataFrame({"range": own[some] % ranges, "name": own[some], "shared": shared[some]})
                yield counted.assign(steps=b"", owners=b"", names=b"")[columns]
            sets, names, size = [], {}, 0

        for batch in batches:
            for s in shingle_sets(batch["text"].tolist(), width):
                if len(s):
                    name = int.from_bytes(digest(s)[:8], "big", signed=True)
                    if name not in names:
                        names[name] = len(sets)
                        sets.append(s)
                        size += len(s)
                if size >= PACKED:
                    yield from flush()
        yield from flush()

    packed = docs.mapInPandas(pack, "range long, steps binary, owners binary, names binary, name long, shared long")

    @releasing
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        done = rows["shared"] > 0
        found, rows = [rows.loc[done, ["name", "shared"]].to_numpy(np.int64)], rows[~done]
        if len(rows):
            tokens, owners, marked = [], [], []
            for row in rows.itertuples():
                names = np.frombuffer(row.names, dtype="<i8")
                o = from_planes(row.owners)
                tokens.append(np.cumsum(from_planes(row.steps), dtype=np.uint64))
                owners.append(names[(o >> np.uint64(1)).astype(np.int64)])
                marked.append((o & np.uint64(1)).astype(bool))
            token, owner, mark = np.concatenate(tokens), np.concatenate(owners), np.concatenate(marked)
            del tokens, owners, marked
            order = np.argsort(token, kind="stable")
            token, owner, mark = token[order], owner[order], mark[order]
            group = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]))
            low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
            high = np.full(group[-1] + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, group, owner)
            np.maximum.at(high, group, owner)
            many = (low != high) | (np.bincount(group, mark) > 0)
            found.append(np.column_stack(np.unique(owner[many[group] & ~mark], return_counts=True)))
        both = np.concatenate(found)
        part = both[:, 0] % parts
        return pd.DataFrame(
            [(k, both[part == k].astype("<i8").tobytes()) for k in np.unique(part).tolist()], columns=["part", "counts"]
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        both = np.frombuffer(b"".join(rows["counts"]), dtype="<i8").reshape(-1, 2)
        names, at = np.unique(both[:, 0], return_inverse=True)
        return pd.DataFrame({"name": names, "shared": np.bincount(at, both[:, 1]).astype(np.int64)})

    counted = packed.groupBy("range").applyInPandas(count, "part long, counts binary")
    return counted.groupBy("part").applyInPandas(add, "name long, shared long")


def _name(node: str = "node"):
    """First 8 bytes of a node as a signed long, the form used by ``_shared_counts``."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")


def _rare_shingles(sets: DataFrame, percent: int, ranges: int) -> DataFrame:
    """(token, node): the shingles by which a set has to meet any similar one, rarest first."""

    @releasing
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                tokens = np.frombuffer(row.tokens, dtype="<u8")
                place = _ranges(tokens, ranges)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]]).tolist()
                yield pd.DataFrame(
                    [(int(place[lo]), row.node, len(tokens), tokens[lo:hi].tobytes()) for lo, hi in itertools.pairwise(cuts)],
                    columns=["range", "node", "n", "tokens"],
                )

    @releasing
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(t, dtype="<u8") for t in rows["tokens"]]
        every, inverse, found = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(p) for p in parts])
        many = [found[inverse[e - len(p) : e]] for p, e in zip(parts, ends, strict=True)]
        keep = [m > 1 for m in many]
        return pd.DataFrame(
            {
                "node": rows["node"],
                "n": rows["n"],
                "tokens": [p[k].tobytes() for p, k in zip(parts, keep, strict=True)],
                "counts": [m[k].astype("<i8").tobytes() for m, k in zip(many, keep, strict=True)],
            }
        )

    @releasing
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                tokens = np.frombuffer(b"".join(row.tokens), dtype="<u8")
                counts = np.frombuffer(b"".join(row.counts), dtype="<i8")
                shown = row.n - required(row.n, percent) + 1 - (row.n - len(tokens))  # single ones come first
                if shown > 0:
                    rare = tokens[np.lexsort((tokens, counts))[:shown]]
                    out.append(pd.DataFrame({"token": rare.view(np.int64), "node": [row.node] * len(rare)}))
            yield pd.concat(out) if out else pd.DataFrame({"token": pd.Series(dtype=np.int64), "node": pd.Series(dtype=object)})

    split_rows = sets.mapInPandas(split, "range long, node binary, n long, tokens binary")
    counted = split_rows.groupBy("range").applyInPandas(count, "node binary, n long, tokens binary, counts binary")
    gathered = counted.groupBy("node", "n").agg(
        # Sorted together, so that both lists have one order.
        F.array_sort(F.collect_list(F.struct("tokens", "counts"))).alias("both")
    ).select("node", "n", F.col("both.tokens").alias("tokens"), F.col("both.counts").alias("counts"))
    return gathered.mapInPandas(choose, "token long, node binary")


def occurrences(lists: list[np.ndarray], least: int, sizes: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Texts (positions in ``sizes``) that occur in as many ``lists`` as similarity to a set of n needs.

    DivideSkip: of the sorted lists, the ``least`` - 1 longest are set aside. Whoever is in
    ``least`` lists is in one of the others, so merging those finds all candidates; their
    remaining occurrences are looked up in the long lists by binary search.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < least:
        return np.zeros(0, dtype=np.int64)
    cut = len(lists) - (least - 1)
    short, long = lists[:cut], lists[cut:]
    if sum(map(len, short)) <= HEAP:
        merged = [(k, sum(1 for _ in same)) for k, same in itertools.groupby(heapq.merge(*(x.tolist() for x in short)))]
        found, count = np.array([k for k, _ in merged], dtype=np.int64), np.array([c for _, c in merged], dtype=np.int64)
    else:
        found, count = np.unique(np.concatenate(short), return_counts=True)
    need = required_overlap(n, sizes[found], percent)
    for done, probe in enumerate(long):
        hope = count + (len(long) - done) >= need
        found, count, need = found[hope], count[hope], need[hope]
        if not len(found):
            break
        at = np.minimum(np.searchsorted(probe, found), len(probe) - 1)
        count = count + (probe[at] == found)
    return found[count >= need]


def block_links(nodes: list[bytes], sets: list[np.ndarray], asks: np.ndarray, held: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that connect the texts of a block: enough for its components, not all of them."""
    order = sorted(range(len(nodes)), key=lambda i: (len(sets[i]), nodes[i]))
    nodes, sets, asks, held = [nodes[i] for i in order], [sets[i] for i in order], asks[order], held[order]
    sizes = np.array([len(s) for s in sets])
    index = np.flatnonzero(held)
    tokens = np.concatenate([sets[i] for i in index]) if len(index) else np.zeros(0, np.uint64)
    owner = np.repeat(index, sizes[index])
    by = np.argsort(tokens, kind="stable")  # owners stay in order inside a list
    tokens, owner = tokens[by], owner[by]
    words, starts = np.unique(tokens, return_index=True)
    starts = np.append(starts, len(tokens))
    group = np.arange(len(nodes))
    links = []
    for q in np.flatnonzero(asks).tolist():
        n = int(sizes[q])
        least = required(n, percent)
        low = np.searchsorted(sizes, least)
        high = np.searchsorted(sizes, n * 100 // percent, side="right")
        if not (group[low:high][held[low:high]] != group[q]).any():
            continue
        at = np.searchsorted(words, sets[q])
        at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == sets[q])]
        at = at[starts[at + 1] - starts[at] > held[q]]  # some other text has the shingle
        if len(at) < least:
            continue
        lists = [owner[a:b] for a, b in zip(starts[at].tolist(), starts[at + 1].tolist(), strict=True)]
        # Cutting long lists to possible sizes saves time; no other size can reach the overlap.
        lists = [x if len(x) <= 64 else x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists]
        for other in occurrences(lists, least, sizes, n, percent).tolist():
            if group[other] != group[q]:
                links.append((nodes[q], nodes[other]))
                group[group == group[other]] = group[q]
    return links


def _search(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found by ``tasks`` (task, node, asks, held)."""

    @releasing
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.groupby("node", as_index=False).agg({"asks": "max", "held": "max", "tokens": "first"})
        found = block_links(
            rows["node"].tolist(), [np.frombuffer(t, dtype="<u8") for t in rows["tokens"]], rows["asks"].to_numpy(bool), rows["held"].to_numpy(bool), percent
        )
        return pd.DataFrame(found, columns=["a", "b"])

    return tasks.join(sets.select("node", "tokens"), "node").groupBy("task").applyInPandas(run, "a binary, b binary")


def _links(sets: DataFrame, percent: int, ranges: int) -> DataFrame:
    rare = stage(_rare_shingles(sets, percent, ranges), "rare")
    leaders = rare.groupBy("token").agg(F.min("node").alias("b"))
    blocks = components(rare.join(leaders, "token").select(F.col("node").alias("a"), "b"))
    blocks = stage(blocks.toDF("node", "block"), "blocks")
    counts = blocks.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("chunks"))
    # Chunks are drawn by the text's identity; small blocks share tasks of about one chunk by hash.
    placed = blocks.join(counts, "block").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = stage(placed, "chunks")
    task = lambda *c: F.concat_ws("/", F.hex("block"), *c)
    shares = max(1, math.ceil(placed.count() / BLOCK_TEXTS))
    small = F.concat_ws("/", F.lit("small"), F.pmod(F.xxhash64("block"), F.lit(shares)))
    own = placed.select(F.when(F.col("chunks") == 1, small).otherwise(task("chunk")).alias("task"), "node", F.lit(True).alias("asks"), F.lit(True).alias("held"))
    large = placed.filter("chunks > 1")
    pivot = (
        large.filter("chunk = 0")
        .withColumn("to", F.explode(F.sequence(F.lit(1), F.col("chunks") - 1)))
        .select(task("to").alias("task"), "node", F.lit(False).alias("asks"), F.lit(True).alias("held"))
    )
    links = stage(_search(own.unionByName(pivot), sets, percent), "near")
    if large.isEmpty():
        return links
    joined = large.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = joined.groupBy("block", "root").count()
    main = sizes.groupBy("block").agg(F.max(F.struct("count", "root"))["root"].alias("main"))
    rest = joined.join(main, "block").filter("root <> main")
    rest = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("chunks"))).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = rest.select(task("part", "to").alias("task"), "node", F.lit(True).alias("asks"), F.lit(False).alias("held"))
    parts = rest.select("block", "part").distinct()
    index = large.join(parts, "block").select(
        F.concat_ws("/", F.hex("block"), "part", "chunk").alias("task"), "node", F.lit(False).alias("asks"), F.lit(True).alias("held")
    )
    return links.unionByName(_search(asked.unionByName(index), sets, percent))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD, width: int = WIDTH
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles and component_id, the smallest id reachable by links."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    nodes = stage(_nodes(rows, width), "nodes")
    known = nodes.filter("id is not null and n > 0")
    total, count = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared = _shared_counts(rows.filter("id is not null"), width, total, count)
    kinds = known.groupBy("node", "n").agg(F.min("id").alias("id")).withColumn("name", _name())
    chosen = stage(
        kinds.join(shared, "name").filter(F.col("shared") * 100 >= F.col("n") * percent).select("id", "node", "n"), "chosen"
    )

    @releasing
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                own = batch.iloc[lo : lo + 1000]
                sets = [(digest(s), s.astype("<u8").tobytes()) for s in shingle_sets(own["text"].tolist(), width)]
                yield pd.DataFrame({"id": own["id"], "node": [d for d, _ in sets], "tokens": [t for _, t in sets]})

    kind = rows.schema["id"].dataType.simpleString()
    texts = keep_rows(rows, chosen, "id").mapInPandas(tokens, f"id {kind}, node binary, tokens binary")
    sets = stage(texts.join(chosen, ["id", "node"]).select("node", "tokens").dropDuplicates(["node"]), "sets")
    left = chosen.agg(F.sum("n")).first()[0] or 0
    ranges = 1 << max(4, math.ceil(math.log2(max(1, left / SHINGLES_PER_RANGE))))
    roots = components(_links(sets, percent, ranges)).toDF("node", "root")
    linked = kinds.join(roots, "node").select("node", "root", "id")
    smallest = linked.groupBy("root").agg(F.min("id").alias("least"))
    named = kinds.join(roots, "node", "left").join(smallest, "root", "left").select(
        F.col("node").alias("of"), F.coalesce("least", "id").alias("component")
    )
    alone = F.when(F.col("n") == 0, F.col("id"))
    return (
        nodes.withColumn("of", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("node")))
        .join(named, "of", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", alone).alias("component_id"))
    )
