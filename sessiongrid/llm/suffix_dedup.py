"""Removal of repeated byte strings by suffix arrays over sharded text.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes; strings
are judged on the input and never cross documents.

Sharding keeps equal strings together. The smallest hash among the short grams of a string is
its anchor: equal strings have equal anchors, and neighbouring strings mostly share theirs, so
a document falls into regions, runs of starts with one anchor. Only anchors that occur in
several places matter. Their regions are collapsed where their whole text is equal; those that
differ, or hold the anchor twice, are gathered by anchor, and each shard builds a suffix array over its regions by
Larsson-Sadakane refinement and their common prefixes by Kasai's rule. A start is repeated if
it shares ``length`` bytes with a neighbour in that order, or lies in a collapsed region.

An anchor with more text than one shard holds is spread over several. Their arrays are merged by
the fingerprints of their distinct strings: each shard sorts them and cuts them into ranges by
binary search, a task per range finds those that several shards hold, and every shard looks up
its own strings in what comes back by binary search. So no anchor is too frequent for a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.llm.common import flag, key_bitmap
from sessiongrid.llm.shingles import _BYTE, _INVERSE, _MULTIPLIER, _mix, _powers
from sessiongrid.sources.storage import stage

LENGTH = 400
GRAM = 32
RUN = 512  # starts in a region at most
SHARD_BYTES = 2_000_000
SLICE_BYTES = 1_000_000
_SECOND = 0xD1B54A32D192ED03


# -- Anchors -----------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each position, joined from halves; the last ones are cut."""
    h, width, by = _BYTE[data], 1, _MULTIPLIER
    while width < size:
        step = min(width, size - width)
        h = h[:-step] * np.uint64(by) + h[step:]
        width += step
        by = by * _SECOND % (1 << 64)  # another factor for each joint
    return _mix(h)


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: running minima of blocks from both sides."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    full = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(h)] = h
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def regions(text: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, bool]]:
    """(anchor, first start, number of starts, whether the anchor's gram occurs twice) of each region."""
    if len(text) < length:
        return
    hashes, width = _gram_hashes(np.frombuffer(text, np.uint8), gram), length - gram + 1
    least = _window_minima(hashes, width)
    edges = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
    anchors = least[edges[:-1]]
    hashes = hashes.view(np.int64)
    for anchor, lo, hi in zip(anchors.view(np.int64).tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for at in range(lo, hi, RUN):
            n = min(RUN, hi - at)
            yield anchor, at, n, np.count_nonzero(hashes[at : at + n - 1 + width] == anchor) > 1


# -- Suffix arrays -----------------------------------------------------------------------


def suffix_array(texts: list[bytes], depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of all texts, each ending with its text; their places and text ends.

    Larsson-Sadakane: after sorting by the first 8 bytes, groups that are still equal are sorted
    by the rank of what follows, which doubles the sorted prefix in each round. Group and
    follower are one integer, so a round is one sort of the places that are still open. With
    ``depth`` only suffixes of that many bytes or more are given, in the order of these bytes, and the
    last two rounds sort no others than these need. Suffixes equal so far are in any order.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    kind = np.int32 if n < np.iinfo(np.int32).max else np.int64
    end = np.repeat(np.cumsum(lengths).astype(kind), lengths)
    place = np.arange(n, dtype=kind)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    # Bytes beyond a text's end count as zero; a text that goes on with zeros is told apart by what follows.
    short = np.flatnonzero(end - place < 8)
    gone = (8 - (end[short] - place[short])).astype(np.uint64) * np.uint64(8)
    key[short] = key[short] >> gone << gone
    sa = np.argsort(key).astype(kind)
    key = key[sa]
    head = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    del key, padded
    rank = np.empty(n, dtype=kind)
    rank[sa] = np.maximum.accumulate(np.where(head, place, 0)) if n else place  # a group's rank is its first slot
    h, longest = 8, int(lengths.max(initial=0))
    longest = min(longest, depth or longest)
    open_slots = np.flatnonzero(~head | ~np.append(head[1:], True)).astype(kind)
    while len(open_slots) and h < longest:
        own = sa[open_slots]
        if depth and 4 * h >= depth:
            # Starts of ``depth`` bytes, and what lies 2h, 4h ... behind them as far as they reach.
            size = end[own] - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(kind)[own]
            at, starts = size - (end[own] - own), size - depth
            needed = np.zeros(len(own), dtype=bool)
            for back in range(0, depth, 2 * h):
                needed |= (at >= back) & (at - back <= starts)
            open_slots, own = open_slots[needed], own[needed]
            if not len(own):
                break
        after = own + h
        follow = np.where(after < end[own], rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[own].astype(np.int64) * (n + 1) + follow
        order = np.argsort(both)
        own, both = own[order], both[order]
        sa[open_slots] = own
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[own] = open_slots[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        open_slots = open_slots[~new | ~np.append(new[1:], True)]
        h *= 2
    if depth:
        sa = sa[end[sa] - sa >= depth]
    return sa, data, end


def common_prefixes(sa: np.ndarray, data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in ``sa`` shares with the one before it.

    Kasai's rule: going one byte on in the text loses at most one byte of the common prefix. It
    loses exactly one where the bytes before both suffixes are equal, so only the others are
    compared, all side by side, and the rest is counted down from them.
    """
    n = len(data)
    sa, end = sa.astype(np.int64), end.astype(np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    starts = np.concatenate([[True], end[1:] != end[:-1]]) if n else np.zeros(0, bool)
    place = np.arange(n)
    last = np.maximum(before - 1, 0)
    kept = (before > 0) & (place > 0) & ~starts
    kept &= ~starts[np.maximum(before, 0)] & (data[np.maximum(place - 1, 0)] == data[last])
    kept[1:] &= before[:-1] == before[1:] - 1
    own = place[~kept & (before >= 0)]
    other = before[own]
    common = np.zeros(n, dtype=np.int64)
    room = np.minimum(end[own] - own, end[other] - other)
    length = np.zeros(len(own), dtype=np.int64)
    words = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(words, (n + 1, 8), (1, 1))
    active = np.arange(len(own))
    while len(active):
        a, b = words[own[active] + length[active]], words[other[active] + length[active]]
        same = np.where((a == b).all(axis=1), 8, (a == b).argmin(axis=1))
        length[active] += same
        active = active[(same == 8) & (length[active] < room[active])]
    common[own] = np.minimum(length, room)
    # Count down from the last compared place.
    source = np.maximum.accumulate(np.where(kept, -1, place))
    common = np.where(kept, common[source] - (place - source), common)
    out = np.zeros(len(sa), dtype=np.int64)
    out[1:] = common[sa[1:]]
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, whether the ``length`` bytes at each start also start elsewhere in ``texts``."""
    sa, data, end = suffix_array(texts, length)
    shared = common_prefixes(sa, data, end) >= length
    found = np.zeros(len(data), dtype=bool)
    found[sa[shared]] = True
    found[sa[np.flatnonzero(shared) - 1]] = True
    cuts = np.cumsum([len(t) for t in texts])
    return [f[: len(t) - length + 1] for f, t in zip(np.split(found, cuts[:-1]), texts, strict=True)]


def _runs(found: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[0], found.view(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1]).astype("<i4")


# -- Merging shards of one anchor ----------------------------------------------------------


def fingerprints(text: bytes, length: int) -> np.ndarray:
    """128-bit fingerprints of the strings at all starts, as a structured array in start order."""
    data = np.frombuffer(text, np.uint8)
    out = np.empty(len(data) - length + 1, dtype=[("a", "<u8"), ("b", "<u8")])
    for field, base, inverse in (("a", _MULTIPLIER, _INVERSE), ("b", _SECOND, pow(_SECOND, -1, 1 << 64))):
        up, down = _powers(base, len(data)), _powers(inverse, len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up, dtype=np.uint64)])
        out[field] = _mix((sums[length:] - sums[:-length]) * down[: len(out)])
    return out


def _merge_shards(large: DataFrame, length: int, strings: int) -> DataFrame:
    """(digest, runs) of strings that several shards of an anchor hold. ``large``: anchor, part, digest, text."""
    ranges = 1 << max(0, math.ceil(math.log2(max(1, strings / 1_000_000))))
    bounds = (np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)) if ranges > 1 else np.zeros(0, np.uint64)

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(np.concatenate([fingerprints(t, length) for t in rows["text"]]))
        cuts = [0, *np.searchsorted(own["a"], bounds).tolist(), len(own)]
        first = rows.iloc[0]
        return pd.DataFrame(
            [(first["anchor"], first["part"], r, own[lo:hi].tobytes()) for r, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo],
            columns=["anchor", "part", "range", "prints"],
        )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        kind = [("a", "<u8"), ("b", "<u8")]
        every = [np.frombuffer(p, dtype=kind) for p in rows["prints"]]
        values, counts = np.unique(np.concatenate(every), return_counts=True)
        several = values[counts > 1]
        mine = [x[np.isin(x, several)].tobytes() if len(several) else b"" for x in every]
        return pd.DataFrame({"anchor": rows["anchor"], "part": rows["part"], "prints": mine})

    def mark(rows: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        known = np.sort(np.frombuffer(b"".join(back["prints"]), dtype=[("a", "<u8"), ("b", "<u8")]))
        out = []
        for digest, text in zip(rows["digest"], rows["text"], strict=True):
            own = fingerprints(text, length)
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            found = known[at] == own if len(known) else np.zeros(len(own), dtype=bool)
            if found.any():
                out.append((digest, _runs(found).tobytes()))
        return pd.DataFrame(out, columns=["digest", "runs"])

    shards = ["anchor", "part"]
    sorted_prints = large.groupBy(*shards).applyInPandas(sort, "anchor long, part int, range int, prints binary")
    back = sorted_prints.groupBy("anchor", "range").applyInPandas(merge, "anchor long, part int, prints binary")
    return large.groupBy(*shards).cogroup(back.groupBy(*shards)).applyInPandas(mark, "digest binary, runs binary")


# -- The operator ------------------------------------------------------------------------


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                raw = (text or "").encode("utf-8")
                size += len(raw)
                for anchor, at, n, twice in regions(raw, length, gram):
                    out.append((anchor, k1, k2, at, n, twice, hashlib.blake2b(raw[at : at + n - 1 + length], digest_size=16).digest()))
                if size > SLICE_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    names = ["anchor", "k1", "k2", "start", "n", "twice", "digest"]
    return docs.mapInPandas(run, "anchor long, k1 long, k2 long, start int, n int, twice boolean, digest binary")


def _region_runs(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(digest, runs) of repeated starts in regions whose anchor has several texts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                raw = text.encode("utf-8")
                rows += [(w["anchor"], w["digest"], raw[w["start"] : w["start"] + w["n"] - 1 + length]) for w in wanted]
                size += len(raw)
                if size > SLICE_BYTES:
                    yield pd.DataFrame(rows, columns=["anchor", "digest", "text"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["anchor", "digest", "text"])

    by_doc = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "digest", "start", "n")).alias("wanted"))
    keys = ["k1", "k2"]
    near = flag(docs, keys, key_bitmap(by_doc, keys), "_near").filter("_near").drop("_near")
    texts = near.dropDuplicates(keys).join(by_doc, keys).select("text", "wanted")
    pieces = stage(texts.mapInPandas(cut, "anchor long, digest binary, text binary"), "regions")
    sizes = pieces.groupBy("anchor").agg(F.sum(F.length("text")).alias("bytes"))
    parts = sizes.withColumn("parts", F.ceil(F.col("bytes") / SHARD_BYTES).cast("int"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    placed = stage(
        pieces.join(parts, "anchor").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")), "shards"
    )
    shard = F.when(F.col("parts") == 1, F.concat_ws("/", F.lit("small"), F.pmod(F.xxhash64("anchor"), F.lit(shards)))).otherwise(
        F.concat_ws("/", "anchor", "part")
    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(rows["text"].tolist(), length)
        out = [(d, _runs(f).tobytes()) for d, f in zip(rows["digest"], found, strict=True) if f.any()]
        return pd.DataFrame(out, columns=["digest", "runs"])

    alone = placed.withColumn("shard", shard).groupBy("shard").applyInPandas(search, "digest binary, runs binary")
    large = placed.filter("parts > 1").select("anchor", "part", "digest", "text")
    strings = large.agg(F.sum(F.length("text") - (length - 1))).first()[0]
    if not strings:
        return alone
    return alone.unionByName(_merge_shards(large, length, strings))


def merge_spans(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans; touching ones become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """One row per document: id, n_bytes, spans (start, end of each removed run) and kept (the bytes left).

    A null text is empty. Texts below ``length`` bytes lose nothing. Rows with equal id and
    text are copies of each other like any rows with equal text, so they lose everything from
    ``length`` bytes on. Only id and text are read; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.withColumn("k1", F.xxhash64(F.lit(1), "id", "text")).withColumn("k2", F.xxhash64(F.lit(2), "text", "id"))
    places = stage(_occurrences(base.select("k1", "k2", "text"), length, gram), "anchors")
    anchors = places.groupBy("anchor").agg(
        F.count("*").alias("_n"), ((F.min("digest") != F.max("digest")) | F.max("twice")).alias("mixed")
    )
    several = stage(places.join(anchors.filter("_n > 1 or mixed").drop("_n"), "anchor"), "repeats")
    copies = several.groupBy("digest").agg(
        F.count("*").alias("copies"), F.first("anchor").alias("anchor"), F.max("mixed").alias("mixed"), F.min(F.struct("k1", "k2", "start", "n")).alias("at")
    )
    copies = stage(copies, "copies")
    whole = copies.filter("copies > 1").select("digest", F.lit(None).cast("binary").alias("runs"))
    wanted = copies.filter("mixed").select("anchor", "digest", "at.*")
    found = whole.unionByName(_region_runs(base.select("k1", "k2", "text"), wanted, length))

    # Repeated rows have the same places; each is listed once, so their lists do not grow with the repeats.
    several = several.select("k1", "k2", "start", "n", "digest").distinct()
    spans = several.join(found, "digest").select("k1", "k2", F.struct("start", "n", "runs").alias("span"))
    spans = stage(spans.groupBy("k1", "k2").agg(F.collect_list("span").alias("spans")), "spans")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch["id"], batch["text"], batch["spans"], strict=True):
                raw = (text or "").encode("utf-8")
                gone: list[tuple[int, int]] = []
                for span in spans if spans is not None else []:
                    at = span["start"]
                    if span["runs"] is None:
                        gone.append((at, at + span["n"] - 1 + length))
                    else:
                        gone += [(at + a, at + b + length) for a, b in np.frombuffer(span["runs"], "<i4").reshape(-1, 2).tolist()]
                gone = merge_spans(gone)
                edges = [0, *(x for lo_hi in gone for x in lo_hi), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(raw), [{"start": a, "end": b} for a, b in gone], left))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept"])

    kind = base.schema["id"].dataType.simpleString()
    keys = ["k1", "k2"]
    marked = flag(base, keys, key_bitmap(spans, keys), "_near")
    raw = F.coalesce(F.encode(F.col("text"), "utf-8"), F.lit(b""))
    clean = marked.filter(~F.col("_near")).select(
        "id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), raw.alias("kept")
    )
    joined = marked.filter("_near").join(spans, keys, "left").select(F.col("id"), "text", "spans")
    done = joined.mapInPandas(remove, f"id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return done.unionByName(clean.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))).withColumnRenamed("id", id_col)
