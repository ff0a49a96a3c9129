"""Ranked lexical search: the best documents of every query by accumulators, term at a time.

A term of a query is worth its weight, which falls with the number of documents that hold it,
times an impact, which grows with its occurrences in the document and falls with the document's
length; all but the logarithm in the weight is integer arithmetic. A document's score is the
sum over the query's terms, repeats included.

Tasks read documents in slices, invert each slice to postings of the queries' terms, and answer
all queries on it. Terms are taken rarest first. A posting may open an accumulator for its
document only while the bounds of the terms to come, their sum, can still reach the k-th best
partial score; from then on only the accumulators that exist are updated, by binary search in
the postings, and those that can no longer reach the k-th best are let go. The k best of a task's
earlier slices count as well. Bounds are compared so that equal scores are never lost; what is
kept is summed exactly. So the result is that of scoring every document.

Queries are answered in blocks of about ``BLOCK_BYTES`` of text, which bounds the terms, weights and
queries sent to the tasks; each block scans the documents twice, to count and to search. Postings
live in a task only as long as their slice, nothing of the documents is shuffled, and a
task returns k rows for each query of the block.

A null text has no terms. Documents with equal scores are ordered by ascending id, a null id
comes last. Repeated documents are ranked as often as they occur. Rows of the queries equal in id
and text count once; different texts under one id are ranked each for itself. Queries without
terms, without matches, and those for an empty table have no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessiongrid.schema import quoted
from sessiongrid.sources.storage import stage

BLOCK_BYTES = 4_000_000
SLICE_DOCS = 16_384
SLICE_TERMS = 4_000_000
# Fixed values of the score: impact = SCALE * tf / (1000 * tf + 8 * m), m = 100 - B + B * n * N / L.
SCALE = 1_000_000_000
B = 75


def _table() -> bytes:
    keep = {c: c for c in [*range(48, 58), *range(97, 123), *range(128, 256)]} | {c: c + 32 for c in range(65, 91)}
    return bytes(keep.get(c, 32) for c in range(256))


_TERMS = _table()


def terms(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters in lower case, and characters beyond ASCII."""
    return (text or "").encode("utf-8").translate(_TERMS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))


def corpus_counts(texts: DataFrame, numbers: Broadcast) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and the documents that hold each numbered term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = numbers.value.get
        holding, documents, total = np.zeros(len(numbers.value) + 1, dtype=np.int64), 0, 0
        for batch in batches:
            for text in batch["text"]:
                found = terms(text)
                documents += bool(found)
                total += len(found)
                held = list(filter(None, map(number, set(found))))
                holding[held] += 1
        seen = np.flatnonzero(holding)
        yield pd.DataFrame({"number": [-2, -1, *seen.tolist()], "n": [documents, total, *holding[seen].tolist()]})

    # One row for each numbered term reaches the driver.
    counted = texts.select("text").mapInPandas(run, "number int, n long").groupBy("number").agg(F.sum("n").alias("n"))
    found = {r["number"]: r["n"] for r in counted.collect()}
    return found.pop(-2, 0), found.pop(-1, 0), found


class Postings:
    """Inverted lists of one slice: documents (ascending) and impacts of each numbered term."""

    def __init__(self, numbers: array, tf: array, counts: list[int], m: list[int], size: int):
        number, tf = np.frombuffer(numbers, dtype=np.int32), np.frombuffer(tf, dtype=np.int64)
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        order = np.argsort(number, kind="stable")
        number, tf, self.doc = number[order], tf[order], doc[order]
        self.impact = (SCALE * tf) // (1000 * tf + 8 * np.array(m, dtype=np.int64)[self.doc])
        self.ends = np.searchsorted(number, np.arange(size + 1), side="right")
        self.most = np.zeros(size + 1, dtype=np.int64)
        heads = np.flatnonzero(np.diff(number, prepend=-1))
        if len(heads):
            self.most[number[heads]] = np.maximum.reduceat(self.impact, heads)

    def of(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.ends[number - 1], self.ends[number])
        return self.doc[own], self.impact[own]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def search_slice(postings: Postings, query: list[tuple[int, int]], k: int, known: int, scores: np.ndarray) -> np.ndarray:
    """Documents of a slice that can be among the k best: all that reach its k-th and the ``known`` score.

    ``query`` lists (term, factor), rarest first. ``scores`` holds a zero for every document of the
    slice; on return, those of the documents given are exact.
    """
    query = [(t, f) for t, f in query if f and postings.most[t]]
    left = [0]
    for t, f in reversed(query):
        left.append(left[-1] + f * int(postings.most[t]))
    left.reverse()  # left[i]: the most that terms i, i + 1 ... can add
    bar, i, highest = known, 0, 0
    while i < len(query):
        if left[i] < highest:  # only then the k-th best can lie above it
            bar = max(bar, _kth(scores[scores > 0], k))
        if left[i] < bar:
            break
        doc, impact = postings.of(query[i][0])
        scores[doc] += query[i][1] * impact
        highest = max(highest, int(scores[doc].max()))
        i += 1
    live = np.flatnonzero(scores)
    for i in range(i, len(query)):
        bar = max(bar, _kth(scores[live], k))
        live = live[scores[live] + left[i] >= bar]
        doc, impact = postings.of(query[i][0])
        at = np.minimum(np.searchsorted(doc, live), len(doc) - 1)
        hit = doc[at] == live
        scores[live[hit]] += query[i][1] * impact[at[hit]]
    bar = max(bar, _kth(scores[live], k))
    return live[scores[live] >= bar]


def _search(texts: DataFrame, numbers: Broadcast, queries: Broadcast, documents: int, total: int, k: int, schema: str) -> DataFrame:
    """The k best documents of each query in each task: query, id, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, size = numbers.value.get, len(numbers.value)
        best: list[list] = [[] for _ in queries.value]
        ids: list = []
        found, tf, counts, m = array("i"), array("q"), [], []

        def answer() -> None:
            postings = Postings(found, tf, counts, m, size)
            for q, query in enumerate(queries.value):
                scores = np.zeros(len(ids), dtype=np.int64)
                known = -best[q][-1][0] if len(best[q]) == k else 0
                near = search_slice(postings, query, k, known, scores)
                if len(near):
                    mine = [(-int(scores[d]), ids[d] is None, ids[d] if ids[d] is not None else 0) for d in near]
                    best[q] = heapq.nsmallest(k, best[q] + mine)

        for batch in batches:
            for doc, text in zip(batch["id"].to_numpy(), batch["text"], strict=True):
                words = terms(text)
                own = Counter(filter(None, map(number, words)))
                if not own:
                    continue
                ids.append(None if pd.isna(doc) else doc)
                found.extend(own)
                tf.extend(own.values())
                counts.append(len(own))
                m.append(100 - B + B * len(words) * documents // total)
                if len(ids) >= SLICE_DOCS or len(found) >= SLICE_TERMS:
                    answer()
                    ids, found, tf, counts, m = [], array("i"), array("q"), [], []
        if ids:
            answer()
        rows = [(q, None if none else doc, -negative) for q, own in enumerate(best) for negative, none, doc in own]
        yield pd.DataFrame(rows, columns=["query", "id", "score"])

    return texts.mapInPandas(run, schema)


def ranked_search(
    spark: SparkSession,
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), id and score of the ``k`` best documents of each query with a score above 0."""
    texts = _texts(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    asked = stage(
        queries.select(F.col(quoted(query_id)).alias("item"), F.col(quoted(query_text)).alias("text")).filter("text IS NOT NULL").distinct(), "asked"
    )
    bytes_asked = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(bytes_asked / block_bytes))
    kind = asked.schema["item"].dataType.simpleString()
    found = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        wanted = [(r["item"], Counter(terms(r["text"]))) for r in mine]
        numbers = {t: i for i, t in enumerate(sorted({t for _, own in wanted for t in own}), 1)}
        sent = spark.sparkContext.broadcast(numbers)
        documents, total, holding = corpus_counts(texts, sent)
        plans = []
        for _, own in wanted:
            held = sorted((holding[numbers[t]], numbers[t], n) for t, n in own.items() if numbers[t] in holding)
            plans.append([(t, n * weight(documents, df)) for df, t, n in held])
        hits = _search(texts, sent, spark.sparkContext.broadcast(plans), documents, total, k, "query int, id long, score long")
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(wanted)], f"query int, item {kind}")
        named = stage(hits.join(F.broadcast(names), "query").select("item", F.lit(block).alias("block"), "query", "id", "score"), "hits")
        found = named if found is None else found.unionByName(named)
    best = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select(F.col("item").alias(query_id), "rank", F.col("id").alias(id_col), "score")
    )
