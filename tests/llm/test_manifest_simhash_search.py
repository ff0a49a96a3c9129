"""Merkle manifest, SimHash join and lexical search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sessiongrid.llm import lexical, merkle, simhash
from sessiongrid.llm.common import join_unique
from sessiongrid.llm.merkle import fold, manifest, sibling_text
from sessiongrid.llm.queries import ORACLES, QUERIES
from tests.compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Names that the operators use themselves.
CLASHING = "doc_id long, source string, lang string, n_chars long, text string, id string, node string, group string, index string, point string, item string, score string, _salt string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * 8) for r in rows], CLASHING)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_lexical_search"])
def test_queries_against_their_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck(SF_DIR).execute(ORACLES[name])) is None


# -- Merkle manifest -------------------------------------------------------------------------


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def brute_leaf(row) -> str:
    parts = [b"-" if v is None else f"{len(str(v).encode())}:{v}".encode() for v in row]
    return sha(b"".join(parts))


def brute_tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute_siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    found = []
    for level in levels[:-1]:
        first = at - at % 3
        found.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        at //= 3
    return found


def brute_manifest(rows, change):
    by: dict = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
    trees = {s: brute_tree([brute_leaf(r) for r in by[s]]) for s in order}
    top = brute_tree([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for i, row in enumerate(by[source]):
            path = brute_siblings(trees[source], i) + brute_siblings(top, k)
            node = brute_leaf(change(row))
            for left, right in path:
                node = sha(left + node + right)
            out.append((str(row[0]), trees[source][0][i], trees[source][-1][0], top[-1][0], "".join(a + b for a, b in path), node))
    return sorted(out)


def odd_rows(seed: int, count: int):
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "ä", *[f"s{i}" for i in range(9)], *["hot"] * 12]
    rows = [(k, rng.choice(sources), rng.choice(["de", None, ""]), rng.choice([0, None, 7]), rng.choice(["x\ny", "", None, "é\n", "long " * 50])) for k in range(count)]
    return rows + [(None, "a", None, None, None)] * 2 + [rows[3]] * 4 + [(rows[5][0], "hot", "other", 1, "t")]


@pytest.mark.parametrize("height", [2, 6])
def test_manifest_against_brute_force(spark, monkeypatch, height):
    """Low blocks make the table of block tops recurse; rows repeat, ids and sources are null."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = odd_rows(height, 150)

    def change(row):
        even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        return (*row[:4], row[4].replace("\n", "")) if even and row[4] is not None else row

    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(documents(spark, rows), ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": text})
    proof = found.withColumns({"proof": sibling_text(F.col("path")), "folded": fold(F.col("path"), F.col("tampered_leaf"))})
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof, r.folded) for r in proof.collect())
    assert got == brute_manifest(rows, change)


def test_manifest_of_few_rows(spark):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    assert manifest(documents(spark, []), columns).count() == 0
    one = manifest(documents(spark, [(7, None, None, None, None)]), columns).first()
    leaf = sha(b"1:7----")
    assert (one.leaf, one.subroot, one.root, one.path) == (leaf, leaf, leaf, [])


# -- SimHash ---------------------------------------------------------------------------------


def brute_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(len(words) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two THREE", "a b c d", "a  b\x0bc d e", "İ ß é Ä x y\x1cz w", "word " * 9, " ".join(map(str, range(70_000)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("limit", [4096, 3])
def test_grid_join_against_all_pairs(spark, limit):
    """Families of near points; with a small limit their cells go on to finer grids."""
    rng = random.Random(limit)
    points = {0, (1 << 64) - 1}
    for size in [1] * 40 + [6] * 20 + [150]:
        centre = rng.getrandbits(64)
        for _ in range(size):
            point = centre
            for _ in range(rng.choice([1, 2, 3, 5])):
                point ^= 1 << rng.randrange(64)
            points.add(point)
    frame = spark.createDataFrame([(signed(p),) for p in points], "point long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.linked_points(frame, limit=limit).collect()]
    assert all(0 < (a ^ b).bit_count() for a, b in links)
    ordered = sorted(points)
    every = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert brute_components(ordered, links) == brute_components(ordered, every)


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 64, (2, 2000), dtype=np.uint64)
    steps = np.bitwise_count(simhash.embed(a) ^ simhash.embed(b))
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * i)) & np.uint64(3)) for i in range(32)]).astype(int)
    assert (steps == np.abs(counts(a) - counts(b)).sum(axis=0)).all()
    assert (steps <= np.bitwise_count(a ^ b)).all()


def test_a_large_cell_across_batches_is_passed_on():
    import pandas as pd

    frames = [pd.DataFrame({"mask": [0] * 40_000, "cell": [lo // 80_000] * 40_000, "point": np.arange(lo, lo + 40_000)}) for lo in range(0, 240_000, 40_000)]
    frames.append(pd.DataFrame({"mask": [1, 1], "cell": [9, 9], "point": [0, 1 << 40]}))
    out = pd.concat(simhash._search(iter(frames), 4, 1000))
    assert sorted(out.loc[out["b"].isna(), "a"]) == list(range(240_000))
    assert out.dropna().values.tolist() == [[1 << 40, 0]]


def test_simhash_components(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=200) for _ in range(4)]
    texts = [None, "", "  ", "Solo", "solo "]
    for own in base:
        for _ in range(12):
            text = list(own)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(200)] = rng.choice(words)
            texts.append(" ".join(text))
    rows = [(k, "s", None, None, t) for k, t in enumerate(texts)]
    rows += [rows[10]] * 3 + [(None, None, None, None, "solo")]
    found = simhash.simhash_components(documents(spark, rows), limit=4).collect()
    prints = [brute_fingerprint(r[4]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = brute_components(range(len(rows)), pairs)
    smallest: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[root[i]] = min(smallest.get(root[i], r[0]), r[0])
    expected = Counter((r[0], f"{prints[i]:016x}", smallest.get(root[i])) for i, r in enumerate(rows))
    assert Counter(map(tuple, found)) == expected
    assert simhash.simhash_components(documents(spark, [])).count() == 0
    alone = simhash.simhash_components(documents(spark, [(None, None, None, None, None)])).collect()
    assert [tuple(r) for r in alone] == [(None, "0" * 16, None)]


def test_simhash_query_on_the_given_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    prints = {d.doc_id: brute_fingerprint(d.text) for d in docs}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = brute_components(ids, pairs)
    found = {tuple(r) for r in QUERIES["op12_simhash"](spark, SF_DIR).collect()}
    assert found == {(i, f"{prints[i]:016x}", root[i]) for i in ids}


def test_join_spreads_a_hot_key(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(3000).select(F.col("id").alias("x"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k")).write.parquet(path)
    rows = spark.read.parquet(path)
    table = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = join_unique(rows, table, ["k"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and max(sizes) < 900
        assert all(r.v == 2 * r.k for r in joined.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])


# -- Lexical search ---------------------------------------------------------------------------


def brute_terms(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute_search(docs, queries, k):
    bags = [(d, Counter(brute_terms(t)), len(brute_terms(t))) for d, t in docs]
    n_docs, total = sum(1 for b in bags if b[2]), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in queries:
        scored = []
        for doc, bag, n in bags:
            score = 0
            for term in brute_terms(text):
                if term in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (1000000000 * bag[term] // (1000 * bag[term] + 8 * (100 - 75 + 75 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        ranked = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(ranked, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_docs, block", [(16_384, 4_000_000), (3, 300)])
def test_search_against_brute_force(spark, monkeypatch, slice_docs, block):
    monkeypatch.setattr(lexical, "SLICE_DOCS", slice_docs)
    rng = random.Random(slice_docs)
    weights = [1 / (i + 1) for i in range(60)]
    words = [f"t{i}" for i in range(57)] + ["Ä", "éa", "Z9"]

    def text(n):
        return "".join(w + rng.choice([" ", ", ", "\x00", "-"]) for w in rng.choices(words, weights, k=n))

    docs = [(k, text(rng.choice([0, 1, 3, 30, 200]))) for k in range(160)]
    docs += [docs[4], docs[4], (None, docs[9][1]), (200, None), (201, "t1 " * 5000), (-5, docs[9][1])]
    queries = [(k, text(rng.choice([1, 4, 12, 40]))) for k in range(14)] + [(20, None), (21, "..."), (22, "absent"), (23, "t0 t0 t0 T0"), (23, "t0 t0 t0 T0")]
    frame = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], "doc_id long, text string, item_id string, score string, id string").repartition(3)
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in queries], "item_id long, text string, doc_id string, item string")
    found = lexical.ranked_search(spark, frame, asked, k=5, block_bytes=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_search(docs, list(dict.fromkeys(queries)), 5)


def test_common_terms_open_no_accumulators():
    """Once the k best are out of reach, further terms only update the documents found so far."""
    from array import array

    docs = 50
    numbers, tf, counts = array("i"), array("q"), []
    for d in range(docs):
        own = [1, 2] if d < 3 else [2]
        numbers.extend(own)
        tf.extend([1] * len(own))
        counts.append(len(own))
    postings = lexical.Postings(numbers, tf, counts, [100] * docs, 2)
    scores = np.zeros(docs, dtype=np.int64)
    near = lexical.search_slice(postings, [(1, 9000), (2, 10)], 3, 0, scores)
    assert near.tolist() == [0, 1, 2] and np.count_nonzero(scores) == 3
    impact = 1_000_000_000 // 1800
    assert scores[:3].tolist() == [9010 * impact] * 3
    # Equal bounds are not out of reach: a later document may tie.
    tie = np.zeros(docs, dtype=np.int64)
    assert len(lexical.search_slice(postings, [(1, 10), (2, 10)], 4, 0, tie)) == docs


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked_search(spark, empty, asked).count() == 0
    assert lexical.ranked_search(spark, asked.toDF("doc_id", "text"), asked.filter("false")).count() == 0
