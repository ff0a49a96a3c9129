"""Exact dedup, Jaccard join, repeated strings, token store: brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessiongrid.llm import jaccard_join, suffix_dedup
from sessiongrid.llm.components import components
from sessiongrid.llm.exact_dedup import exact_dedup, keep_first
from sessiongrid.llm.shingles import from_planes, shingle_sets, to_planes

# Names that the operators use inside or put out; the input may have them too.
CLASH = ["_text", "_length", "node", "n", "id", "text_sha256", "keep_id", "k1", "spans", "component_id", "_near"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", *CLASH) for i, t in rows], SCHEMA)


def random_texts(seed: int, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))] for _ in range(8)]
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i * 3, rng.choice([" ", "  ", "\n\t"]).join(text).replace("w1", rng.choice(["w1", "W1"]))))
    return [*rows, (1, None), (4, ""), (7, " \n "), (10, "one two"), (13, "ONE  two"), rows[5], rows[5], (None, rows[7][1]), (16, "ß é 漢字 " * 40)]


def test_exact_dedup_against_brute_force(spark):
    rows = random_texts(1)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t-\r]+", " ", t or "")].append(i)
    expected = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            expected[(i, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    found = Counter(map(tuple, exact_dedup(frame(spark, rows), hash_singles=True).collect()))
    assert found == expected
    kept = keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", *CLASH]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k[0] for k, n in expected.items() if k[3] for _ in range(n))


def test_exact_dedup_with_a_full_bitmap_and_without_rows(spark):
    rows = random_texts(2, 30)
    few = exact_dedup(frame(spark, rows), bits=1 << 15, prefix=1).drop("full_hash")
    assert Counter(map(tuple, few.collect())) == Counter(map(tuple, exact_dedup(frame(spark, rows)).drop("full_hash").collect()))
    assert exact_dedup(frame(spark, [])).count() == 0 and keep_first(frame(spark, [])).count() == 0


def sets_of(rows):
    out = []
    for _, t in rows:
        words = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
    return out


def brute_components(rows):
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return Counter((i, len(sets[k]), None if i is None else least[top(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("chunk", [3000, 4])
def test_jaccard_join_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", chunk)
    rows = random_texts(3 + chunk, 80)
    found = Counter(map(tuple, jaccard_join.jaccard_components(frame(spark, rows)).collect()))
    assert found == brute_components(rows)
    assert len({c for _, _, c in found}) < len(rows) - 20


def test_jaccard_join_without_rows(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    assert jaccard_join.jaccard_components(frame(spark, [(1, None)])).collect() == [(1, 0, 1)]


@pytest.mark.parametrize("seed", range(20))
def test_occurrences_find_all_similar_sets(seed):
    rng = random.Random(seed)
    universe = range(rng.choice([30, 200]))
    base = rng.sample(universe, rng.randint(5, 25))
    sets = [set(base) if rng.random() < 0.3 else set(rng.sample(universe, rng.randint(1, 25))) for _ in range(60)]
    for s in sets:
        for _ in range(rng.randint(0, 4)):
            s.add(rng.choice(universe))
    sizes = np.array([len(s) for s in sets])
    lists = {w: np.array([k for k, s in enumerate(sets) if w in s]) for w in universe}
    for q in sets:
        # Only sets of a possible size are in the lists, as in a block.
        fit = (sizes * 100 >= len(q) * 80) & (sizes * 80 <= len(q) * 100)
        own = [x[fit[x]] for x in (lists[w] for w in q) if len(x)]
        found = jaccard_join.occurrences(own, jaccard_join.required(len(q), 80), sizes, len(q), 80)
        assert set(found.tolist()) == {k for k, s in enumerate(sets) if 100 * len(q & s) >= 80 * len(q | s)}


def test_shingles_are_those_of_the_words():
    rows = random_texts(9)
    words = {}
    for (_, text), own, found in zip(rows, sets_of(rows), shingle_sets([t for _, t in rows]), strict=True):
        assert len(own) == len(found), text
        for s in own:
            words.setdefault(s, set()).add(len(found))
    values = np.array([0, 1, 255, 1 << 40, (1 << 64) - 1], dtype=np.uint64)
    assert (from_planes(to_planes(values)) == values).all()


def test_components_of_long_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (201, 200)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    groups = defaultdict(set)
    for node, root in found.collect():
        groups[root].add(node)
    assert sorted(map(len, groups.values())) == [2, 30, 41]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_arrays_against_sorting():
    for seed in range(60):
        rng = random.Random(seed)
        letters = rng.choice([b"ab", b"abcdefgh"])
        parts = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3)]
        texts = [b"".join(rng.choice(parts)[rng.randint(0, 5) :] for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))]
        length = rng.choice([3, 8, 17])
        texts = [t for t in texts if len(t) >= length]
        if texts:
            sa, data, end = suffix_dedup.suffix_array(texts)
            suffixes = [bytes(data[i : end[i]]) for i in sa]
            assert suffixes == sorted(suffixes)
            count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
            found = suffix_dedup.repeated_starts(texts, length)
            assert [f.tolist() for f in found] == [[count[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


@pytest.mark.parametrize("shard", [2_000_000, 300])
def test_repeats_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = random.Random(shard)
    length = 24
    passage = "".join(rng.choice("abcdefgh é") for _ in range(60))
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 20) : rng.randint(30, 60)] * rng.randint(0, 2) + "xyz"[k % 3] * rng.choice([0, 5, 60])) for k in range(40)]
    rows += [rows[3], rows[3], (90, rows[4][1]), (91, None), (92, ""), (None, rows[5][1]), (93, "ab" * 50)]
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    expected = Counter()
    for i, b in raw:
        spans = suffix_dedup.merge_spans([(k, k + length) for k in range(len(b) - length + 1) if count[b[k : k + length]] > 1])
        edges = [0, *(x for s in spans for x in s), len(b)]
        expected[(i, len(b), tuple(spans), b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))] += 1
    found = suffix_dedup.remove_repeats(frame(spark, rows), length=length, gram=8).collect()
    assert Counter((r[0], r[1], tuple(map(tuple, r[2])), bytes(r[3])) for r in found) == expected


def test_planted_passages_around_the_length(spark, tmp_path):
    """Over 50 words: 399 equal bytes stay, 400 go, also where only the last byte of a character is equal."""
    from sessiongrid.llm.queries import op9_suffix_dedup

    rng = random.Random(9)

    def prose(size):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(size // 6 + 1))[: size - 1] + "z"

    short, exact, inside = prose(399), prose(400), prose(399)
    assert min(len(p.split()) for p in (short, exact, inside)) > 50
    clean = prose(900)
    texts = [f"1{short}2", f"3{short}4", f"é{exact}é", f"5{exact}6", f"xé{inside}7", f"xũ{inside}8", clean, "é" * 150 + clean[:300], None]
    gone = {2: exact.encode(), 3: exact.encode(), 4: "é".encode()[1:] + inside.encode(), 5: "ũ".encode()[1:] + inside.encode()}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = set()
    for k, text in enumerate(texts):
        raw, cut = (text or "").encode(), gone.get(k, b"")
        left = raw.replace(cut, b"") if cut else raw
        expected.add((k, len(raw), len(cut), int(bool(cut)), hashlib.sha256(left).hexdigest()))
    assert set(map(tuple, op9_suffix_dedup(spark, str(tmp_path)).collect())) == expected


def test_repeats_without_rows(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_token_store_round_trip(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from sessiongrid.llm.token_store import lookup_tokens, read_tokens, write_tokens

    rows = [*random_texts(5, 40), (200, "It's <|endoftext|> Ñandú ÉCOLE"), (201, "a\x00b c"), (202, "don'T I'LL ²³ x_y !?"), (203, "İ Σας \x85 \xa0x")]
    path = str(tmp_path / "store")
    vocabulary = tokenizers.path("word_bpe_49k.json")
    write_tokens(frame(spark, rows), path, vocabulary, end_id=1)
    tokenizer = Tokenizer.from_file(vocabulary)
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows}
    found = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [(r.doc_id, r.ids) for r in found] == [(i, ids[t]) for i, t in order]
    assert [r.start for r in found] == [sum(len(ids[t]) for _, t in order[:k]) for k in range(len(order))]
    assert {r.doc_id: r.ids for r in lookup_tokens(spark, path, [200, 4, 999]).collect()} == {200: ids["It's <|endoftext|> Ñandú ÉCOLE"], 4: [1]}
    empty = str(tmp_path / "empty")
    write_tokens(frame(spark, []), empty, vocabulary)
    assert read_tokens(spark, empty).count() == 0


def test_another_tokenizer_encodes_whole_texts(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from sessiongrid.llm.token_store import Encoder

    path = tokenizers.path("byte_bpe_50k.json")
    encoder = Encoder(path, None)
    whole = Tokenizer.from_file(path)
    for text in ["Hello  world\n x", "été", ""]:
        assert np.frombuffer(encoder.encode([text])[0], f"<u{encoder.width}").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_rows_of_one_key_stay_apart(spark):
    found = exact_dedup(spark.range(3).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text")))
    assert sorted(r.kept for r in found.collect()) == [False, False, True]


def test_exact_dedup_against_sql(spark):
    from pathlib import Path

    from sessiongrid.llm.queries import ORACLES, QUERIES
    from tests.compare import differences, duck

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("needs the generated tables")
    found = QUERIES["op7_exact_dedup"](spark, "/root/testdata/sf0.001")
    assert differences(found, duck("/root/testdata/sf0.001").execute(ORACLES["op7_exact_dedup"])) is None
