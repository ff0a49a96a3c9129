"""Search, mixing, language, sharding, pages, packing and the pipeline."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessiongrid.llm import ann, html_text, langid, packing, shards
from sessiongrid.llm.common import ordered_index
from sessiongrid.llm.mixing import mix_sources, repeat_rows, source_sizes, water_fill
from sessiongrid.llm.page_layouts import labelled_page
from sessiongrid.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the generated tables")


# -- Nearest neighbours --------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<float>, id string, vec string, bucket string")


@pytest.mark.parametrize("part, mean", [(20_000, 4000), (15, 2)])
def test_nearest_against_brute_force(spark, monkeypatch, part, mean):
    monkeypatch.setattr(ann, "ROWS_PER_PART", part)
    rng = np.random.default_rng(part)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    x[100:160] = x[7]  # one vector for a fifth of the rows
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(900, None), (950, [0.0] * 12), (1000, [float("nan")] + [1.0] * 11), (1050, [None] + [1.0] * 11), (1100, [1.0])]
    every = vectors(spark, [*rows, *odd, rows[3], rows[50]])
    found = ann.nearest(every, every.filter("vec_id % 50 = 0"), k=5, tables=12, probes=24 if mean > 2 else 200, mean_bucket=mean).collect()
    by = defaultdict(list)
    for r in found:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 300, 50))
    hit = 0
    for q, got in by.items():
        got.sort()
        exact = sorted((-ann.cosine(x[q].astype(float), x[k].astype(float)), k) for k in range(300) if k != q)[:5]
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert [(-s, k) for _, k, s in got] == sorted((-s, k) for _, k, s in got)
        assert all(s == ann.cosine(x[q].astype(float), x[k].astype(float)) for _, k, s in got)
        hit += len({k for _, k in exact} & {k for _, k, _ in got})
    assert hit >= 27
    assert [k for _, k, _ in sorted(by[100])] == [7, 101, 102, 103, 104]


def test_nearest_of_few_or_no_vectors(spark):
    two = vectors(spark, [(0, [1.0, 0.0]), (50, [0.0, 1.0])])
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(two, two, k=5, probes=99).collect()) == [(0, 1, 50, 0.0), (50, 1, 0, 0.0)]
    none = vectors(spark, [(0, None)])
    assert ann.nearest(none, none).count() == 0
    assert ann.nearest(vectors(spark, []), none).count() == 0


@pytest.mark.parametrize("mean", [4, 2])
def test_recall_with_many_buckets(spark, mean):
    """The probes of production, with as many buckets as millions of vectors would get."""
    rng = np.random.default_rng(mean)
    x = rng.normal(size=(1500, 64)).astype(np.float32)
    every = vectors(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    found = ann.nearest(every, every.filter("vec_id % 50 = 0"), k=5, mean_bucket=mean).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        best = [k for k in np.argsort(-(unit @ unit[q])).tolist() if k != q][:5]
        hit += len(set(best) & {r.vec_id for r in found if r.query_id == q})
    assert hit >= 0.9 * 150


@needs_tables
def test_recall_on_the_given_vectors(spark):
    found = QUERIES["op1_nearest"](spark, SF_DIR).collect()
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows}
    hit = total = 0
    for q in (k for k in x if k % 50 == 0):
        best = sorted((-ann.cosine(x[q], v), k) for k, v in x.items() if k != q)[:5]
        hit += len({k for _, k in best} & {r.vec_id for r in found if r.query_id == q})
        total += len(best)
    assert hit >= 0.9 * total


# -- Mixing --------------------------------------------------------------------------------


def brute_targets(sizes, weights, budget, cap):
    target, free, left = {}, set(sizes), budget
    while free:
        share = {s: left * weights[s] / sum(weights[k] for k in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", "B", "ä", None, *["hot"] * 4]), rng.choice([0, 1, 5, 40])) for k in range(3000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, size long, target string, _bucket string")
    sources = ordered_index(source_sizes(docs), F.col("source").asc_nulls_last())
    order = [r.source for r in sources.orderBy("index").collect()]
    assert order == ["B", "a", "b", "hot", "ä", None]
    weights = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("index") % 3 + 1).cast("int"))
    total = sum(z for _, _, z in rows)
    filled = water_fill(sources.withColumn("weight", weights), 1.5 * total, 2.0)
    sizes = Counter()
    for _, s, z in rows:
        sizes[s] += z
    expected = brute_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * total, 2)
    assert {r.source: r.target for r in filled.collect()} == pytest.approx(expected)
    mixed = mix_sources(docs, filled, rows_per_bucket=100).collect()
    assert sorted(r.doc_id for r in mixed) == list(range(3000))
    taken = Counter()
    for r in mixed:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - expected[s]) <= 40 for s in expected)
    again = mix_sources(docs.repartition(5), filled, rows_per_bucket=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))
    repeated = repeat_rows(docs, spark.createDataFrame(mixed, docs.select("doc_id", "source", "size").schema.add("source_size", "long").add("t", "double").add("copies", "long")), {c: F.col(c) for c in ("doc_id", "source", "size")})
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in mixed)


def test_rows_without_an_id_are_repeated_one_by_one(spark):
    """Rows of one size and no id, told apart by their text; the mix stays within half a document of its targets."""
    rows = [(None, "a" if k % 3 else "b", 40, k, f"t{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, mark long, text string")
    sources = source_sizes(docs).withColumn("weight", F.when(F.col("source") == "a", 1).otherwise(2))
    filled = water_fill(sources, 3000.0, 2.0)
    copies = mix_sources(docs, filled, mark_col="mark", rows_per_bucket=10)
    key = {c: F.col(c) for c in ("doc_id", "source", "mark")}
    taken = {r.source: r.n * 40 for r in repeat_rows(docs, copies, key).groupBy("source").agg(F.count("*").alias("n")).collect()}
    targets = {r.source: r.target for r in filled.collect()}
    assert all(abs(taken[s] - targets[s]) <= 20 for s in targets)
    # Equal rows share their copies evenly.
    equal = spark.createDataFrame([(None, "a", 40, 1, "t")] * 7, docs.schema)
    mine = mix_sources(equal, spark.createDataFrame([("a", 280, 400.0)], "source string, source_size long, target double"), mark_col="mark")
    assert repeat_rows(equal, mine, key).count() == sum(r.copies for r in mine.collect()) == 10


def test_vectors_of_several_lengths(spark):
    """Each query is answered among the vectors of its own length, however many others there are."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=3 if k % 4 == 0 else 5).tolist()) for k in range(240)] + [(300, [1.0] * 7)]
    every = vectors(spark, rows)
    found = ann.nearest(every, every.filter("vec_id % 50 = 0"), k=5, probes=64).collect()
    by = {k: np.array(v) for k, v in rows}
    for query in (0, 50, 100, 150, 200):
        others = [k for k, v in by.items() if k != query and len(v) == len(by[query])]
        exact = sorted(others, key=lambda k: (-ann.cosine(by[query], by[k]), k))[:5]
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == query), key=lambda r: r["rank"])] == exact
    assert not [r for r in found if r.query_id == 300]


def test_mixing_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, size long")
    sources = water_fill(source_sizes(docs).withColumn("weight", F.lit(1)), 0.0, 2.0)
    assert mix_sources(docs, sources).count() == 0
    empty = spark.createDataFrame([(1, "a", 0)], docs.schema)
    sources = water_fill(source_sizes(empty).withColumn("weight", F.lit(1)), 0.0, 2.0)
    assert [r.target for r in sources.collect()] == [0.0]
    assert mix_sources(empty, sources).count() == 1


# -- Languages -----------------------------------------------------------------------------


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    lengths = np.array([4, 1, 0, 6, 3])
    scores = rng.normal(size=(lengths.sum(), 3)) * 2
    found = langid.viterbi(scores, lengths, 1.5)
    at = 0
    for n in lengths:
        own = scores[at : at + n]
        value = lambda y: sum(own[t, k] for t, k in enumerate(y)) - 1.5 * sum(a != b for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert value(tuple(found[at : at + n])) == pytest.approx(value(best))
        at += n


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(2)
    parts = {"aa": ["the", "ing", "whi", "tion"], "bb": ["sch", "ung", "keit", "ein"], "ru": ["при", "ост", "вет"]}
    return lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark, languages):
    rows = [(k, languages(lang, 60), lang, "x") for k, lang in enumerate(["aa", "bb", "aa", "ru"] * 30)]
    rows += [(900, None, "aa", "x"), (901, "what", None, "x"), (902, "123", "zz", "x")]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, at string"), docs_per_language=20)


def test_spans_and_special_texts(spark, languages, model):
    assert model.languages == ("aa", "bb", "ru")
    mixed = languages("aa", 30) + ". " + languages("bb", 20) + " — " + languages("ru", 10)
    rows = [(1, mixed), (2, languages("bb", 5).upper() + "!!"), (3, None), (4, ""), (5, "12 ²½ _ --"), (6, "漢字"), (7, languages("ru", 3)), (7, languages("aa", 9) * 3000)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, lang_pred string, lang string")
    found = langid.identify(docs, model, spans=True)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_spans"]
    out = {(r.doc_id, r.text): r for r in found.collect()}
    first = out[(1, mixed)]
    assert [s.lang for s in first.lang_spans] == ["aa", "bb", "ru"]
    assert first.lang_pred == "aa" and 0.3 < first.lang_score < 0.8
    assert mixed[first.lang_spans[1].start : first.lang_spans[1].end] in mixed.split(". ")[1]
    assert [out[r].lang_pred for r in rows[1:]] == ["bb", "und", "und", "und", "aa", "ru", "aa"]
    assert [out[r].lang_score for r in rows[2:6]] == [0.0] * 4
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 6, 7, 7])
    assert langid.identify(docs.limit(0), model).count() == 0


@needs_tables
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = QUERIES["op4_language_id"](spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id")
    row = found.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.98 and row[1] >= 0 and row[2] <= 1


# -- Sharding ------------------------------------------------------------------------------


def test_matrix_has_exact_sums():
    for seed in range(20):
        sizes = [random.Random(seed).randint(0, 50) for _ in range(9)]
        m = shards.communication_matrix(sizes, 4, seed)
        assert m.sum(axis=1).tolist() == sizes and m.min() >= 0
        assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_large_hypergeometric_draws_have_the_right_mean(monkeypatch):
    monkeypatch.setattr(shards, "_EXACT", 0)
    rng = np.random.default_rng(0)
    draws = [shards.hypergeometric(rng, 300, 700, 100) for _ in range(3000)]
    variance = 100 * 0.3 * 0.7 * 900 / 999
    assert abs(np.mean(draws) - 30) < 4 * math.sqrt(variance / 3000)
    assert abs(np.var(draws) / variance - 1) < 0.15
    assert {shards.hypergeometric(rng, 3, 0, 2), shards.hypergeometric(rng, 0, 9, 4)} == {2, 0}


def test_shards_are_even_gapless_and_stable(spark):
    rows = [(k if k % 7 else None, f"t{k % 10}", "x", "y") for k in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, t string, _block string, slots string")
    found = shards.shuffle_shards(docs, "doc_id", 8, seed=1, rows_per_block=40)
    assert found.columns == [*docs.columns, "shard", "slot"]
    out = found.collect()
    assert Counter((r.doc_id, r.t) for r in out) == Counter(r[:2] for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and {len(v) for v in by.values()} == {125, 126}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = shards.shuffle_shards(docs.repartition(3), "doc_id", 8, seed=1, rows_per_block=40).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    # Copies of one text are spread: about a tenth of each shard has each of the ten texts.
    mix = Counter((r.shard, r.t) for r in out)
    assert max(mix.values()) < 30
    assert shards.shuffle_shards(docs.limit(0), "doc_id", 8).count() == 0


def test_rows_of_one_id_spread_over_blocks(spark, monkeypatch):
    seen = []
    draw = shards.communication_matrix
    monkeypatch.setattr(shards, "communication_matrix", lambda sizes, *a: seen.append(sizes) or draw(sizes, *a))
    rows = [(None if k % 3 else k, k, k) for k in range(3000)]
    found = shards.shuffle_shards(spark.createDataFrame(rows, "doc_id long, size long, crc long"), "doc_id", 4, rows_per_block=100).collect()
    assert sum(seen[0]) == 3000 and max(seen[0]) < 200
    assert sorted(r.crc for r in found) == list(range(3000))
    assert sorted((r.shard, r.slot) for r in found) == [(s, k) for s in range(4) for k in range(750)]


# -- Pages ---------------------------------------------------------------------------------


def test_held_out_layouts():
    model = html_text.train()
    wrong = total = skipped = 0
    for seed in range(9000, 9150):
        pieces = labelled_page(seed)
        gold = [c for piece, c in pieces for _ in html_text.blocks(piece)]
        found = model.decode(html_text.blocks("".join(p for p, _ in pieces)))
        if len(found) != len(gold):  # two pieces ran into one block, so its label is not known
            skipped += 1
            continue
        wrong += sum(a != b for a, b in zip(found, gold, strict=True))
        total += len(gold)
    assert skipped <= 5
    assert wrong <= 0.01 * total


def test_viterbi_of_the_field_is_the_best_labelling():
    model = html_text.Field({"bias": (0.1, 0.0), "in=nav": (2.0, -1.0), "ends=True": (0.0, 1.5)}, ((0.5, -0.7), (-0.2, 0.4)))
    page = html_text.blocks("<nav>a<p>b.</nav><p>c.</p><p>d</p><div>e.</div>")
    rows = [[model.weights.get(f, (0.0, 0.0)) for f in r] for r in html_text.features(page)]
    value = lambda y: sum(w[k] for r, k in zip(rows, y, strict=True) for w in r) + sum(model.moves[a][b] for a, b in itertools.pairwise(y))
    best = max(itertools.product((0, 1), repeat=len(page)), key=value)
    assert value([int(x) for x in model.decode(page)]) == pytest.approx(value(best))


def test_blocks_of_broken_markup():
    page = (
        "<title>no</title><script>var t='</p>';</script><style>p{}</style><body><!-- x <p>no</p> --><h1>A &amp;amp; B&#33;</h1>"
        "<p>one<br>two <b>th<i>ree</b> four<p>five\n\t six&nbsp;x<ul><li>a<li>b</ul><p>2 < 3 & 4<textarea>no</textarea></div>tail"
    )
    assert [b.text for b in html_text.blocks(page)] == ["A &amp; B!", "one two three four", "five six x", "a", "b", "2 < 3 & 4", "tail"]
    assert html_text.blocks("") == [] and html_text.blocks("<p>  </p><!-- open") == []


def test_letters_that_grow_in_lower_case_lose_no_text():
    page = "<p>" + "İ" * 12 + " one</p><script>var x = '<p>no</p>';</SCRIPT><p>two</p><style>p {}</Style ><p>three</p>"
    assert [b.text for b in html_text.blocks(page)] == ["İ" * 12 + " one", "two", "three"]


def test_pages_with_nulls_and_clashing_columns(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title here</h1><p>First sentence of it.<p>Second one, too.</article><div class='comments'><p>Nice words, thanks.</p></div><footer>&copy; x</footer>"
    rows = [(1, page, "u", "t"), (1, page, "u", "t"), (2, None, "u", "t"), (3, "", None, "t"), (4, "<nav>x</nav>" * 5, "u", "t")]
    found = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, url string, text string"))
    assert found.columns == ["page_id", "url", "text"]
    out = Counter(map(tuple, found.collect()))
    text = "Title here\nFirst sentence of it.\nSecond one, too."
    assert out == Counter([(1, "u", text), (1, "u", text), (2, "u", ""), (3, None, ""), (4, "u", "")])


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<head><title>t</title><p>text", ["text"]),
        ("<html><head><meta charset=x><style>p{}</style>bare<p>text</html>", ["bare", "text"]),
        ("<head><noscript><img src=x>no</noscript><link rel=y></head><body><p>text", ["text"]),
        ("<head><template><p>no</p></template><title>no</title></head><p>text", ["text"]),
        ("<p title=don't>One</p><p>it's</p><p>two</p>", ["One", "it's", "two"]),
        ('<p><a href="x"">One</a></p><p>a "quote" b</p>', ["One", 'a "quote" b']),
        ("<p title = 'a>b' class=\"c>d\">One</p>", ["One"]),
        ('<p id=a="b>One</p><p>"two"</p>', ["One", '"two"']),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p>", ["if x=1 then"]),
        ("<p>a <object data=x><param name=y>b</object> c</p><noscript><p>d</p></noscript>", ["a b c", "d"]),
    ],
)
def test_blocks_keep_all_shown_text(page, texts):
    assert [b.text for b in html_text.blocks(page)] == texts


# -- Packing -------------------------------------------------------------------------------


def naive_best_fit(sizes, capacities, cost):
    free, filled, where = [], [], {}
    left = sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        left -= sizes[i]
        fits = [b for b, f in enumerate(free) if f >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: free[b])
        else:
            c = min((c for c in capacities if c >= sizes[i]), key=lambda c: cost(c) / (sizes[i] + min(c - sizes[i], left)))
            free.append(c)
            filled.append(0)
            b = len(free) - 1
        free[b] -= sizes[i]
        filled[b] += sizes[i]
        where[i] = b
    return len(free), sum(min(c for c in capacities if c >= f) for f in filled)


@pytest.mark.parametrize("seed", range(15))
def test_best_fit_equals_a_naive_one(seed):
    rng = random.Random(seed)
    capacities = [16, 32, 64]
    sizes = [rng.randint(1, 64) for _ in range(rng.randint(0, 120))]
    bins, offsets, lengths = packing.best_fit(sizes, capacities)
    used = defaultdict(list)
    for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes, strict=True):
        used[b].append((o, s))
    for b, own in used.items():
        own.sort()
        assert all(o == sum(s for _, s in own[:k]) for k, (o, _) in enumerate(own))
        assert lengths[b] == min(c for c in capacities if c >= sum(s for _, s in own))
    assert (len(lengths), int(lengths.sum())) == naive_best_fit(sizes, capacities, packing.sequence_cost)
    if sizes:
        single = packing.best_fit(sizes, [64])[2]
        assert lengths.sum() <= single.sum()


def test_packing_places_every_word(spark):
    rows = [(k, z, "x", "y") for k, z in enumerate([0, 1, 63, 64, 65, 200, None, 30, 30])] + [(3, 64, "x", "y"), (None, 5, "x", "y")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, size long, block string, bin string"), capacities=(16, 64), pieces_per_block=4).collect()
    words = Counter()
    for r in found:
        words[r.doc_id] += r.n_words
        assert (r.bin is None) == (r.n_words == 0)
    assert words == Counter({0: 0, 1: 1, 2: 63, 3: 128, 4: 65, 5: 200, 6: 0, 7: 30, 8: 30, None: 5})
    by = defaultdict(int)
    for r in found:
        if r.n_words:
            by[(r.block, r.bin, r.capacity)] += r.n_words
    assert all(n <= c for (_, _, c), n in by.items())
    assert packing.pack(spark.createDataFrame([], "doc_id long, size long")).count() == 0


# -- Registered queries and the pipeline ------------------------------------------------------

COLUMNS = {
    "op1_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_shuffle_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op6_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op8_pack": {"doc_id": "bigint"},
    "op9_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_token_store": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


@needs_tables
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_columns(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    assert COLUMNS[name].items() <= dict(found.dtypes).items()


@needs_tables
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [(10_000, None, "en", "src1", 0), (10_001, "12 34", None, None, 5), (10_002, docs.first().text, "en", "src2", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns, kept = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        function(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert name == "pack" or docs.columns == columns
    assert set(kept["language_id"]) == set(range(200)) | {10_002}
    assert 10_002 not in kept["exact_dedup"] and max(kept["exact_dedup"].values()) == 1
    assert set(kept["jaccard_join"]) <= set(kept["exact_dedup"])
    assert set(kept["mix_sources"]) <= set(kept["jaccard_join"]) and max(kept["mix_sources"].values()) <= 2
    assert set(kept["pack"]) == set(kept["mix_sources"])
    empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        path = str(tmp_path / f"{name}-empty")
        function(spark, empty, SF_DIR).write.parquet(path)
        assert spark.read.parquet(path).count() == 0


def plain_stages(rows):
    """Ids left by each filter, and the words of each source, by plain loops over (id, text, source)."""
    words = lambda t: re.findall(r"[^ \x09-\x0D]+", t or "")
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = {}
    for doc, text, source in sorted(lettered):
        first.setdefault(re.sub(r"[ \x09-\x0D]+", " ", text), (doc, text, source))
    unique = list(first.values())
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc, text, _ in unique:
        own = words(text.translate(lower))
        sets[doc] = {tuple(own[i : i + 5]) for i in range(max(len(own) - 4, 1))}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    single = [r for r in unique if find(r[0]) == r[0]]
    sizes = Counter()
    for _, text, source in single:
        sizes[source] += len(words(text))
    return [{r[0] for r in kept} for kept in (lettered, unique, single)], sizes, {r[0]: (r[2], len(words(r[1]))) for r in single}


@needs_tables
def test_pipeline_run_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [(10_000, None, "en", "src1", 0), (10_001, "12 34", None, None, 5), (10_002, docs.first().text, "en", "src2", 1)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    survivors, sizes, single = plain_stages(rows)
    assert len(survivors[0]) > len(survivors[1]) > len(survivors[2])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = brute_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    placed, bins = Counter(), defaultdict(list)
    for r in packed:
        placed[r.doc_id] += r.n_words
        if r.n_words:
            bins[r.block, r.bin].append((r.offset, r.n_words, r.capacity))
    taken = Counter()
    assert set(placed) <= survivors[2]
    for doc, words in placed.items():
        source, size = single[doc]
        assert size == 0 or words % size == 0 and words // size in (1, 2)
        taken[source] += words
    largest = {s: max(n for own, n in single.values() if own == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 for s in sizes)
    for pieces in bins.values():
        at = 0
        for offset, n, capacity in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity


def test_near_copies_are_judged_row_by_row(spark):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(200)) for _ in range(5)]
    near = lambda k, *end: " ".join([*texts[k].split()[: 200 - len(end)], *end])
    rows = [
        (-7, near(4, "x")), (1, texts[0]), (2, near(0, "x")), (2, texts[1]), (10, texts[4]),
        (None, texts[2]), (None, near(2, "x")), (None, near(0, "y")), (None, near(1, "y")), (None, texts[3]), (None, None), (9, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n int")
    found = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert found.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in found.collect())
    one = [t for t in (texts[2], near(2, "x")) if (None, t) in left]
    assert len(one) == 1
    assert left == Counter([(-7, near(4, "x")), (1, texts[0]), (2, texts[1]), (None, one[0]), (None, texts[3]), (None, None), (9, None)])
