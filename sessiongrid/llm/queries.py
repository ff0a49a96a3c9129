"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.llm.ann import nearest
from sessiongrid.llm.common import ordered_index, read_table, word_count
from sessiongrid.llm.exact_dedup import exact_dedup
from sessiongrid.llm.html_text import extract_text
from sessiongrid.llm.jaccard_join import jaccard_components
from sessiongrid.llm.langid import held_out, identify, train
from sessiongrid.llm.lexical import ranked_search
from sessiongrid.llm.merkle import fold, manifest, sibling_text
from sessiongrid.llm.mixing import mix_sources, source_sizes, water_fill
from sessiongrid.llm.packing import pack
from sessiongrid.llm.shards import shuffle_shards
from sessiongrid.llm.simhash import simhash_components
from sessiongrid.llm.suffix_dedup import remove_repeats
from sessiongrid.llm.token_store import read_tokens, write_tokens
from sessiongrid.sources.storage import scratch_path, stage


def sized(docs: DataFrame) -> DataFrame:
    """Id, source, number of words and a hash of the text, written once: texts are read a single time."""
    return stage(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("mark")), "sizes")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(read_table(spark, sf_dir, "documents"))
    mixed = mix_sources(docs, weighted_sources(docs), mark_col="mark")
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def weighted_sources(docs: DataFrame) -> DataFrame:
    """Targets of the registered mix: weights 3, 1, 2 in turn, 150 % of all words, 2 epochs at most."""
    sources = ordered_index(source_sizes(docs), F.col("source").asc_nulls_last())
    weights = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("index") % 3 + 1).cast("int"))
    sources = stage(sources.withColumn("weight", weights).drop("index"), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    return water_fill(sources, 1.5 * total, 2.0)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    known = F.col("doc_id").isNotNull() & ~held_out()
    model = train(docs.filter(known).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op5_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")
    )
    return shuffle_shards(docs, "doc_id", shards=8, seed=5).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read_table(spark, sf_dir, "documents"), hash_singles=True)
    return found.withColumnRenamed("full_hash", "text_sha256")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(sized(read_table(spark, sf_dir, "documents")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_token_store(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    write_tokens(docs, path, public_tokenizers.path(vocabulary), end_id=1)
    return read_tokens(spark, path, with_ids=False)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered={"text": text})
    folded = found.withColumn("folded_root", fold(F.col("path"), F.col("tampered_leaf")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(sibling_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_mix_sources": op2_mix_sources,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_language_id": op4_language_id,
    "op5_shuffle_shards": op5_shuffle_shards,
    "op6_html_text": op6_html_text,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pack": op8_pack,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_store": op10_token_store,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash": op12_simhash,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op7_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op11_merkle_manifest": r"""
        WITH RECURSIVE crc_bytes AS (
            SELECT doc_id, list_reduce(
                list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                    lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))),
                lambda acc, byte: xor(xor(acc, byte) >> 1, 3988292384 * (xor(acc, byte) & 1))) AS crc
            FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
        ), d AS (
            SELECT row_number() OVER () AS r, *, coalesce(xor(crc, 4294967295) % 2 = 0, false) AS even
            FROM documents LEFT JOIN crc_bytes USING (doc_id)
        ), parts AS (
            SELECT r, doc_id, coalesce('s' || source, '') AS g,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                text, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS other
            FROM d
        ), leaves AS (
            SELECT r, doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other
            FROM parts
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
        ), up AS (
            SELECT 0 AS level, g, pos, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM placed
            UNION ALL
            SELECT level + 1, g, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value(n + 2) // 3
            FROM up WHERE n > 1 GROUP BY level, g, pos // 3
        ), subroots AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS pos FROM up WHERE n = 1
        ), high AS (
            SELECT 0 AS level, pos, node, (SELECT count(*) FROM subroots) AS n FROM subroots
            UNION ALL
            SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value(n + 2) // 3
            FROM high WHERE n > 1 GROUP BY level, pos // 3
        ), every AS (
            SELECT g, level, pos, node, n FROM up
            UNION ALL SELECT NULL, 1000 + level, pos, node, n FROM high
        ), runs AS (
            SELECT g, level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM every WHERE n > 1 GROUP BY ALL
        ), walk AS (
            SELECT r, placed.g, 0 AS level, pos, other AS node, '' AS proof, false AS done FROM placed
            UNION ALL
            SELECT w.r, w.g,
                CASE WHEN x.run IS NOT NULL THEN w.level + 1 WHEN w.level < 1000 THEN 1000 ELSE w.level END,
                CASE WHEN x.run IS NOT NULL THEN w.pos // 3 WHEN w.level < 1000 THEN (SELECT s.pos FROM subroots s WHERE s.g = w.g) ELSE w.pos END,
                CASE WHEN x.run IS NOT NULL THEN sha256(
                    array_to_string(x.nodes[1 : w.pos % 3], '') || w.node || array_to_string(x.nodes[w.pos % 3 + 2 :], '')) ELSE w.node END,
                CASE WHEN x.run IS NOT NULL THEN w.proof
                    || array_to_string(x.nodes[1 : w.pos % 3], '') || array_to_string(x.nodes[w.pos % 3 + 2 :], '') ELSE w.proof END,
                x.run IS NULL AND w.level >= 1000
            FROM walk w LEFT JOIN runs x
                ON x.level = w.level AND x.run = w.pos // 3 AND (x.g = w.g OR w.level >= 1000)
            WHERE NOT w.done
        )
        SELECT p.doc_id, p.leaf, s.node AS subroot, h.node AS root, sha256(w.proof) AS proof_sha256,
            w.node AS folded_root, w.node = h.node AS verified
        FROM placed p JOIN subroots s USING (g) JOIN walk w ON w.r = p.r AND w.done, (SELECT node FROM high WHERE n = 1) h
    """,
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents
        ), c AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0
        ), tf AS (
            SELECT r, doc_id, n, term, count(*) AS tf
            FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL
        ), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
        ), q AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
        ), s AS (
            SELECT item_id, r, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
            FROM q JOIN df USING (term) JOIN tf USING (term), c GROUP BY item_id, r, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
    """,
}
