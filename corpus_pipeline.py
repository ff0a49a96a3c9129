"""Language identification, exact and near dedup, source mixing and packing of ``documents``.

Each stage works on all rows that its predecessor kept, and what it decides takes effect: all
but the last return the columns of ``documents``. Rows of one doc_id may have different texts,
and each of them is judged by its own; a null doc_id is larger than any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessiongrid.llm.common import drop_rows, read_table
from sessiongrid.llm.exact_dedup import keep_first
from sessiongrid.llm.jaccard_join import jaccard_components
from sessiongrid.llm.langid import held_out, keep_identified, train
from sessiongrid.llm.mixing import mix_sources, repeat_rows
from sessiongrid.llm.packing import pack
from sessiongrid.llm.queries import sized, weighted_sources
from sessiongrid.sources.storage import stage

# Packing depends on how Spark splits its input, language identification on a model.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without text or letters go."""
    known = F.col("doc_id").isNotNull() & ~held_out()
    model = train(docs.filter(known).select("doc_id", "text", "lang"))
    if not model.languages:
        # Nothing to learn from: only what has no letter at all is rejected.
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    return keep_identified(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar shingles, the one with the smallest id.

    Rows are told apart by id and text, in the order of ids; those of one id and one text stay
    or go together, as exact dedup leaves a single one.
    """
    # Ids are longs: shifted and filled with zeros, they have their order as text too.
    place = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    text = F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), 1, 32)
    keyed = docs.withColumn("_key", F.concat_ws("/", F.coalesce(place, F.lit("null")), text))
    found = jaccard_components(keyed, "_key").filter("_key <> component_id")
    return drop_rows(keyed, stage(found.select("_key"), "copies"), "_key").drop("_key")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 2 times. Rows are told apart by id, source and text."""
    sizes = sized(docs)
    copies = mix_sources(sizes, weighted_sources(sizes), mark_col="mark")
    return repeat_rows(docs, copies, {"doc_id": F.col("doc_id"), "source": F.col("source"), "mark": F.xxhash64("text")})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all words of all documents in training sequences."""
    return pack(sized(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
