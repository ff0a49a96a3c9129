"""Token ids on disk: one zstandard frame per document under a shared dictionary.

Documents are ordered by id, encoded with a public tokenizer and written as blocks. A block is
a row of a Parquet table: the ids' frames joined, their offsets, the documents' ids and counts,
and the hash of the dictionary that decodes them. The dictionary is trained on the serialized
id arrays of a bounded sample of documents; any document can be read by decompressing its own
frame alone, which is what makes the many short ones cheap. Spark writes and reads the table,
so it can lie in any store that Spark reaches.

Ids are little-endian, two bytes wide if the vocabulary allows it and four otherwise.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SAMPLE_DOCS = 1000
SAMPLE_IDS = 4096  # of each sampled document, for the dictionary only
DICTIONARY_BYTES = 64 << 10
BLOCK_DOCS = 256
BLOCK_BYTES = 1 << 20
CACHE = 700_000  # encoded words, and pieces of words, that a worker remembers

BLOCK_SCHEMA = (
    "part int, first long, n_ids long, doc_ids array<{id}>, counts array<int>, offsets array<int>, "
    "frames binary, width int, dictionary string"
)

# Text of these characters is split as the tokenizer splits it, and each piece encoded once;
# other texts are only split at white space. No piece ever crosses white space.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ǃǍ-ǰȀ-ɏ]*")
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-ɏ]+"
)
_BLANK = re.compile("[ \t\n\r]+")


class Encoder:
    """Whole-text encoding by the tokenizer, with a bounded memory for pieces seen before."""

    def __init__(self, path: str, end_id: int | None, width: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self._splits_by_words()
        largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.width = width or (2 if max(largest, end_id or 0) < 1 << 16 else 4)
        self.end = b"" if end_id is None else int(end_id).to_bytes(self.width, "little")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = np.zeros(largest + 1, dtype=bool)
        if suffix:
            self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.seen: dict[str, bytes] = {}  # words
        self.known: dict[str, bytes] = {}  # pieces of plain words
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def _splits_by_words(self) -> bool:
        """Whether text may be encoded piece by piece: shown on a probe, else whole texts are encoded."""
        probe = "It's a TEST, they'll x2y  Été!! (don't)\nStraße 3.14 a'b ''s ?'t"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        parts = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in _PIECE.findall(probe.lower())]
        return whole == [i for p in parts for i in p]

    def _pieces(self, new: set[str]) -> None:
        """Encode plain words not seen before by their pieces, each of which is encoded once."""
        split = {w: _PIECE.findall(w) for w in new}
        known = self.known
        if len(known) > CACHE:
            known.clear()
        todo = list({p for parts in split.values() for p in parts} - known.keys())
        kind = f"<u{self.width}"
        for lo in range(0, len(todo), 2000):
            part = todo[lo : lo + 2000]
            # Many at a time, told apart by the tokens that end a piece.
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=kind)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(part):
                found = [ids[a:b].tobytes() for a, b in itertools.pairwise([0, *ends.tolist()])]
            else:
                found = [np.array(x.ids, dtype=kind).tobytes() for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            known.update(zip(part, found, strict=True))
        for word, parts in split.items():
            self.seen[word] = b"".join([known[p] for p in parts])

    def _apart(self, text: str) -> bytes:
        """Any other text, word by word as it stands."""
        words = _BLANK.split(text) if self.pieces else [text]
        kind = f"<u{self.width}"
        return b"".join(np.array(x.ids, dtype=kind).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Serialized ids of each text, end id included; a null is an empty text."""
        words: list[str] = []
        counts: list[int] = []
        apart: dict[int, bytes] = {}
        for i, text in enumerate(texts):
            own = []
            if text and self.pieces and _PLAIN.fullmatch(text) and not self.special.search(text):
                own = text.lower().split()
            elif text:
                apart[i] = self._apart(text)
            words += own
            counts.append(len(own))
        if not words:
            return [apart.get(i, b"") + self.end for i in range(len(texts))]
        kind = f"<u{self.width}"
        codes, unique = pd.factorize(np.array(words, dtype=object))
        missing = set(unique) - self.seen.keys()
        if len(self.seen) + len(missing) > CACHE:
            self.seen.clear()
            missing = set(unique)
        if missing:
            self._pieces(missing)
        serial = [self.seen[w] for w in unique]
        ids = np.frombuffer(b"".join(serial), dtype=kind)
        size = np.array([len(x) for x in serial]) // self.width
        start = np.cumsum(size) - size
        each = size[codes]
        ends = np.cumsum(each)
        flat = ids[np.repeat(start[codes] - (ends - each), each) + np.arange(ends[-1])].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])] * self.width
        return [apart.get(i, flat[lo:hi]) + self.end for i, (lo, hi) in enumerate(itertools.pairwise(cuts.tolist()))]


@lru_cache(maxsize=2)
def encoder_for(path: str, end_id: int | None) -> Encoder:
    """One encoder for all tasks of a worker process, which keeps what it has seen."""
    return Encoder(path, end_id)


def train_dictionary(docs: DataFrame, text_col: str, id_col: str, tokenizer: str, end_id: int | None) -> bytes:
    """Dictionary for the serialized ids of about SAMPLE_DOCS documents, chosen by a hash of the id."""
    total = docs.count()
    place = F.pmod(F.xxhash64(F.lit(10), F.col(id_col)), F.lit(1 << 30))
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    taken = docs.filter(place < int(share * (1 << 30))).select(F.col(text_col).alias("text"))
    taken = taken.repartition(2)  # few workers have to load the tokenizer for it

    def serialize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for batch in batches:
            encoder = encoder or encoder_for(tokenizer, end_id)
            yield pd.DataFrame({"ids": [x[: SAMPLE_IDS * encoder.width] for x in encoder.encode(batch["text"].tolist())]})

    samples = sorted(r[0] for r in taken.mapInPandas(serialize, "ids binary").limit(4 * SAMPLE_DOCS).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(s) for s in samples], threads=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""  # too few samples to learn from; frames then stand alone


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write ``docs`` in ascending id order (null first; rows of one id by text) under ``path``.

    A null text is empty. Repeated rows are written as often as they occur; an empty table
    gives an empty store. Only id and text are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, text_col, id_col, tokenizer, end_id)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary string, data binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )
    kind = docs.schema[id_col].dataType.simpleString()
    ordered = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .repartitionByRange("_id")
        .sortWithinPartitions("_id", "_text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = press = schema = None
        first = 0
        ids, frames, counts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal first, ids, frames, counts, size
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int32)
            row = [part, first, sum(counts), ids, counts, offsets.tolist(), b"".join(frames), encoder.width, name]
            first += sum(counts)
            ids, frames, counts, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            if encoder is None:
                encoder = encoder_for(tokenizer, end_id)
                press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
                schema = pa.schema(
                    [("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)),
                     ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("frames", pa.binary()), ("width", pa.int32()),
                     ("dictionary", pa.string())]
                )
            for lo in range(0, batch.num_rows, 2000):
                own = batch.slice(lo, 2000)
                for doc, raw in zip(own.column(0).to_pylist(), encoder.encode(own.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    counts.append(len(raw) // encoder.width)
                    frames.append(press.compress(raw))
                    size += len(frames[-1])
                    if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield block()
        if ids:
            yield block()

    ordered.mapInArrow(encode, BLOCK_SCHEMA.format(id=kind)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _load(spark: SparkSession, path: str) -> tuple[DataFrame, str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["data"])
    if hashlib.sha256(data).hexdigest() != row["dictionary"]:
        raise ValueError("The dictionary of this store is damaged.")
    return spark.read.parquet(f"{path}/blocks"), row["dictionary"], data


def _frames(block: dict, chosen: Iterator[int], press: zstandard.ZstdDecompressor, name: str) -> Iterator[tuple[int, np.ndarray]]:
    if block["dictionary"] != name:
        raise ValueError("A block was written with another dictionary.")
    view = memoryview(block["frames"])
    for i in chosen:
        raw = press.decompress(view[block["offsets"][i] : block["offsets"][i + 1]])
        yield i, np.frombuffer(raw, dtype=f"<u{block['width']}")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids."""
    blocks, name, data = _load(spark, path)
    parts = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())  # one row per file range
    starts, total = {}, 0
    for part, n in parts:
        starts[part] = total
        total += n
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for r in range(batch.num_rows):
                block = {k: v[0] for k, v in batch.slice(r, 1).to_pydict().items()}
                start = starts[block["part"]] + block["first"] + np.cumsum([0, *block["counts"]])[:-1]
                crcs, ids = [], []
                for _, found in _frames(block, range(len(block["doc_ids"])), press, name):
                    wide = found.astype("<u4")
                    crcs.append(zlib.crc32(wide.tobytes()))
                    if with_ids:
                        ids.append(wide.astype(np.int32))
                columns = [pa.array(block["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(start, pa.int64()),
                           pa.array(block["counts"], pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = ["part", "first", "doc_ids", "counts", "offsets", "frames", "width", "dictionary"]
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.select(*columns).mapInArrow(decode, schema)


def lookup_tokens(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """Ids of a few documents: the id lists of all blocks are read, but only the documents' own frames are decompressed."""
    blocks, name, data = _load(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    wanted = set(ids)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for block in batch.to_dict("records"):
                at = [i for i, d in enumerate(block["doc_ids"]) if d in wanted]
                got = [(block["doc_ids"][i], found.astype(np.int32)) for i, found in _frames(block, at, press, name)]
                yield pd.DataFrame(got, columns=["doc_id", "ids"])

    near = blocks.filter(F.arrays_overlap("doc_ids", F.array(*(F.lit(i).cast(kind) for i in ids))))
    return near.mapInPandas(decode, f"doc_id {kind}, ids array<int>")
