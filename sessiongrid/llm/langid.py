"""Language identification of mixed text: scripts, character n-grams, Viterbi over words.

A word's script narrows its candidates to the languages written in it; for these, the word's
score is the sum of log probabilities of its character n-grams (1 to 3, word ends included).
Viterbi with a penalty for each switch then labels every word, so a foreign name does not
break a sentence but a foreign sentence becomes a span of its own. A text's language is the
one whose spans hold most letters; its score is their share of all letters.

The model is counted by Spark tasks over labelled rows. About ``docs_per_language`` of each
language are taken, chosen by a hash of the id: that bound is the only sample here, and the
counts come as one array for each language and script to the driver. Prediction reads every
text whole, in slices of ``SLICE_CHARS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessiongrid.llm.common import releasing

DOCS_PER_LANGUAGE = 3000
PENALTY = 12.0
SLICE_CHARS = 1_000_000
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
UNKNOWN = "und"
OUTPUT = ("lang_pred", "lang_score", "lang_spans")

# First code points of the blocks of each script, in order; "" holds no words.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, ""), (0x0750, "arabic"), (0x0780, ""), (0x08A0, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""),
    (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""),
    (0xFE70, "arabic"), (0xFF00, ""), (0xFF21, "latin"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, ""), (0x20000, "han"), (0x32000, ""),
]
_STARTS = np.array([start for start, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])

_WORD = re.compile(r"[^\W\d_]+")


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word of every n-gram of ``words``, in the order of words for each n."""
    text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    end = text == 10
    word = np.cumsum(end) - 1  # a separator counts to the word after it
    buckets, owners = [], []
    for n in ORDERS:
        size = len(text) - n + 1
        h = np.full(size, n, dtype=np.uint64)
        inner = np.ones(size, dtype=bool)
        for i in range(n):
            h = (h ^ text[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if n == 1 or 0 < i < n - 1:
                inner &= ~end[i : i + size]
        if n == 2:
            inner &= ~(end[:-1] & end[1:])
        first = word[:size] if n < 3 else word[1 : size + 1]
        buckets.append((h[inner] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(first[inner])
    return np.concatenate(buckets), np.concatenate(owners)


def _scripts(words: list[str]) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_STARTS, [ord(w[0]) for w in words], side="right") - 1]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # most frequent first
    log_p: np.ndarray  # buckets x languages
    written: np.ndarray  # scripts x languages: whether the language uses the script

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log scores of each word for each language; all 0 if no language uses its script."""
        n = len(self.languages)
        out = np.zeros((len(words), n))
        if words:
            buckets, owners = _grams(words)
            for k in range(n):
                out[:, k] = np.bincount(owners, self.log_p[buckets, k], len(words))
            can = self.written[_scripts(words)]
            out[~can] = -1e4
            out[~can.any(axis=1)] = 0.0
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every row of ``scores``; sequences lie one after another and are solved side by side."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    begin, length = starts[order], lengths[order]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences longer than t
    own = np.arange(scores.shape[1], dtype=np.int16)
    back = np.zeros(scores.shape, dtype=np.int16)
    value = np.zeros((len(length), scores.shape[1]))
    for t in range(steps):
        a = alive[t]
        rows, v = begin[:a] + t, value[:a]
        if t:
            best = v.argmax(axis=1)
            jump = v[np.arange(a), best][:, None] - penalty
            stay = v >= jump
            back[rows] = np.where(stay, own, best[:, None].astype(np.int16))
            v = np.where(stay, v, jump)
        value[:a] = v + scores[rows]
    labels = np.zeros(len(scores), dtype=np.int16)
    now = value.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        a = alive[t]
        rows = begin[:a] + t
        labels[rows] = now[:a]
        if t:
            now[:a] = back[rows, now[:a]]
    return labels


def train(
    rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> Model:
    """Count n-grams and scripts of a bounded sample; rows without language or text do not count."""
    rows = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = tuple(sorted(found, key=lambda k: (-found[k], k)))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros((len(_NAMES), 0), dtype=bool))
    limit = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / found[k]))))
    place = F.pmod(F.xxhash64(F.lit(4), F.col(id_col)), F.lit(1 << 30)) / (1 << 30)
    taken = rows.filter(place < limit[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for lo in range(0, len(texts), 200):
                    words = [w for t in texts.iloc[lo : lo + 200] for w in _WORD.findall(t.lower())]
                    if not words:
                        continue
                    grams = np.bincount(_grams(words)[0], minlength=BUCKETS)
                    letters = np.bincount(_scripts(words), [len(w) for w in words], len(_NAMES))
                    both = np.concatenate([grams, letters])
                    at = np.flatnonzero(both)
                    yield pd.DataFrame({"lang": lang, "at": at, "n": both[at].astype(np.int64)})

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        both = np.zeros(BUCKETS + len(_NAMES))
        both[part["at"]] = part["n"]
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "counts": [both.tobytes()]})

    summed = taken.mapInPandas(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    counts = {r["lang"]: np.frombuffer(r["counts"]) for r in summed.groupBy("lang").applyInPandas(gather, "lang string, counts binary").collect()}
    languages = tuple(k for k in languages if k in counts)
    table = np.array([counts[k] for k in languages]).reshape(len(languages), -1).T
    grams, letters = table[:BUCKETS] + 0.5, table[BUCKETS:]
    return Model(
        languages,
        np.log(grams / grams.sum(axis=0, keepdims=True)),
        letters >= 0.005 * np.maximum(letters.sum(axis=0, keepdims=True), 1),
    )


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > SLICE_CHARS:
            yield lo, i
            lo = i
            size = 0
        size += len(text or "")
    if lo < len(texts):
        yield lo, len(texts)


def label_texts(model: Model, texts: list[str | None], penalty: float, spans: bool) -> tuple[list, list, list]:
    """Language, score and spans (start, end, language; only on demand) of each text."""
    preds, scores, found = [], [], []
    n = len(model.languages)
    for lo, hi in _slices(texts):
        words, lengths, places = [], [], []
        for text in texts[lo:hi]:
            if spans:
                own = list(_WORD.finditer(text or ""))
                places.extend(m.span() for m in own)
                own = [m[0] for m in own]
            else:
                own = _WORD.findall(text or "")
            words.extend(own)
            lengths.append(len(own))
        codes, unique = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), np.array([]))
        alpha = np.array([w.isalpha() or any(c.isalpha() for c in w) for w in unique], dtype=bool)
        letters = np.where(alpha, [len(w) for w in unique], 0)[codes] if words else np.zeros(0)
        lengths = np.array(lengths, dtype=np.int64)
        table = model.word_scores([w.lower() for w in unique])
        labels = viterbi(table[codes], lengths, penalty) if n else np.zeros(len(words), np.int16)
        doc = np.repeat(np.arange(hi - lo), lengths)
        held = np.bincount(doc * max(n, 1) + labels, letters, (hi - lo) * max(n, 1)).reshape(hi - lo, -1)
        known = (table != 0).any(axis=1)[codes] if n and words else np.zeros(len(words), dtype=bool)
        sure = np.bincount(doc, letters * known, hi - lo)
        total = held.sum(axis=1)
        best = held.argmax(axis=1)
        at = 0
        for d in range(hi - lo):
            if not total[d] or not n:
                preds.append(UNKNOWN)
                scores.append(0.0)
            else:
                preds.append(model.languages[best[d]])
                scores.append(float(held[d, best[d]] / total[d]) if sure[d] else 0.0)
            end = at + int(lengths[d])
            if spans:
                runs: list[list] = []
                for (a, b), k in zip(places[at:end], labels[at:end].tolist(), strict=True):
                    lang = model.languages[k] if n else UNKNOWN
                    if runs and runs[-1][2] == lang:
                        runs[-1][1] = b
                    else:
                        runs.append([a, b, lang])
                found.append([{"start": a, "end": b, "lang": k} for a, b, k in runs])
            at = end
    return preds, scores, found


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, lang_score and, if wanted, lang_spans; columns of these names are replaced.

    A text that is null or holds no letter gives ``und`` with score 0. A text in scripts that no
    learned language uses gives the most frequent language with score 0. Equal totals go to the
    more frequent language. Repeated rows get equal answers; an empty table stays empty.
    """
    docs = docs.drop(*(c for c in OUTPUT if c != text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = docs.columns.index(text_col)

    @releasing
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, found = label_texts(shared.value, batch.column(width).to_pylist(), penalty, spans)
            columns = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                columns.append(pa.array(found, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *OUTPUT[: 2 + spans]])

    kinds = ("string", "double", "array<struct<start:int,end:int,lang:string>>")
    added = [F.lit(None).cast(kind).alias(name) for name, kind in zip(OUTPUT, kinds, strict=True)]
    return docs.mapInArrow(predict, docs.select("*", *added[: 2 + spans]).schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` without the rows whose text has no language (null, or no letter); columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = docs.columns.index(text_col)

    @releasing
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label_texts(shared.value, batch.column(width).to_pylist(), penalty, spans=False)[0]
            yield batch.filter(pa.array([lang != UNKNOWN for lang in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The registered fold: crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
