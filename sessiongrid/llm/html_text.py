"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in order: runs of text not broken by a block-level tag. Each
block has features of its ancestors (tags and themes of their class and id names) and of its
text (length, links, punctuation, place). Two labels, content and the rest, are scored by
these and by the label before; Viterbi picks the best labelling of the whole page, and the
content blocks are joined by line breaks. Elements that are never shown as text (head, script,
style, templates, comments) make no blocks. A head ends at the first tag or text that cannot
stand in it, whether or not its own tags are written; quotes in a tag count only after "=".

The model is trained on seeded labelled layouts (``page_layouts``), bounded by ``PAGES``, by
gradient ascent on the conditional likelihood with exact forward-backward sums.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessiongrid.llm.page_layouts import labelled_page

PAGES = 400
ROUNDS = 90

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*)>?|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")

# Fixed lists of HTML's element names by what they do to text.
HIDDEN = {"script", "style", "template", "iframe", "svg", "head", "title", "textarea", "select", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "iframe"}
_RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}  # what may stand in a head
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
    "embed", "source", "track", "link", "meta", "nobr", "object", "param",
    "math", "annotation", "annotation-xml", "menclose", "merror", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom",
    "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder",
    "munderover", "semantics",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Fixed lists of word stems in class and id names, by theme.
THEMES = {
    "menu": ["nav", "menu", "breadcrumb", "pager", "pagination", "toc", "skip", "tabs"],
    "head": ["header", "masthead", "topbar", "logo", "site", "branding", "toolbar"],
    "foot": ["footer", "copyright", "legal", "imprint", "colophon", "disclaimer"],
    "side": ["sidebar", "aside", "widget", "related", "recommend", "trending", "popular", "more", "rail", "tags", "teaser"],
    "advert": ["ad", "ads", "advert", "adsense", "adsby", "sponsor", "promo", "banner", "commercial", "affiliate"],
    "notice": ["cookie", "consent", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "alert", "gdpr", "paywall", "signup", "message"],
    "form": ["form", "login", "search", "register", "input", "contact"],
    "reader": ["comment", "comments", "commentlist", "disqus", "discussion", "reply", "replies", "respond", "reviews", "feedback"],
    "share": ["share", "sharing", "social", "follow", "tools", "print"],
    "main": ["article", "content", "post", "entry", "story", "main", "body", "text", "page"],
}
_THEME_OF = {word: theme for theme, words in THEMES.items() for word in words}


@lru_cache(maxsize=20_000)
def _themes(attributes: str) -> frozenset[str]:
    found = set()
    for m in _NAMES.finditer(attributes):
        for word in _PART.findall((m[1] or m[2] or m[3] or "").lower()):
            theme = _THEME_OF.get(word) or next((t for w, t in _THEME_OF.items() if len(w) > 3 and word.startswith(w)), None)
            if theme:
                found.add(theme)
    if found - {"main"}:
        found.discard("main")  # "comment-content" is about comments
    return frozenset(found)


@dataclass
class Block:
    path: tuple[tuple[str, frozenset[str]], ...]  # (tag, themes) of the ancestors, outermost first
    text: str
    linked: int = 0  # characters inside links
    features: list[str] = field(default_factory=list)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, white space made single and references decoded."""
    stack: list[tuple[str, frozenset[str]]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = hidden = links = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            out.append(Block(tuple(x for x in stack if x[0] not in INLINE or x[1]), text, linked))
        linked = 0

    def pop(n: int) -> None:
        nonlocal hidden, links
        for tag, _ in stack[n:]:
            hidden -= tag in HIDDEN
            links -= tag == "a"
        del stack[n:]

    def end_head() -> None:
        n = next((i for i, x in enumerate(stack) if x[0] == "head"), None)
        if n is not None and not {"noscript", "template"} & {t for t, _ in stack[n + 1 :]}:
            pop(n)

    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            shown = not (len(token) > 1 and token[0] == "<")
            if hidden and shown and stack[-1][0] == "head" and not token.isspace():
                end_head()
            if not hidden and shown:
                parts.append(token)
                if links:
                    linked += len(token)
            continue
        tag = tag.lower()
        if m[1]:
            n = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if n is not None:
                # An inline element ends inside its block only.
                if tag in INLINE and any(t not in INLINE for t, _ in stack[n + 1 :]):
                    continue
                if tag not in INLINE:
                    flush()
                pop(n)
            elif tag not in INLINE:
                flush()
            continue
        if hidden and tag not in HEAD:
            end_head()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            ends = CLOSES.get(tag)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (ends and stack[i][0] in ends):
                    pop(i)
                    break
                if stack[i][0] not in INLINE and not (ends and stack[i][0] == "p"):
                    break
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "body":
            pop(0)  # an unclosed head ends here
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        stack.append((tag, _themes(m[3]) if m[3] else frozenset()))
        hidden += tag in HIDDEN
        links += tag == "a"
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path_features(path: tuple[tuple[str, frozenset[str]], ...]) -> tuple[str, ...]:
    tags = [t for t, _ in path]
    found = {f"in={t}" for t in tags if t not in ("html", "body", "div", "span")} | {f"parent={tags[-1] if tags else ''}"}
    themes = {theme for _, own in path for theme in own}
    found |= {f"theme={t}" for t in themes}
    bad = (themes - {"main"}) or {"nav", "header", "footer", "aside", "form", "button"} & set(tags)
    found.add("boxed" if bad else "free")
    if ("article" in tags or "main" in tags or "main" in themes) and not bad:
        found.add("marked")
    return tuple(sorted(found))


def _text_features(block: Block, i: int, n: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / max(len(text), 1)
    return [
        f"words={min(words.bit_length(), 7)}",
        f"links={0 if share < 0.05 else 1 if share < 0.5 else 2}",
        f"stops={min(text.count('.') + text.count('!') + text.count('?'), 3)}",
        f"ends={text[-1] in '.!?:…\"”'}",
        f"rights={'©' in text or 'copyright' in text[:40].lower()}",
        f"place={0 if i == 0 else 2 if i == n - 1 else 1}",
    ]


def features(page: list[Block]) -> list[list[str]]:
    n = len(page)
    rows = []
    for i, block in enumerate(page):
        own = [*_path_features(block.path), *_text_features(block, i, n), "bias"]
        if i and page[i - 1].path[:-1] == block.path[:-1]:
            own.append("same box")
        rows.append(own)
    return rows


@dataclass(frozen=True)
class Field:
    """Weights of a trained chain: label 1 is content."""

    weights: dict[str, tuple[float, float]]
    moves: tuple[tuple[float, float], tuple[float, float]]  # [before][now]

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi; equal scores go to content."""
        back: list[tuple[int, int]] = []
        get, none = self.weights.get, (0.0, 0.0)
        (m00, m01), (m10, m11) = self.moves
        v0 = v1 = 0.0
        for i, row in enumerate(features(page)):
            s0 = s1 = 0.0
            for name in row:
                a, b = get(name, none)
                s0 += a
                s1 += b
            if i:
                from0, from1 = v0 + m00 > v1 + m10, v0 + m01 > v1 + m11
                back.append((0 if from0 else 1, 0 if from1 else 1))
                s0 += v0 + m00 if from0 else v1 + m10
                s1 += v0 + m01 if from1 else v1 + m11
            v0, v1 = s0, s1
        label = int(v1 >= v0)
        labels = [label] if page else []
        for before in reversed(back):
            label = before[label]
            labels.append(label)
        return [bool(x) for x in reversed(labels)]


def _examples(pages: int) -> Iterator[tuple[list[Block], list[int]]]:
    for seed in range(pages):
        texts, markup = [], []
        for piece, content in labelled_page(seed):
            markup.append(piece)
            texts += [content] * len(blocks(piece))
        page = blocks("".join(markup))
        if len(page) == len(texts) and page:
            yield page, [int(x) for x in texts]


@lru_cache(maxsize=1)
def train(pages: int = PAGES, rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximise the conditional likelihood of the labelled layouts."""
    data = list(_examples(pages))
    rows = [features(page) for page, _ in data]
    names = sorted({f for page in rows for row in page for f in row})
    index = {f: i for i, f in enumerate(names)}
    longest, n = max(map(len, rows)), len(rows)
    x = np.zeros((n, longest, len(names)), dtype=np.float32)
    real, gold = np.zeros((n, longest), dtype=bool), np.zeros((n, longest), dtype=np.int64)
    for p, (page, (_, labels)) in enumerate(zip(rows, data, strict=True)):
        for t, row in enumerate(page):
            x[p, t, [index[f] for f in row]] = 1
        real[p, : len(page)], gold[p, : len(page)] = True, labels
    x = x.reshape(n * longest, -1)
    truth = np.eye(2)[gold] * real[:, :, None]
    pairs = real[:, 1:]
    moved = np.einsum("pta,ptb->ab", truth[:, :-1] * pairs[:, :, None], truth[:, 1:])
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    mean, square = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        score = (x @ w.astype(np.float32)).astype(np.float64).reshape(n, longest, 2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            step_in = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], step_in, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step_out = np.logaddexp.reduce(moves[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], step_out, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        alone = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        both = np.exp(ahead[:, :-1, :, None] + moves + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
        both *= pairs[:, :, None, None]
        slopes = [
            x.T @ (truth - alone).reshape(n * longest, 2) / n - decay * w,
            (moved - both.sum(axis=(0, 1))) / n - decay * moves,
        ]
        for k, (value, slope) in enumerate(zip((w, moves), slopes, strict=True)):
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.999 * square[k] + 0.001 * slope**2
            value += rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        rate *= 0.98
    return Field({f: (float(a), float(b)) for f, (a, b) in zip(names, w, strict=True)}, tuple(map(tuple, moves.tolist())))


def main_text(model: Field, page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep)


def extract_text(pages: DataFrame, html_col: str = "html", output: str = "text", model: Field | None = None) -> DataFrame:
    """``pages`` without ``html_col`` and with ``output``: the main text, empty if there is none.

    A null page is empty. Whole pages are read, nothing is cut off, repeated rows get equal
    texts and an empty table stays empty. A column already named ``output`` is replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    rest = [c for c in pages.columns if c not in (html_col, output)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(shared.value, page) for page in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], names=[*rest, output])

    chosen = pages.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{html_col}`").alias("_html"))
    schema = chosen.select(*(F.col(f"`{c}`") for c in rest), F.lit("").alias(output)).schema
    return chosen.mapInArrow(run, schema)
