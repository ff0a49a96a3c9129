"""Labelled training pages: seeded layouts in which every text is known to be content or not.

Pages differ in tags, class names, order and presence of their parts, so a model has to weigh
ancestors, neighbours and text together. The text is invented.
"""

from __future__ import annotations

import random

# Fixed lists of names that web pages give to their parts.
CONTENT_BOXES = [
    ("article", ""), ("article", "post"), ("main", ""), ("div", "article-body"), ("div", "content"), ("div", "entry-content"),
    ("div", "post-content"), ("section", "story"), ("div", "main-text"), ("div", "page-body"), ("div", ""), ("section", ""),
]
PARTS = {
    "nav": [("nav", ""), ("ul", "menu"), ("div", "navbar"), ("div", "breadcrumb"), ("div", "topnav"), ("div", "pagination")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site-title")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("aside", "widget"), ("div", "related"), ("section", "recommended"), ("div", "tags")],
    "ad": [("div", "ad"), ("div", "ads"), ("aside", "advert"), ("div", "sponsored"), ("div", "promo"), ("div", "banner"), ("ins", "adsbygoogle")],
    "notice": [("div", "cookie-notice"), ("div", "notice"), ("div", "popup"), ("div", "newsletter"), ("section", "consent"), ("div", "alert"), ("div", "subscribe")],
    "form": [("form", ""), ("form", "search"), ("div", "login"), ("form", "newsletter")],
    "comments": [("section", "comments"), ("div", "comments"), ("ol", "commentlist"), ("div", "discussion"), ("div", "disqus"), ("section", "replies")],
    "share": [("div", "share"), ("ul", "social"), ("div", "byline-tools")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "copyright"), ("div", "legal")],
}


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def _sentence(rng: random.Random, lo: int, hi: int) -> str:
    return _words(rng, rng.randint(lo, hi)).capitalize() + rng.choice(".....!?")


def _paragraph(rng: random.Random) -> str:
    if rng.random() < 0.2:
        return _sentence(rng, 1, 3)
    return " ".join(_sentence(rng, 4, 20) for _ in range(rng.randint(1, 6)))


def _open(tag: str, name: str, rng: random.Random) -> str:
    if not name:
        return f"<{tag}>"
    return f"<{tag} {rng.choice(['class', 'id'])}={rng.choice(['"', ''])}{name}>".replace(f'="{name}>', f'="{name}">')


def labelled_page(seed: int) -> list[tuple[str, bool]]:
    """Pieces of markup in order; the flag says that the texts in the piece are content."""
    rng = random.Random(seed)
    links = lambda n: "".join(f"<li><a href=/x>{_words(rng, rng.randint(1, 4))}</a></li>" for _ in range(n))

    def part(kind: str) -> str:
        tag, name = rng.choice(PARTS[kind])
        if kind in ("nav", "share"):
            inner = f"<ul>{links(rng.randint(2, 8))}</ul>" if tag != "ul" else links(rng.randint(2, 8))
        elif kind == "sidebar":
            inner = f"<h3>{_words(rng, 2)}</h3>" + rng.choice([f"<ul>{links(5)}</ul>", f"<p>{_paragraph(rng)}</p>"])
        elif kind == "form":
            inner = f"<label>{_words(rng, 2)}</label><input name=q><button>{_words(rng, 1)}</button>"
        elif kind == "comments":
            item = ("article", "comment") if rng.random() < 0.3 else ("li", "") if tag == "ol" else ("div", "comment")
            inner = f"<h2>{_words(rng, 2)}</h2>" * (rng.random() < 0.6) + "".join(
                f"{_open(*item, rng)}<p>{_words(rng, 2)}</p><p>{_paragraph(rng)}</p></{item[0]}>" for _ in range(rng.randint(1, 6))
            )
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "", "Copyright "]) + f"{_words(rng, 2)} &middot; {_sentence(rng, 2, 9)}"
        elif kind == "header":
            inner = rng.choice([f"<h1>{_words(rng, 2)}</h1>", f"<a href=/>{_words(rng, 2)}</a>", f"<p>{_sentence(rng, 2, 6)}</p>"])
        else:
            inner = rng.choice([_sentence(rng, 3, 15), f"<p>{_paragraph(rng)}</p>", f"<a href=/y>{_words(rng, 4)}</a>"])
        return f"{_open(tag, name, rng)}{inner}</{tag}>"

    before = [(part(k), False) for k in ("notice", "header", "nav", "ad", "form", "sidebar", "ad") if rng.random() < 0.5]
    after = [(part(k), False) for k in ("share", "ad", "sidebar", "comments", "form", "notice", "nav", "footer", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    if rng.random() < 0.3:
        rng.shuffle(after)
    tag, name = rng.choice(CONTENT_BOXES)
    body: list[tuple[str, bool]] = [(f"<h1>{_words(rng, rng.randint(2, 9))}</h1>", True)] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 20)):
        kind = rng.random()
        if kind < 0.75:
            body.append((f"<p>{_paragraph(rng)}" + "</p>" * (rng.random() < 0.8), True))
        elif kind < 0.82:
            body.append((f"<h2>{_words(rng, 3)}</h2>", True))
        elif kind < 0.88:
            body.append(("<ul>" + "".join(f"<li>{_sentence(rng, 2, 9)}</li>" for _ in range(3)) + "</ul>", True))
        elif kind < 0.92:
            body.append((f"<blockquote><p>{_paragraph(rng)}</p></blockquote>", True))
        elif kind < 0.95:
            body.append((f"<p>{_sentence(rng, 3, 8)} <a href=/z>{_words(rng, 3)}</a> {_sentence(rng, 3, 8)}</p>", True))
        else:
            body.append((part(rng.choice(["ad", "share", "sidebar", "form", "notice"])), False))
    if rng.random() < 0.15:
        body.append((part("comments"), False))
    wrap = rng.choice(["", "", "<div class=wrapper>", "<div id=page>", "<main>"])
    end = {"": "", "<main>": "</main>"}.get(wrap, "</div>")
    return [("<body>" + wrap, False), *before, (_open(tag, name, rng), False), *body, (f"</{tag}>", False), *after, (end + "</body>", False)]
