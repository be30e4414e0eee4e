"""Main text of web pages: boosted trees over DOM nodes, decoded from the root downwards."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.trees import BoostedTrees

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template svg iframe head title annotation annotation-xml canvas audio video select textarea button".split())
#: What can stand in the head; any other start tag, or text, ends it.
HEAD = frozenset("html head title base link meta style script noscript template".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag of the key ends an open element of these names, if no element of the scope stands between.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body html div section article main td th".split())
GROUPS = (
    ("article", "main"), ("section", "div"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"),
    ("table", "tbody", "thead", "tr", "td", "th"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "legend"), ("figure", "figcaption"), ("dialog", "details"),
)
_GROUP_ROW = {t: tuple(t in g for g in GROUPS) for group in GROUPS for t in group}
_NO_GROUP = (False,) * len(GROUPS)
#: Words in class, id, role and similar attributes, by what they speak for.
TOKENS = (
    frozenset("article content main body post entry story text maincontent articlebody prose".split()),
    frozenset("nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip".split()),
    frozenset("header masthead topbar banner logo branding site".split()),
    frozenset("footer foot bottom copyright legal colophon".split()),
    frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion promoted adsense".split()),
    frozenset("sidebar side aside widget related recommended rail more teaser trending popular".split()),
    frozenset("comment comments commentlist reply replies discussion disqus respond thread".split()),
    frozenset("cookie cookies consent notice alert popup modal overlay newsletter subscribe signup toast gdpr warning complementary contentinfo".split()),
    frozenset("share social sharing follow login search form contact tags meta byline author".split()),
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Page(HTMLParser):
    """A page as arrays: block elements with parents, and text blocks with the block element they stand in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.depths, self.tokens, self.hidden = ["html"], [-1], [0], [[0] * len(TOKENS)], [False]
        self.n_inner, self.link_chars = [0], [0]
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.silent = self.links = 0
        self.texts: list[tuple[int, str]] = []
        self.pending: list[str] = []
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self) -> None:
        if self.pending:
            if text := " ".join("".join(self.pending).split()):
                self.texts.append((self.open[-1][1], text))
            self.pending = []

    def _pop(self) -> None:
        tag, _ = self.open[-1]
        if tag in BLOCKS:
            self._flush()
        self.open.pop()
        self.silent -= tag in SILENT
        self.links -= tag == "a"

    def _end_inside(self, names: tuple[str, ...], scope: frozenset) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in names:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent and tag not in HEAD:  # the head's end tag may be left out
            self._end_inside(("head",), SILENT - {"head"})
        if tag in BLOCKS:
            self._flush()
            if tag == "html":
                return
            self._end_inside(("p",), BLOCKS - {"p"})
            if tag in _CLOSES:
                self._end_inside(_CLOSES[tag], _SCOPE - set(_CLOSES[tag]))
        elif tag == "a":
            self._end_inside(("a",), BLOCKS)
        if tag in VOID:
            if tag in ("br", "hr") and not self.silent:
                self.pending.append(" ")
            return
        owner = self.open[-1][1]
        self.n_inner[owner] += 1
        if tag in BLOCKS:
            words: list[str] = []
            hidden = False
            for name, value in attrs:
                if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
                    words += _SPLIT.split(_CAMEL.sub(r"\1 \2", value or "").lower())
                hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in (value or "").replace(" ", ""))
            self.tags.append(tag)
            self.parents.append(owner)
            self.depths.append(self.depths[owner] + 1)
            self.tokens.append([sum(w in lexicon for w in words) for lexicon in TOKENS] if words else [0] * len(TOKENS))
            self.hidden.append(hidden or self.hidden[owner])
            self.n_inner.append(0)
            self.link_chars.append(0)
            owner = len(self.tags) - 1
        self.open.append((tag, owner))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT or tag == "a":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag == "html":
            return
        if any(t == tag for t, _ in self.open[1:]):
            while True:
                t = self.open[-1][0]
                self._pop()
                if t == tag:
                    return
        elif tag == "p":
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.silent and self.open[-1][0] in ("head", "noscript") and data.strip():
            self._end_inside(("head",), SILENT - {"head"})
        if not self.silent:
            self.pending.append(data)
            if self.links:
                self.link_chars[self.open[-1][1]] += len(data)


def features(page: Page) -> np.ndarray:
    """A row for each block element: its name, attribute words of it and of those around it, density of its subtree, depth, place among siblings."""
    n = len(page.tags)
    parents = page.parents
    sums = np.zeros((n, 6))
    for owner, text in page.texts:
        sums[owner, :4] += (len(text), text.count(" ") + 1, text.count(".") + text.count(",") + text.count(";"), 1)
    sums[:, 4] = page.link_chars
    sums[:, 5] = np.array(page.n_inner) + 1
    own = sums[:, 0].copy()
    names = np.column_stack([np.array([_GROUP_ROW.get(t, _NO_GROUP) for t in page.tags], float), np.array(page.tokens, float)])
    around = names.copy()
    siblings, index, before, same = np.zeros((4, n))
    last: dict[int, int] = {}
    number = [0] * n
    for v in range(n - 1, 0, -1):  # children follow their parents
        sums[parents[v]] += sums[v]
    chars, words, marks, blocks, links, tags = sums.T
    for v in range(1, n):
        p = parents[v]
        around[v] += around[p]
        index[v] = number[p]
        number[p] += 1
        if p in last:
            before[v] = chars[last[p]]
            same[v] = page.tags[last[p]] == page.tags[v]
        last[p] = v
    siblings[:] = number
    parent = np.array(parents)
    depth = np.array(page.depths, float)
    up = np.maximum(parent, 0)
    figures = [
        np.log1p(chars), np.log1p(own), np.log1p(words), chars / tags, links / (chars + 1), marks / (words + 1), words / (blocks + 1), blocks, depth, chars / (chars[up] + 1), chars / (chars[0] + 1),
        np.where(parent >= 0, siblings[up], 1), index, np.log1p(before), same, np.array(page.hidden, float), np.arange(n) / n,
    ]
    return np.column_stack([*figures, names, around])


def decoded(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """The likeliest choice of kept elements in which what stands inside a dropped element is dropped too."""
    kept, gone = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    kept[0], parent = 0.0, page.parents
    best, all_gone = kept.copy(), gone.copy()
    for v in range(len(best) - 1, 0, -1):
        best[parent[v]] += max(best[v], all_gone[v])
        all_gone[parent[v]] += all_gone[v]
    out = np.ones(len(best), bool)
    for v in range(1, len(best)):
        out[v] = out[parent[v]] and best[v] >= all_gone[v]
    return out


# --- The training pages: made here, with known main text. ---

_MAIN = "\ue000"


def _made_page(rng: random.Random) -> str:
    """A page whose main text blocks begin with a private-use character."""
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(1, 9)))

    def prose(low: int, high: int) -> str:
        out = " ".join(word() + rng.choice(["", "", "", "", ",", "."]) for _ in range(rng.randint(low, high)))
        return out[:1].upper() + out[1:] + rng.choice([".", ".", ""])

    def links(low: int, high: int) -> str:
        items = [f'<li><a href="/{word()}">{prose(1, 3)}</a></li>' for _ in range(rng.randint(low, high))]
        return f"<ul>{''.join(items)}</ul>" if rng.random() < 0.7 else " ".join(items).replace("<li>", "").replace("</li>", " | ")

    def attr(*names: str) -> str:
        style = rng.random()
        return "" if style < 0.15 else f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if style < 0.8 else f' class="{word()} {rng.choice(names)}-{word()}"'

    def boiler() -> str:
        kind = rng.randrange(10)
        text = f"<p>{prose(2, 40)}</p>" if rng.random() < 0.5 else prose(2, 40)
        if kind == 0:
            return f'<{(t := rng.choice(["nav", "nav", "div"]))}{attr("nav", "menu", "breadcrumb", "pagination") if t == "nav" else " class=menu"}>{links(2, 9)}</{t}>'
        if kind == 1:
            return f'<{(t := rng.choice(["header", "div"]))}{attr("header", "masthead", "banner") if t == "header" else " id=header"}>{rng.choice(["<h1>", "<h2>", "<p>"])}{prose(1, 5)} {links(0, 4)}</{t}>'
        if kind == 2:
            return f'<{(t := rng.choice(["footer", "footer", "div"]))}{attr("footer", "site-footer") if t == "footer" else " class=footer"}>&copy; {text} {links(0, 6)}</{t}>'
        if kind == 3:
            return f'<{(t := rng.choice(["aside", "div"]))}{attr("sidebar", "widget", "related") if t == "aside" else " class=sidebar"}><h3>{prose(1, 4)}</h3>{text}{links(0, 7)}</{t}>'
        if kind == 4:
            return f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement"])}">{text}</div>'
        if kind == 5:
            return f'<{(t := rng.choice(["div", "section", "dialog"]))} {rng.choice(["class", "id"])}="{rng.choice(["cookie-notice", "consent", "notice", "newsletter", "alert", "popup", "cookie-banner"])}">{text}<button>{word()}</button></{t}>'
        if kind == 6:
            return f'<form{attr("search", "login", "subscribe")}><label>{prose(1, 4)}</label><input name=q><p>{prose(1, 12)}</p><button>{word()}</button></form>'
        if kind == 7:
            posts = "".join(f'<{(t := rng.choice(["div", "li", "article"]))} class="{rng.choice(["comment", "reply", "comment-body"])}"><p>{prose(1, 3)}</p><p>{prose(4, 60)}</p></{t}>' for _ in range(rng.randint(1, 5)))
            return f'<{(t := rng.choice(["section", "div", "ol"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "respond"])}"><h3>{prose(1, 3)}</h3>{posts}</{t}>'
        if kind == 8:
            return f'<div class="{rng.choice(["share", "social", "tags", "share-buttons"])}">{links(1, 5)}</div>'
        return f"<script>var x = '<p>{word()}</p>';</script>"

    def main_block() -> str:
        kind = rng.randrange(14)
        if kind == 0:
            return f"<h2>{_MAIN}{prose(1, 8)}</h2>"
        if kind == 1:
            return f"<ul>{''.join(f'<li>{_MAIN}{prose(1, 20)}</li>' for _ in range(rng.randint(1, 6)))}</ul>"
        if kind == 2:
            return f"<blockquote>{_MAIN}{prose(5, 40)}</blockquote>"
        if kind == 3:
            rows = "".join(f"<tr>{''.join(f'<td>{_MAIN}{prose(1, 4)}</td>' for _ in range(3))}</tr>" for _ in range(rng.randint(1, 4)))
            return f"<table>{rows}</table>"
        if kind == 4:
            return f"<figure><img src=x><figcaption>{_MAIN}{prose(2, 12)}</figcaption></figure>"
        if kind == 5:
            return f'<p>{_MAIN}{prose(2, 30)} <a href="/x">{prose(1, 6)}</a> {prose(1, 30)}</p>'
        if kind == 6:
            return f"<p><b>{_MAIN}{prose(1, 40)}<br>"
        if kind == 7:
            return f"<pre>{_MAIN}{prose(3, 30)}</pre>"
        return f"<p>{_MAIN}{prose(1, 120)}</p>"

    title = f"<h1>{_MAIN}{prose(1, 9)}</h1>" if rng.random() < 0.85 else ""
    if title and rng.random() < 0.15:
        title = f"<header>{title}</header>"
    body = title + "".join(main_block() + (boiler() if rng.random() < 0.06 else "") for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 10, 16])))
    if rng.random() < 0.1:
        body = f"<p>{_MAIN}{prose(1, 6)}</p>"
    style = rng.random()
    if style < 0.5:
        body = f"<article{attr('post', 'article', 'entry', 'story')}>{body}{boiler() if rng.random() < 0.1 else ''}</article>"
    elif style < 0.65:
        body = f"<main>{body}</main>" if rng.random() < 0.5 else f"<main><article>{body}</article></main>"
    elif style < 0.9:
        body = f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "main", "post-body", "entry-content", "article-text", "main-content", "story"])}">{body}</div>'
    else:
        body = f"<div>{body}</div>"
    before, after = "".join(boiler() for _ in range(rng.randint(0, 4))), "".join(boiler() for _ in range(rng.randint(0, 4)))
    inner = f"{before}{body}{after}"
    if rng.random() < 0.3:
        inner = f'{boiler()}<div class="{rng.choice(["container", "wrapper", "page", word()])}">{inner}</div>{boiler()}'
    return f"<!DOCTYPE html><html><head><title>{prose(1, 5)}</title><style>p{{}}</style></head><body>{inner}" + ("</body></html>" if rng.random() < 0.9 else "")


def labelled(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Elements with text in them, and whether some of it is main text."""
    main, some = np.zeros(len(page.tags), bool), np.zeros(len(page.tags), bool)
    for owner, text in page.texts:
        v = owner
        while v >= 0:
            some[v] = True
            main[v] |= text.startswith(_MAIN)
            v = page.parents[v]
    return some, main


@lru_cache(maxsize=2)
def trained(n_pages: int = 600, seed: int = 3) -> BoostedTrees:
    """The node classifier, fitted to ``n_pages`` made pages."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(n_pages):
        page = Page(_made_page(rng))
        some, main = labelled(page)
        xs.append(features(page)[some])
        ys.append(main[some])
    return BoostedTrees(n_trees=50).fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def _extracted(model: BoostedTrees):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for cut in range(0, whole.num_rows, 256):
                batch = whole.slice(cut, 256)
                pages = [Page(h or "") for h in batch.column("html").to_pylist()]
                tables = [features(p) for p in pages]
                ends = np.cumsum([len(t) for t in tables])
                odds = np.split(model.log_odds(np.concatenate(tables)), ends[:-1])
                texts = []
                for page, own in zip(pages, odds, strict=True):
                    keep = decoded(page, own)
                    texts.append("\n\n".join(t for owner, t in page.texts if keep[owner] and not page.hidden[owner]))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page; blocks in page order, two \\n between them.

    Each block element of the page's tree is scored by boosted trees (fitted to pages made in this
    module; the number is a parameter of ``trained``). The elements to keep are then chosen together,
    as the likeliest set in which no element is kept inside a dropped one. Character references are
    decoded, white space in a block is one space, scripts, styles, templates, controls, embedded media and hidden
    elements are silent. The head ends at the first tag or text that can't stand in it, its end tag or not.

    A null or empty page, or one without main text, has the empty text and 0 characters. Rows that
    repeat come back each. An empty table gives an empty result; other columns are not looked at.
    """
    source = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return source.mapInArrow(_extracted(trained()), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
