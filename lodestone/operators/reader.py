"""HTML as markdown by a chain of readers: the region that a page marks, its densest block, the whole page."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.shipping import ship

# What marks a region as the page's content, widest first; what is left out within; the short-article length.
MARKERS = ("main", "[role=main]", "#main-content", ".main-content", "article")
CHROME = ("nav", "header", "footer")
SHORT_CHARS, MENU_SHARE = 200, 0.5

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template head svg".split())
BLOCKS = frozenset("address article aside blockquote dd div dl dt fieldset figcaption figure footer form header hr li main nav ol p pre section table ul body html".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
LINK = re.compile(r"\[[^\]]{0,2048}\]\([^)]{0,2048}\)")
DATA_URI = re.compile(r"""data:[^\s,)"'<>]*,[^\s)"'<>]*""")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []

    def walk(self):
        """This element and all below it, in page order; no recursion, pages may be deep."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


class Tree(HTMLParser):
    """A tree of the tags as they stand; an end tag closes to its start, one without a start is left out."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("document", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag)
        if shut and self.open[-1].name in shut:
            self.open.pop()
            if tag == "tr" and self.open[-1].name == "tr":
                self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def plain(node: Node) -> str:
    """The text of an element, white space collapsed."""
    parts, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            parts.append(at)
        elif at.name not in SILENT:
            stack.extend(reversed(at.children))
            if at.name in BLOCKS or at.name == "br":
                parts.append(" ")
    return squeezed("".join(parts))


def table_markdown(node: Node) -> str:
    """A pipe table; the header is the first row if all its cells are th, else empty; short rows are filled up."""
    rows = [[(c.name, plain(c).replace("|", r"\|")) for c in r.children if isinstance(c, Node) and c.name in ("td", "th")] for r in node.walk() if r.name == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    headed = all(name == "th" for name, _ in rows[0])
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join((cells + [""] * width)[:width]) + " |"
    body = [[text for _, text in r] for r in rows]
    return "\n".join([line(body.pop(0) if headed else []), line(["---"] * width), *map(line, body)])


def markdown(root: Node, links: bool = True, without: tuple[str, ...] = ()) -> str:
    """Blocks of markdown between blank lines. Without links, a link is its text; an image is its alternative text."""
    blocks: list[str] = []
    words: list[str] = []
    lead = ""

    def flush() -> None:
        nonlocal words
        text = squeezed("".join(words))
        if text:
            blocks.append(lead + text)
        words = []

    stack: list = [root]
    while stack:
        at = stack.pop()
        if callable(at):
            at()
        elif isinstance(at, str):
            words.append(at)
        elif at.name in SILENT or at.name in without:
            continue
        elif at.name == "table":
            flush()
            found = table_markdown(at)
            if found:
                blocks.append(found)
        elif at.name == "img":
            words.append(at.attributes.get("alt", ""))
        elif at.name == "br":
            words.append(" ")
        elif at.name == "a" and links and at.attributes.get("href"):
            words.append(f" [{plain(at)}]({at.attributes['href']}) ")
        elif re.fullmatch("h[1-6]", at.name) or at.name == "li" or at.name in BLOCKS:
            flush()
            before = lead

            def end(before=before):
                nonlocal lead
                flush()
                lead = before

            lead = "#" * int(at.name[1]) + " " if at.name[0] == "h" and at.name[1:].isdigit() else "- " if at.name == "li" else lead if at.name in ("p", "div") else ""
            stack.append(end)
            stack.extend(reversed(at.children))
        else:
            stack.extend(reversed(at.children))
    flush()
    return "\n\n".join(blocks)


def link_share(text: str) -> float:
    return sum(map(len, LINK.findall(text))) / len(text) if text else 0.0


def _marks(node: Node, marker: str) -> bool:
    if marker == "[role=main]":
        return node.attributes.get("role") == "main"
    if marker.startswith("#"):
        return node.attributes.get("id") == marker[1:]
    if marker.startswith("."):
        return marker[1:] in node.attributes.get("class", "").split()
    return node.name == marker


def marked_region(root: Node) -> tuple[str, str]:
    """The first marker's region that has text, and why not where there is none."""
    for marker in MARKERS:
        text = "\n\n".join(t for t in (markdown(n, links=False, without=CHROME) for n in outermost(root, marker)) if t)
        if text:
            return text, ""
    return "", "no marked region has text"


def outermost(root: Node, marker: str) -> list[Node]:
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if _marks(node, marker):
            found.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def densest_block(root: Node) -> tuple[str, str]:
    """The block whose own paragraphs hold the most text outside links; what is left of a page that marks nothing.

    A short one gives way to the whole page only if it is itself mostly links, or the whole page isn't.
    """
    best, most = None, 0
    for node in root.walk():
        if node.name in SILENT or node.name in CHROME:
            continue
        size = 0
        for child in node.children:
            if isinstance(child, Node) and child.name in ("p", "pre", "blockquote", "td", "dd", "li"):
                size += len(plain(child)) - sum(len(plain(a)) for a in child.walk() if a.name == "a")
        if size > most:
            best, most = node, size
    if best is None:
        return "", "no block of paragraphs"
    text = markdown(best, without=CHROME)
    if len(text) < SHORT_CHARS and (link_share(text) > MENU_SHARE or link_share(markdown(root)) <= MENU_SHARE):
        return "", f"only {len(text)} characters"
    return text, ""


def whole_page(root: Node) -> tuple[str, str]:
    text = markdown(root)
    return text, "" if text else "no text"


#: Kind of body -> its readers in order. Other kinds need readers that plug in here.
READERS: dict[str, list[tuple[str, Callable[[Node], tuple[str, str]]]]] = {"html": [("marked", marked_region), ("densest", densest_block), ("whole", whole_page)]}


def title_of(root: Node) -> str:
    named = next((n.attributes.get("content", "") for n in root.walk() if n.name == "meta" and n.attributes.get("property") == "og:title"), "")
    inner = next(("".join(c for c in n.children if isinstance(c, str)) for n in root.walk() if n.name == "title"), "")
    return squeezed(named) or squeezed(inner)


def with_title(text: str, title: str) -> str:
    """The text under its title, unless its first line is the title already."""
    first = next((line for line in text.splitlines() if line.strip()), "")
    return text if not title or first.lstrip("# ").strip().lower() == title.lower() else f"# {title}\n\n{text}"


def read_html(html: str | None) -> tuple[str, str, str, str, bool]:
    """text, title, tool, notes, fallback; the first reader with text wins, the reasons of earlier ones are notes."""
    root = Tree(html or "").root
    notes = []
    for i, (tool, reader) in enumerate(READERS["html"]):
        text, why = reader(root)
        text = DATA_URI.sub("", text).strip()
        if text:
            title = title_of(root)
            return with_title(text, title), title, tool, "; ".join(notes), i > 0
        notes.append(f"{tool}: {why}")
    return "", "", "", "; ".join(notes), False


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text, title, tool, notes, fallback of each page; a null or empty page has no text and says so in notes."""

    def read(batches):
        for batch in batches:
            rows = [(page, *read_html(html)) for page, html in zip(batch["page_id"], batch["html"])]
            yield pd.DataFrame(rows, columns=["page_id", "text", "title", "tool", "notes", "fallback"])

    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(read, "page_id long, text string, title string, tool string, notes string, fallback boolean")
