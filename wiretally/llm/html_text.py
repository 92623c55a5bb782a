"""Main text of web pages by tag-path ratios.

Each piece of text has a root-to-leaf tag path (tags with their class and id, without markup inside lines). Over a page, a
path gathers its text length and punctuation; both are divided by the number of its text nodes, smoothed over neighbouring
nodes, fused (their product), and paths above a share of the page's spread are content. Paths below navigation, adverts,
notices, forms, comments and the like are never content; pieces of the article element that share a content path's parent
(a headline, a short paragraph) belong to it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wiretally.llm.common import batches

# Elements by their role in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub "
                   "sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noframes noembed".split())
NEVER = frozenset("nav header footer aside form menu button select option dialog fieldset figcaption head svg canvas object audio video dir "
                  "script style noscript template textarea title iframe".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
                     "section table ul".split())
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
BOILER = re.compile(r"(^|[\s_-])(ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|aside|footer\w*|header|masthead|"
                    r"cookie\w*|consent|notice\w*|gdpr|newsletter|subscribe|signup|login|comment\w*|disqus|repl(y|ies)|respond|share|sharing|social|"
                    r"related|recommend\w*|popup|modal|overlay|widget\w*|toolbar|pagination|pager|legal|copyright|skip\w*|search\w*)($|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.S)
MARKS = frozenset(".,;:!?…。，、；：！？¿¡")


class Block:
    __slots__ = ("path", "never", "inside", "parts")

    def __init__(self, path: tuple[str, ...], never: bool, inside: bool):
        self.path, self.never, self.inside, self.parts = path, never, inside, []


def blocks_of(page: str) -> list[Block]:
    """Runs of text between block-level tags, each with its path, in page order."""
    stack: list[tuple[str, str, bool]] = []  # (tag, name in the path, never content)
    found, current, at = [], None, 0

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            path = tuple(x[1] for x in stack if x[0] not in INLINE)
            current = Block(path, any(x[2] for x in stack), any(x[0] in ("article", "main") for x in stack))
            found.append(current)
        elif any(x[2] for x in stack) and not current.never:
            return  # inline boilerplate inside a block
        current.parts.append(piece)

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<(?=[a-zA-Z/!?])", rest)  # a tag that the page's end cuts off
            text(rest[:cut.start()] if cut else rest)
            break
        text(page[at:m.start()])
        at, tag = m.end(), (m.group(1) or "").lower()
        if not tag:
            continue
        if m.group(0)[1] == "/":
            if tag not in INLINE:
                current = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            current = None
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            if tag in ITEMS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ITEMS[tag]:
                        break
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
        if tag in VOID or m.group(2).rstrip().endswith("/") and tag not in CLOSES_P:
            continue
        values = {a.lower(): v.strip("\"'") for a, v in ATTRIBUTE.findall(m.group(2))} if m.group(2) else {}
        named = f"{values.get('class', '')} {values.get('id', '')}".strip()
        never = (tag in NEVER or (bool(named) and tag not in ("html", "body", "article", "main") and BOILER.search(named) is not None)
                 or values.get("role", "").lower() in ROLES or "hidden" in values or values.get("aria-hidden") == "true"
                 or "display:none" in values.get("style", "").replace(" ", "").lower())
        stack.append((tag, f"{tag}.{named}" if named else tag, never))
    return found


def main_text(page: str | None, share: float = 0.5) -> str:
    """The text of the blocks on content paths, blocks joined by one space. Empty where nothing is content."""
    blocks = [(b, " ".join(html.unescape("".join(b.parts)).split())) for b in blocks_of(page or "")]
    blocks = [(b, t) for b, t in blocks if t]
    usable = [(b, t) for b, t in blocks if not b.never]
    if not usable:
        return ""
    nodes: dict[tuple[str, ...], list[int]] = {}
    for k, (b, _) in enumerate(usable):
        nodes.setdefault(b.path, []).append(k)
    length, marks = np.zeros(len(usable)), np.zeros(len(usable))
    for at in nodes.values():
        length[at] = sum(len(usable[k][1]) for k in at) / len(at)
        marks[at] = sum(sum(map(usable[k][1].count, MARKS)) for k in at) / len(at)

    def smoothed(x: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(x, 1, mode="edge"), (0.25, 0.5, 0.25), "valid")

    fused = smoothed(length) * (1 + smoothed(marks))
    content = {usable[k][0].path for k in np.flatnonzero(fused >= share * fused.std())}
    holders = {p[:k] for p in content for k in range(len(p)) if p[k].split(".")[0] in ("article", "main")}
    homes = {p[:-1] for p in content}
    if any(b.inside for b, _ in usable):  # the page marks its article: what it holds, and nothing beside it
        chosen = [t for b, t in usable if b.inside and (b.path in content or b.path[:-1] in homes or any(b.path[:len(h)] == h for h in holders))]
    else:
        chosen = [t for b, t in usable if b.path in content or b.path[:-1] in homes]
    return " ".join(chosen)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row. A null or empty html gives an empty text; markup that is broken off or
    never closed is read as far as it goes; an empty table gives no rows; other columns are ignored."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 256):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
