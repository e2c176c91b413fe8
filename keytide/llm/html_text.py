"""Main text of web pages by two passes of rules over their blocks.

A page is cut into blocks at block-level tags. The first pass labels a block by its link density,
its length and its density of stop words: long blocks with stop words are text, blocks of links are
not, short ones stay open. The second pass gives an open block the label of the nearest decided
block before or after it. Elements that can't hold an article (menus, footers, forms, scripts and
the like, by name, role or class) are left out before, and where a page marks its article or main
part, only blocks inside it take part.

Every page is judged by itself, so the work is one narrow pass over the table without a shuffle, in
time linear in a page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keytide.llm.common import in_batches, texts

#: Frequent words of the languages that pages are expected in; a parameter of ``extract``.
STOP_WORDS = frozenset(
    """the of and to a in is that for it was on with this as be at by are from or an not have he she they you we but his her which
    der die und den von zu das mit sich des auf für ist nicht im ein dem als eine auch es an werden aus er hat dass sie nach wird bei
    de la le et les des en un du que une est pour qui dans par sur au pas ou avec ne se plus ce il elle sont mais nous vous
    el y los del las por con no su para al lo como más pero sus entre cuando muy sin sobre también hasta hay donde""".split()
)
#: Shorter blocks stay open in the first pass.
SHORT = 70
#: Blocks with a larger share of their characters in links aren't text.
LINKS = 0.5
#: Least share of stop words in a block of text; a page with less than the second on the whole is in an unknown language.
STOPS, KNOWN = 0.12, 0.04

BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody
    td tfoot th thead tr ul""".split()
)
#: Elements whose content is no markup: everything up to their end tag is passed over.
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
#: Elements that never hold an article, and those that may only wrap one.
NEVER = frozenset("nav footer aside dialog menu button select datalist svg math canvas object audio video".split())
WRAPS = frozenset("form header fieldset search".split())
VOID = frozenset("hr br img input meta link base col embed source track wbr area param".split())
#: Words in a class, an id or a role that mark what isn't the article; the first ones do so even on an article element.
COMMENT = frozenset("comment comments reply replies respond disqus".split())
ASIDE = COMMENT | frozenset(
    """ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert
    newsletter subscribe subscription signup login sidebar widget related recommended recommendations teaser teasers share sharing
    social breadcrumb breadcrumbs menu nav navbar navigation footer header masthead toolbar pagination pager popup modal overlay
    navigation contentinfo complementary search form dialog alertdialog feedback discussion notification notifications announcement
    disclaimer copyright legal""".split()
)
#: Beginnings of such words where several are written as one; what follows "comment" isn't "ary".
STEM = re.compile(r"(comment(?!ary)|advert|adslot|adbox|adbanner|sponsor|newsletter|cookie|breadcrumb|sidebar|subscri|promo|recommend|related)[a-z]+")
STEMS = {"comment": "comment", "sidebar": "sidebar"}
#: A start tag of the key ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"(?:has|with|no|without|hide)[-_]+[A-Za-z]+|[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}


class Block(NamedTuple):
    """A block's text and what the rules look at."""

    text: str
    linked: int  # characters inside links
    heading: bool
    main: bool  # inside an article or main element
    outside: bool  # inside an element that isn't part of an article


def marks(attributes: str) -> set[str]:
    """The words in an element's class, id and role; ``hidden`` for one that isn't shown."""
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            found.add("hidden")
        elif name in ("class", "id", "role"):
            parts = [x.lower() for x in NAME_PART.findall(value)]
            found.update(STEMS.get(m[1], "ad") if (m := STEM.fullmatch(x)) else x for x in parts)
    return found


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order: runs of text between block-level tags or two line breaks."""
    cut: list[tuple[str, int, bool, bool, int]] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, the element left out that it lies in before it, whether it is a main element
    opened: Counter = Counter()
    parent, out, fixed = [], [], []  # of each element left out: the one around it, whether it still is, whether it stays so
    inside = -1  # the innermost of them
    main, seen_main, broke = 0, False, False

    def flush(heading: bool = False) -> None:
        text = " ".join("".join(parts).split())
        if text:
            cut.append((text, min(len(text), len(" ".join("".join(links).split()))), heading, main > 0, inside))
        parts.clear()
        links.clear()

    def pop() -> str:
        nonlocal inside, main
        name, inside, is_main = stack.pop()
        opened[name] -= 1
        main -= is_main
        return name

    at = 0
    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if opened["a"]:
                links.append(text)
            broke = broke and text.isspace()
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush(name in ("h1", "h2", "h3", "h4", "h5", "h6"))
            if opened[name] > 0:
                while pop() != name:
                    pass
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            if broke:
                flush()
            broke = True
            continue
        if name in BLOCKS:
            flush()
            while stack and (stack[-1][0] == "p" or stack[-1][0] in ENDS.get(name, ())):
                pop()
        elif name == "a":
            if opened["a"] and stack[-1][0] == "a":
                pop()
        elif name not in NEVER:
            continue
        if name in VOID or m[3].endswith("/") and name in NEVER:
            continue
        said = marks(m[3]) if m[3] and name != "a" else set()
        is_main = (name in ("article", "main") or "main" in said and name == "div" and "content" in said) and not said & COMMENT
        never = name in NEVER or "hidden" in said and name not in ("html", "body") or name in ("article", "main") and not is_main
        wraps = name in WRAPS and not (name == "header" and main) or not is_main and name not in ("html", "body", "main") and bool(said & ASIDE) and not (main and said & ASIDE <= {"header"})
        stack.append((name, inside, is_main))
        opened[name] += 1
        if is_main and not seen_main:
            seen_main, k = True, inside  # what wraps the article isn't left out
            while k >= 0 and not fixed[k]:
                out[k], k = False, parent[k]
        main += is_main
        if never or wraps:
            parent.append(inside)
            out.append(True)
            fixed.append(never)
            inside = len(out) - 1
    flush()
    for k, p in enumerate(parent):
        out[k] = out[k] or p >= 0 and out[p]
    return [Block(text, linked, heading, is_main, k >= 0 and out[k]) for text, linked, heading, is_main, k in cut]


def first_pass(found: list[Block], stop_words: frozenset) -> np.ndarray:
    """1 for text, 0 for no text, -1 for blocks left open."""
    words = [[w.strip(".,;:!?()\"'«»„“”¿¡") for w in b.text.lower().split()] for b in found]
    stops = np.array([sum(w in stop_words for w in ws) for ws in words], dtype=float)
    count = np.array([len(ws) for ws in words], dtype=float)
    chars = np.array([len(b.text) for b in found])
    linked = np.array([b.linked for b in found]) / np.maximum(chars, 1)
    main = np.array([b.main for b in found], dtype=bool)
    known = stops.sum() >= KNOWN * count.sum()
    dense = stops >= STOPS * count if known else linked == 0
    label = np.where(dense, 1, np.where(main, -1, 0))
    label[chars < SHORT] = -1
    label[linked > LINKS] = 0
    label[[not b.main and b.text.lower().startswith(("©", "(c)", "copyright")) for b in found]] = 0
    return label


def second_pass(label: np.ndarray, heading: np.ndarray, main: np.ndarray) -> np.ndarray:
    """Whether each block is text: an open one is as the nearest decided block, a heading at equal distance as the next."""
    n = len(label)
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(label >= 0, place, -1))
    after = np.minimum.accumulate(np.where(label >= 0, place, n)[::-1])[::-1]
    far = np.where(before < 0, n + 1, place - before), np.where(after >= n, n + 1, after - place)
    left, right = label[np.maximum(before, 0)] == 1, label[np.minimum(after, n - 1)] == 1
    open_label = np.where(far[0] < far[1], left, np.where(far[1] < far[0], right, np.where(left == right, left, main | heading & right)))
    open_label = np.where((before < 0) & (after >= n), main, open_label)
    return np.where(label >= 0, label == 1, open_label)


def main_text(page: str, stop_words: frozenset = STOP_WORDS) -> str:
    """The article of a page: its blocks' texts, joined by an empty line; empty if there is none."""
    found = [b for b in blocks(page) if not b.outside]
    if any(b.main for b in found):
        found = [b for b in found if b.main]
    if not found:
        return ""
    heading, main = (np.array([getattr(b, k) for b in found], dtype=bool) for k in ("heading", "main"))
    return "\n\n".join(b.text for b, good in zip(found, second_pass(first_pass(found, stop_words), heading, main)) if good)


def extract(pages: DataFrame, stop_words: frozenset = STOP_WORDS) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null html is empty, its text too. Rows are judged one by one, so repeated ids and rows stay as
    they are; null ids and urls are passed on; other columns are dropped. A page is held whole by
    one task, whatever its length.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        out = [main_text(x.decode("utf-8", "replace"), stop_words) for x in texts(batch["html"])]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(out, pa.string()), "n_chars": pa.array(map(len, out), pa.int64())}

    rows.__module__ = __name__
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(in_batches(rows, 500), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
