"""Main-text extraction from HTML by tag-path ratios.

Text is gathered in blocks, each under its root-to-leaf tag path.  Per path the
text length outside links and the punctuation are summed; both ratios (per
block) are smoothed over neighbouring paths in page order, fused by their
product and held against a threshold.  The blocks on a path over the threshold
that are no mere links or labels are the content nodes.  They are returned with
what lies between them and what stands in the same container at either end (a
title, a last short line), so nothing of an article is lost for being short; in
an article or main element that holds content nodes, every block is content.

Left out are elements whose name says that they are no article (menus, sidebars,
footers, forms' controls, scripts), and elements whose class or role says so,
unless they hold the article element or, without one, most of the page's text:
a page may stand in one form, and a class may name a neighbour.  Of a header only its headings stay, where it is the
header of the content and not of the page.

Work and memory are linear in the page, however deep its elements.

Defined results: null, empty and text-less pages give an empty text; markup
that isn't closed ends with the page; repeated rows are extracted alike; a null
id or url is carried; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

# Element names and class words of HTML practice.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head nav footer aside menu dialog button select option input label svg math canvas audio video object applet map".split())
CLASS_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer foot comment comments commentlist disqus reply replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager skip".split()
)
HEADER_WORDS, COMMENT_WORDS = frozenset("header masthead".split()), frozenset("comment comments commentlist disqus reply replies".split())
CONTENT_WORDS = frozenset("entry post article content".split())
#: A class that starts so tells of a neighbour, or of none.
ABOUT_OTHERS = frozenset("has have no not with without hide show is js".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INNER = HEADINGS | frozenset("p li ul ol dl dt dd td th tr table tbody thead tfoot caption blockquote pre figure figcaption details summary hgroup address center header dir".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MAIN = frozenset({"article", "main"})
STOPS = frozenset("ul ol dl table div section article aside nav form main body".split())

TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^"'>]|["'])*+)>|<[!?/][^>]*>?""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Neighbouring paths that are smoothed over, the threshold as a share of the best path's score, links' share of a
#: mere list of links, characters of a block that counts without punctuation, and a wrapper's least share of the text.
SPAN, KEEP, LINKS, LABEL, WRAPPER = 1, 0.25, 0.8, 40, 0.5
#: Kinds of elements: content, hidden for good, aside unless it wraps the page, reader comments, header.
PLAIN, HIDDEN, ASIDE, COMMENTS, HEADER = range(5)


def kind_of(tag: str, attributes: str) -> tuple[int, bool]:
    """Kind of an element, and whether its class names an article's part."""
    if tag in NEVER:
        return HIDDEN, False
    kind = ASIDE if tag == "form" else HEADER if tag == "header" else PLAIN
    if not attributes or tag in ("html", "body", "main"):
        return kind, False
    part = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HIDDEN, False
        if name == "role" and value in ROLES and tag != "article":
            kind = max(kind, ASIDE)
        if name in ("class", "id"):
            for token in value.split():
                words = WORD.findall(token)
                if not words or words[0] in ABOUT_OTHERS:
                    continue
                ends = {words[0], words[-1]}
                part = part or not CONTENT_WORDS.isdisjoint(words)
                if ends & COMMENT_WORDS:
                    kind = COMMENTS
                elif tag == "article" or kind == COMMENTS:
                    continue
                elif ends & HEADER_WORDS:
                    kind = HEADER
                elif ends & CLASS_WORDS and kind != HEADER:
                    kind = ASIDE
    return kind, part


class Page:
    """Elements (tag, parent, kind, whether named after an article's part) and blocks (text, characters in links, path, element)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, int]] = []
        self.paths: dict[tuple[int, str], int] = {(-1, ""): 0}
        self.tags, self.parents, self.kinds, self.parts = [""], [-1], [PLAIN], [False]
        #: Open elements: tag, number of the nearest block element, its path, whether it hides.
        self.stack: list[tuple[str, int, int, bool]] = []
        self.open_tags: dict[str, int] = {}
        self.hidden, self.links = 0, 0
        self.words: list[str] = []
        self.linked = 0
        self.read(source)

    def flush(self) -> None:
        if self.words:
            text = SPACE.sub(" ", html.unescape("".join(self.words))).strip()
            if text:
                _, element, path, _ = self.stack[-1] if self.stack else ("", 0, 0, False)
                self.blocks.append((text, min(self.linked, len(text)), path, element))
        self.words, self.linked = [], 0

    def pop(self) -> None:
        tag, _, _, hides = self.stack.pop()
        self.open_tags[tag] -= 1
        self.hidden -= hides
        self.links -= tag == "a"

    def close(self, names: frozenset | set, stops: frozenset) -> None:
        """Closes the nearest open element of these names, unless one of ``stops`` is nearer."""
        if not any(self.open_tags.get(n) for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in stops:
                return

    def open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self.close({"p"}, STOPS)
        if tag in CLOSED_BY:
            self.close(CLOSED_BY[tag], STOPS)
        kind, part = kind_of(tag, attributes)
        _, element, path, _ = self.stack[-1] if self.stack else ("", 0, 0, False)
        if tag in BLOCK or kind:
            # An inline element of its own kind stands for itself too.
            self.tags.append(tag), self.parents.append(element), self.kinds.append(kind), self.parts.append(part)
            element = len(self.tags) - 1
            path = self.paths.setdefault((path, tag), len(self.paths))
        self.stack.append((tag, element, path, kind == HIDDEN))
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        self.hidden += kind == HIDDEN
        self.links += tag == "a"

    def text(self, raw: str) -> None:
        if raw and not self.hidden:
            self.words.append(raw)
            if self.links:
                self.linked += len(raw)

    def read(self, source: str) -> None:
        # No tag ends after the last ">", and a search for its end from every "<" there would take quadratic time.
        at, end, stop_at = 0, len(source), max(source.rfind(">") + 1, source.rfind("<!--") + 4)
        while at < end:
            m = TAG.search(source, at, stop_at)
            if not m:
                break
            self.text(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0] == "<!--":
                    stop = source.find("-->", at)
                    at = end if stop < 0 else stop + 3
                continue
            tag = tag.lower()
            if tag in BLOCK:
                self.flush()
            elif tag == "br":
                self.text("\n")
            if m[1]:
                self.close({tag}, frozenset())
            elif tag in RAW:
                stop = RAW_END[tag].search(source, at)
                at = stop.end() if stop else end
            elif tag not in VOID:
                self.open(tag, m[3])
        else:
            self.flush()
            return
        self.text(source[at:])
        self.flush()

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per element, the sum over the blocks in it; values: per block."""
        total = [0.0] * len(self.tags)
        for (*_, element), v in zip(self.blocks, values):
            total[element] += v
        for e in range(len(self.tags) - 1, 0, -1):
            total[self.parents[e]] += total[e]
        return np.array(total)

    def above(self, marked: list[bool]) -> list[bool]:
        """Per element, whether a marked one is in it or is it."""
        out = list(marked)
        for e in range(len(self.tags) - 1, 0, -1):
            out[self.parents[e]] |= out[e]
        return out

    def nearest(self, use) -> list[int]:
        """Per element, the nearest one from it upwards that ``use`` holds for, -1 without one."""
        out: list[int] = []
        for e, parent in enumerate(self.parents):
            out.append(e if use(e) else out[parent] if parent >= 0 else -1)
        return out


RAW_END = {tag: re.compile(f"</{tag}\\b[^>]*>?", re.I) for tag in RAW}


def content_paths(page: Page, size: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Whether each path is over the threshold; size: characters outside links of each block, use: blocks that count."""
    first = {}
    for i in np.flatnonzero(use).tolist():
        first.setdefault(page.blocks[i][2], len(first))
    n = len(first)
    length, marks, blocks = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(use).tolist():
        text, linked, path, _ = page.blocks[i]
        k = first[path]
        length[k] += size[i]
        marks[k] += len(PUNCTUATION.findall(text)) if linked < len(text) else 0
        blocks[k] += 1
    good = np.zeros(len(page.paths), bool)
    if n:
        window = np.ones(2 * SPAN + 1) / (2 * SPAN + 1)
        smooth = lambda x: x / 2 + np.convolve(x, window, mode="full")[SPAN : SPAN + n] / 2
        fused = np.sqrt(smooth(length / blocks) * (1 + smooth(marks / blocks))) * np.sqrt(length)
        good[list(first)] = (fused > 0) & (fused >= KEEP * fused.max())
    return good


def extract(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    blocks = page.blocks
    if not blocks:
        return ""
    at = np.array([e for *_, e in blocks])
    size = np.array([len(t) - linked for t, linked, *_ in blocks], float)
    # Elements that say they are no article, but hold the article element or (without one) most of the text, are wrappers.
    inside, whole = page.sums(size), size.sum()
    mains = [page.tags[e] in MAIN and page.kinds[e] == PLAIN and inside[e] > 0 for e in range(len(page.tags))]
    holds = page.above(mains)
    wraps = lambda e: holds[e] if any(mains) else inside[e] >= WRAPPER * whole
    aside = lambda e: page.kinds[e] == COMMENTS or page.kinds[e] in (ASIDE, HEADER) and not wraps(e)
    over = np.array(page.nearest(aside))[at]
    use = over < 0
    good = content_paths(page, size, use)
    node = np.array([use[i] and bool(good[p]) and linked <= LINKS * len(t) for i, (t, linked, p, _) in enumerate(blocks)])
    telling = np.array([bool(PUNCTUATION.search(t)) or len(t) >= LABEL for t, *_ in blocks])
    node = node & telling if (node & telling).any() else node
    if not node.any():
        # Nothing but links or asides: what is no link.
        return "\n".join(t for (t, linked, *_), ok in zip(blocks, use) if ok and linked <= LINKS * len(t))
    found = np.flatnonzero(node)
    first, last = int(found[0]), int(found[-1])
    held = page.sums(node)
    region = max(e for e in range(len(page.tags)) if held[e] == len(found))
    main = page.nearest(lambda e: page.tags[e] in MAIN and held[e] > 0)
    container = page.nearest(lambda e: page.tags[e] not in INNER)
    body = page.nearest(lambda e: e == region)
    ends = {container[at[first]], container[at[last]]}
    out = []
    for i, (text, linked, _, e) in enumerate(blocks):
        if over[i] >= 0:
            # Of a header of the content, the headings.
            h = int(over[i])
            parent = page.parents[h]
            ours = main[parent] >= 0 or page.parts[h] and body[parent] >= 0 or container[parent] == container[region] and page.tags[container[region]] not in ("", "html", "body")
            keep = page.kinds[h] == HEADER and page.tags[e] in HEADINGS and ours
        else:
            keep = main[e] >= 0 or first <= i <= last and body[e] >= 0 or container[e] in ends and linked <= LINKS * len(text) or page.tags[e] in HEADINGS and body[e] >= 0
        if keep:
            out.append(text)
    return "\n".join(out)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    pages = pick(df, id=id_col, url=url_col, html=html_col)

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema["id"].dataType.simpleString()
    out = pages.mapInArrow(run, f"id {kind}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
