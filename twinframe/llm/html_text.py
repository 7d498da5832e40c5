"""Main text of web pages by tag-path ratios.

Every text node hangs on a path of tags from the root. Text length and
punctuation are summed per path, as nodes of one path are alike: paragraphs
stand on few paths with much text and many marks, menus and labels on paths with
little of both. Both ratios are smoothed over the nodes in page order, fused
into one score, and thresholded by their spread. The lowest element around all nodes
over the threshold is the article, or the article or main element around it;
headings and short paragraphs in that element belong to it too. Elements that
say what they are (menus, forms, notices, comments) do not count as content,
unless most of the text or the title is in them. An id, which may repeat a title,
says so within an article only if the paths inside are under the threshold.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Comments, code, tags with quoted values, other tags, declarations. Outside of quotes a tag ends before the next
# `<`; one without its `>` is text. So no tag is looked at beyond the next one, and time grows with the page.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style)(?=[\s/>])[^<>]*+>"""
    r""".*?(?:</(?P=raw)\b[^<>]*+>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)"""
    r"""(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^<>]*+)>|<[!?/][^<>]*+>""", re.S | re.I)
_ATTR = re.compile(
    r"""([a-zA-Z_:][^\s=/>]*+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""", re.S)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？؟।]")
_NAMES = re.compile(r"[a-z]+")
# Elements whose content isn't parsed, with their end tags. One without an end has no content.
_SKIPPED = {tag: re.compile(rf"</{tag}\b[^<>]*+>", re.I) for tag in ("noscript", "template", "iframe", "textarea")}
_EMPTY = re.compile(r"(?:^|[\s\"'])/$").search

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img "
    "math semantics mrow mi mn mo ms mtext mspace mstyle mpadded mphantom menclose merror mfenced mfrac msqrt mroot "
    "msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
NOT_CONTENT = frozenset(
    "head title nav footer aside button select option fieldset dialog menu legend svg annotation "
    "annotation-xml".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# What an opening tag ends if it is still open, and where the search for it stops.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
SCOPE = frozenset("ul ol dl table select article section main body html".split())
# Words in class, id and role by which elements say that they are no article text.
MARKS = frozenset(
    "ad ads alert advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "contentinfo cookie cookies disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pagination paywall popup promo promoted promotion related replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# First words of names that tell what surrounds an element.
ABOUT = frozenset("has no not with without is".split())
# Smoothing weights over neighbours in page order.
KERNEL = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
# Share of the scored text by which a marked element is a wrapper though a title stands outside.
HELD = 0.8


# Marks by kind: none; always left out; left out unless it holds most of the text; the same, or the article's
# title; the same in article or main; by an id, left out there where its paths are under the threshold.
NONE, ALWAYS, FORM, UNTITLED, INSIDE, BESIDE = range(6)
# Where an element stands: outside of article and main, in main, in article.
OUT, MAIN, ARTICLE = range(3)


def marked(tag: str, attrs: str, place: int) -> int:
    """Whether an element names itself as something other than article text."""
    if tag in NOT_CONTENT or (tag == "header" and place == OUT):
        return ALWAYS
    kind = FORM if tag == "form" else NONE
    if not attrs or attrs == "/":
        return kind
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role") and tag not in ("body", "html"):
            # Of the words that a name is made of; `has-sidebar` says nothing of the element itself.
            for label in value.split():
                words = _NAMES.findall(label)
                if MARKS.isdisjoint(words) or words[0] in ABOUT or kind == FORM:
                    continue
                # Ids of headings and sections are made of their titles.
                if name == "id" and (
                        tag in HEADINGS or place == ARTICLE
                        or ((tag == "section" or place == MAIN) and not MARKS.issuperset(words))):
                    continue
                kind = UNTITLED if place == OUT else BESIDE if name == "id" and kind != INSIDE else INSIDE
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and "display:none" in value.replace(" ", "")):
            return ALWAYS
    return kind


class Page:
    """Text nodes of a page in order, with their elements, paths and blocks."""

    def __init__(self, html: str):
        self.parent, self.path, self.mark, self.link = [-1], [0], [NONE], [False]
        self.titled = [True]  # h1 or main inside
        self.place = [OUT]
        self.names = names = ["#root"]
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, int, str]] = []  # element, block, text
        stack, open_tags = [0], {}
        block = 0
        at = 0
        endless: set[str] = set()  # elements to skip of which no further one has an end
        for token in _TOKEN.finditer(html):
            if token.start() < at:
                continue
            if token.start() > at:
                self._text(stack[-1], block, html[at:token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                if token["raw"] is not None:
                    block += 1
                continue
            tag = tag.lower()
            if tag == "br":
                self._text(stack[-1], block, " ")
                continue
            block += tag not in INLINE
            if tag in _SKIPPED:
                if not token["end"] and tag not in endless and not _EMPTY(token["attrs"]):
                    last = _SKIPPED[tag].search(html, at)
                    if last:
                        at = last.end()
                    else:
                        endless.add(tag)
                continue
            if token["end"]:
                if open_tags.get(tag):
                    while True:
                        name = names[stack[-1]]
                        open_tags[name] -= 1
                        if name == tag:
                            stack.pop()
                            break
                        self._endless(name, stack.pop())
                continue
            if tag in CLOSES_P and open_tags.get("p"):
                self._close(("p",), names, stack, open_tags)
            if tag in ENDS and any(map(open_tags.get, ENDS[tag])):
                self._close(ENDS[tag], names, stack, open_tags)
            if tag in VOID:
                continue
            up = stack[-1]
            me = len(names)
            names.append(tag)
            self.parent.append(up)
            self.path.append(self.paths.setdefault((self.path[up], tag), len(self.paths) + 1))
            place = max(self.place[up], ARTICLE if tag == "article" else MAIN if tag == "main" else OUT)
            self.mark.append(marked(tag, token["attrs"], place))
            self.place.append(place)
            self.titled.append(tag in ("h1", "main"))
            if self.titled[me]:
                while not self.titled[up]:
                    self.titled[up] = True
                    up = self.parent[up]
                up = stack[-1]
            self.link.append(self.link[up] or tag == "a")
            if not token["attrs"].endswith("/"):
                stack.append(me)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        if at < len(html):
            self._text(stack[-1], block, html[at:])
        for element in stack:
            self._endless(names[element], element)
        self._leave_out()
        off = self.off
        # Elements that hold blocks of text; a block of text alone is never the whole article.
        self.holds_blocks = [True] + [name in ("article", "main") for name in names[1:]]
        # Elements with a visible h1 inside, and those that are or hold an article or main.
        self.headed, self.named = [False] * len(names), [False] * len(names)
        self.heading = self._spread([name in HEADINGS for name in names])
        for element in range(len(names) - 1, 0, -1):
            if not off[element]:
                up = self.parent[element]
                self.headed[element] |= names[element] == "h1"
                self.named[element] |= names[element] in ("article", "main")
                self.headed[up] |= self.headed[element]
                self.named[up] |= self.named[element]
                self.holds_blocks[up] |= names[element] not in INLINE

    def _leave_out(self) -> None:
        """Find the elements that aren't content, `off`, and keep the other nodes."""
        self.off = self._spread([mark == ALWAYS for mark in self.mark])
        doubtful = [e for e, mark in enumerate(self.mark) if mark > ALWAYS and not self.off[e]]
        if doubtful:
            counts = self._counts(doubtful)
            self.off = self._spread([off or e in counts for e, off in enumerate(self.off)])
        self.nodes = [node for node in self.nodes if not self.off[node[0]]]

    def _spread(self, off: list[bool]) -> list[bool]:
        for element in range(1, len(off)):
            off[element] = off[element] or off[self.parent[element]]
        return off

    def _counts(self, doubtful: list[int]) -> set[int]:
        """Those of the elements `doubtful` whose mark counts, by the text over the threshold inside."""
        n = len(self.names)
        text, peak = [0] * n, [0.0] * n
        held = [i for i, (e, _, t) in enumerate(self.nodes) if not self.off[e] and t and not t.isspace()]
        least = 0.0
        if held:
            fused, own = scores(self, held)
            least = threshold(fused)
            for i, path_score in zip(held, own):
                element, _, words = self.nodes[i]
                peak[element] = max(peak[element], path_score)
                if path_score >= least:
                    text[element] += len(words)
        named, titles = [0] * n, [0] * n  # article or main with such text, and h1, inside
        for element in range(n - 1, 0, -1):
            up = self.parent[element]
            if not self.off[element]:
                named[element] += self.names[element] in ("article", "main") and text[element] > 0
                titles[element] += self.names[element] == "h1"
            for sums in (text, named, titles):
                sums[up] += sums[element]
            peak[up] = max(peak[up], peak[element])
        above = [0] * n
        for element in range(1, n):
            up = self.parent[element]
            above[element] = above[up] + (self.names[up] in ("article", "main") and text[up] > 0)

        def wraps(e: int) -> bool:
            if not text[e] or named[e] + above[e] < named[0]:
                return False
            return text[e] > text[0] / 2 if titles[e] == titles[0] else text[e] >= HELD * text[0]

        def counts(e: int) -> bool:
            mark = self.mark[e]
            if mark == UNTITLED and self.titled[e] or mark == BESIDE and "article" not in self.names:
                return False
            if mark == INSIDE and titles[e]:
                return False
            # An id may be made of a title, so it counts under the threshold only.
            return not (wraps(e) or mark == BESIDE and peak[e] > 0 and peak[e] >= least)

        return {e for e in doubtful if counts(e)}

    def _text(self, element: int, block: int, text: str) -> None:
        self.nodes.append((element, block, unescape(text) if "&" in text else text))

    def _endless(self, name: str, element: int) -> None:
        """An image without an end tag holds nothing, so what follows it is text."""
        if name == "svg":
            self.mark[element] = NONE

    def _close(self, tags, names, stack, open_tags) -> None:
        """End the open elements of these names that stand in the same scope."""
        last = None
        for i in range(len(stack) - 1, 0, -1):
            name = names[stack[i]]
            if name in tags:
                last = i
            elif name in SCOPE:
                break
        if last is not None:
            for element in stack[last:]:
                open_tags[names[element]] -= 1
                self._endless(names[element], element)
            del stack[last:]


def scores(page: Page, held: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Fused path ratios of the page's text nodes `held`: smoothed in page order, and of their own paths."""
    texts = [page.nodes[i][2] for i in held]
    path = np.array([page.path[page.nodes[i][0]] for i in held])
    linked = np.array([page.link[page.nodes[i][0]] for i in held])
    length = np.array([0 if a else len(t.strip()) for a, t in zip(linked, texts)], float)
    marks = np.array([0 if a else len(_PUNCTUATION.findall(t)) for a, t in zip(linked, texts)], float)
    _, place = np.unique(path, return_inverse=True)
    nodes = np.bincount(place)
    ratios = [np.bincount(place, values) / nodes for values in (length, marks + 0.1 * (length > 0))]
    own = [r[place] for r in ratios]
    smooth = [_smoothed(r) for r in own]
    return smooth[0] * smooth[1], own[0] * own[1]


def threshold(fused: np.ndarray) -> float:
    return min(fused.std(), fused.max())


def _smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian means over neighbours; at the ends over those that exist."""
    return np.convolve(values, KERNEL)[2:-2] / np.convolve(np.ones_like(values), KERNEL)[2:-2]


def article_blocks(html: str) -> list[str]:
    """The blocks of a page's main text, in order."""
    page = Page(html)
    held = [i for i, (_, _, text) in enumerate(page.nodes) if text and not text.isspace()]
    if not held:
        return []
    fused, own = scores(page, held)
    least = threshold(fused)
    # By its own path too, as what stands beside the article is lifted by its neighbours; titles are lifted rightly.
    chosen = (fused >= least) & ((own >= least) | [page.heading[page.nodes[i][0]] for i in held])
    if not (chosen & (own >= least)).any():
        chosen = fused >= least
    weight = np.zeros(len(page.parent), int)
    for i, over in zip(held, chosen):
        weight[page.nodes[i][0]] += bool(over)
    # Children come after their parents, so one pass backwards sums whole elements.
    children: dict[int, int] = {}
    for element in range(len(weight) - 1, 0, -1):
        weight[page.parent[element]] += weight[element]
    for element in range(1, len(weight)):
        up = page.parent[element]
        if up not in children or weight[element] > weight[children[up]]:
            children[up] = element
    top = 0
    while top in children and page.names[top] != "article":
        below = children[top]
        # The lowest element around all selected nodes; but neither a lone block of text, nor a part of main that is
        # no article, nor one that leaves the title behind.
        if weight[below] < weight[0] or not page.holds_blocks[below]:
            break
        if page.place[top] != OUT and not page.named[below]:
            break
        if page.headed[top] and not page.headed[below] and (page.place[top] != OUT or not page.named[below]):
            break
        top = below
    within = np.zeros(len(weight), bool)
    within[top] = True
    for element in range(top + 1, len(weight)):
        within[element] = within[page.parent[element]]
    blocks: dict[int, list[str]] = {}
    for element, block, text in page.nodes:
        if within[element]:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return [text for text in joined if text]


def main_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """`(page_id, url, text)`: the main text of every page, '' if there is none; one row per row.

    Character references are decoded, white space in a block becomes one space,
    blocks are joined by one space in page order. Null and empty pages have an
    empty text. Keys are carried as they are, null and repeated ones too; other
    columns are not read. Broken markup is read as far as it goes.
    """
    def run(batches):
        for batch in batches:
            texts = [" ".join(article_blocks(x)) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return map_batches(
        pages.select(F.col(key), F.col(url).cast("string"), F.col(html).cast("string")), run,
        f"page_id {kind}, url string, text string")
