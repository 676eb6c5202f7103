"""Main text of web pages by a site style tree.

The pages of one host are merged into one tree: an element's place is its path of
tags, ids and classes. For each place two entropies are taken over the host's pages:
of its presentations (the sequence of children it is given) and of the pages its
texts appear in. A text found on one page only speaks for content, one that returns
on all pages for boilerplate; a place whose presentation never changes is template.
A branch is as important as the most important place in it. Branches of low
importance are removed from each page, beside elements that HTML itself or common
class names mark as menus, notices, adverts, forms or comments. ``article`` and
``main`` branches are judged by marks alone, so that copied articles stay. A class name
does not remove what wraps an article or most of a page's text.

The tree is two aggregations over (host, place, feature), combined before the
shuffle, and one over the places above; a host with a third of all pages is spread
by its features. Only places of low importance travel to the pages: by broadcast
while they are measured below ``broadcast_bytes``, else by a shuffle join on the host.

Defined cases: a null or empty page, or one without main text, gives the empty text;
a null url is a host of its own; a host's only page, and places seen on fewer than
``least_pages`` pages, lose only what is marked; repeated rows give repeated results; an empty
table gives an empty one; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.common import rows_of
from atticsweep.session import written

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NUMBER = re.compile(r"\d+")
LETTERS = re.compile(r"[^a-z]+")

# Fixed values of HTML: elements without content, with raw text, within a line, and what a tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select".split())
FOREIGN = frozenset(("svg", "math"))  # may close themselves
# Without an end tag, what follows is theirs by HTML's rules; after any other it is the page's.
TO_THE_END = frozenset("script style textarea title iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}
LISTS = frozenset("ul ol dl table select body".split())

# What is never main text, by element and by word in id, class or role.
OUTSIDE = frozenset("head nav header footer aside form button dialog menu fieldset".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice "
    "newsletter subscribe popup modal overlay sidebar menu nav navigation navbar breadcrumb breadcrumbs masthead footer "
    "comment comments disqus respond share sharing social related recommended widget login signup search toolbar "
    "pagination pager complementary contentinfo alert".split()
)
MAIN = frozenset(("article", "main"))


@dataclass
class Element:
    tag: str
    place: int
    marked: bool
    within_main: bool
    children: list[str]
    words: tuple[int, ...]  # which branches around and with it are marked by a word
    main_words: tuple[int, ...] | None  # the same of the outermost article or main around it


def _attributes(text: str) -> tuple[str, set[str], bool]:
    """The element's name in its place, the words of its marks, and whether it is hidden."""
    name, words, hidden = "", set(), False
    if text.strip(" /"):
        seen = set()
        for key, value in ATTRIBUTE.findall(text):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in seen:  # of attributes with one name the first counts
                continue
            seen.add(key)
            if key == "hidden" or key == "aria-hidden" and value == "true":
                hidden = True
            elif key in ("id", "class", "role"):
                name += f"|{key}={NUMBER.sub('0', value)}"
                words.update(LETTERS.split(value))
    return name, words, hidden


def _place(parent: int, name: str) -> int:
    """A signed 64-bit name of a path."""
    return xxhash.xxh3_64_intdigest(name.encode(), parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


class Page:
    """Walks one page; subclasses say what to do when a block of text or an element ends."""

    def __init__(self):
        self.stack: list[Element] = []
        self.pieces: list[str] = []
        self.branches = 0

    def block(self, text: str) -> None: ...

    def ended(self, element: Element) -> None: ...

    def shut_out(self, place: int, marked: bool, within_main: bool) -> bool:
        return marked

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            self.pieces.clear()
            if text:
                self.block(text)

    def pop(self) -> None:
        self.flush()
        self.ended(self.stack.pop())

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        if "p" in (e.tag for e in self.stack[-1:]):
            self.pop()  # a paragraph ends where any other block begins
        for other in CLOSES.get(tag, ()):
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth].tag == other:
                    while len(self.stack) > depth:
                        self.pop()
                    break
                if self.stack[depth].tag in LISTS:
                    break
        above = self.stack[-1] if self.stack else None
        if above:
            above.children.append(tag)
        name, words, hidden = _attributes(attributes)
        within_main = bool(above and above.within_main)
        marked = hidden or tag in OUTSIDE and not (within_main and tag == "header")
        marked |= bool(above and above.marked)
        by_word = above.words if above else ()
        if words & MARKS and tag not in MAIN and tag not in ("html", "body"):
            self.branches += 1
            by_word += (self.branches,)
        main_words = above.main_words if above else None
        if main_words is None and tag in MAIN:
            main_words = by_word
        place = _place(above.place if above else 0, tag + name)
        within_main |= tag in MAIN
        self.stack.append(Element(tag, place, self.shut_out(place, marked, within_main), within_main, [], by_word, main_words))

    def close(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag == tag:
                while len(self.stack) > depth:
                    self.pop()
                return

    def walk(self, html: str) -> None:
        lower, at, size = None, 0, len(html)
        while at < size:
            start = html.find("<", at)
            if start < 0:
                start = size
            if start > at:
                self.pieces.append(html[at:start])
            if start == size:
                break
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), start):
                end = html.find(">", start)
                at = size if end < 0 else end + 1
                continue
            found = TAG.match(html, start) or LOOSE_TAG.match(html, start)
            if not found:
                self.pieces.append("<")
                at = start + 1
                continue
            at = found.end()
            tag = found[2].lower()
            if found[1]:
                if tag not in INLINE:
                    self.close(tag)
            elif tag in FOREIGN and found[3].endswith("/"):
                pass
            elif tag in RAW:
                lower = lower or html.lower()
                end = lower.find(f"</{tag}", at) if len(lower) == size else html.find(f"</{tag}", at)
                stop = html.find(">", end) if end >= 0 else -1
                if stop >= 0:
                    at = stop + 1
                elif tag in TO_THE_END:
                    at = size
            elif tag == "br":
                self.pieces.append(" ")
            elif tag == "hr":
                self.flush()
            elif tag not in VOID and tag not in INLINE:
                self.open(tag, found[3])
        while self.stack:
            self.pop()
        self.flush()


class Learner(Page):
    """What one page adds to the tree: its (place, parent place, kind, feature) without repeats."""

    def __init__(self):
        super().__init__()
        self.found: set[tuple[int, int, int]] = set()
        self.parents: dict[int, tuple[int, ...]] = {}

    def block(self, text: str) -> None:
        if self.stack:
            self.found.add((self.stack[-1].place, 1, xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)))

    def ended(self, element: Element) -> None:
        self.parents[element.place] = tuple(e.place for e in self.stack) + (element.place,)
        style = xxhash.xxh3_64_intdigest(" ".join(element.children).encode()) - (1 << 63)
        self.found.add((element.place, 0, style))


class Extractor(Page):
    def __init__(self, low: frozenset[int]):
        super().__init__()
        self.low = low
        self.blocks: list[tuple[str, tuple[int, ...], tuple[int, ...] | None]] = []

    def shut_out(self, place: int, marked: bool, within_main: bool) -> bool:
        return marked or place in self.low and not within_main

    def block(self, text: str) -> None:
        if not self.stack:
            self.blocks.append((text, (), None))
        elif not self.stack[-1].marked:
            self.blocks.append((text, self.stack[-1].words, self.stack[-1].main_words))

    def kept(self) -> list[str]:
        """Without branches marked by a word, unless what a page is about lies within them.

        That is the articles and ``main`` elements in fewest marked branches, or else all
        text; a branch around these, or with more than half of their text, is a wrapper.
        """
        mains = {m for _, _, m in self.blocks if m is not None}
        fewest = min(map(len, mains), default=0)
        chosen = {m for m in mains if len(m) == fewest}
        sizes, total = Counter(), 0
        for text, words, main in self.blocks:
            if not chosen or main in chosen:
                total += len(text)
                sizes.update(dict.fromkeys(words, len(text)))
        wrappers = {w for m in chosen for w in m} | {w for w, n in sizes.items() if 2 * n > total}
        return [text for text, words, _ in self.blocks if wrappers.issuperset(words)]


def main_text(html: str, low: frozenset[int] = frozenset()) -> str:
    page = Extractor(low)
    page.walk(html)
    return "\n\n".join(page.kept())


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        counts: Counter = Counter()
        paths: dict[tuple[str, int], tuple[int, ...]] = {}
        for host, html in zip(rows.column("host").to_pylist(), rows.column("html").to_pylist(), strict=True):
            page = Learner()
            page.walk(html)
            counts.update((host, *f) for f in page.found)
            paths.update(((host, place), path) for place, path in page.parents.items())
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([k[2] for k in keys], pa.int32()),
                pa.array([k[3] for k in keys], pa.int64()),
                pa.array([counts[k] for k in keys], pa.int64()),
                # The path is said once per slice of rows, with the presentation.
                pa.array([paths.pop(k[:2], None) if k[2] == 0 else None for k in keys], pa.list_(pa.int64())),
            ],
            names=["host", "place", "kind", "feature", "n", "path"],
        )


def style_tree(pages: DataFrame, weight: float = 0.7) -> DataFrame:
    """Per host and place: pages (how many have it) and importance (0 to 1) of the branch from there on."""
    schema = "host string, place bigint, kind int, feature bigint, n bigint, path array<bigint>"
    found = written(_pages(pages).select("host", "html").mapInArrow(_learn, schema))
    of = ["host", "place"]
    features = found.groupBy(*of, "kind", "feature").agg(F.sum("n").alias("n"))
    n, logs = F.col("n"), F.col("n") * F.ln("n")
    is_style, is_text = F.col("kind") == 0, F.col("kind") == 1
    # Entropies to the base of the number of pages m; sums of n, n ln n and the numbers of features are enough.
    sums = features.groupBy(*of).agg(
        F.sum(F.when(is_style, n)).alias("m"),
        F.sum(F.when(is_style, logs)).alias("style_logs"),
        F.sum(F.when(is_text, n)).alias("texts"),
        F.sum(F.when(is_text, logs)).alias("text_logs"),
    )
    m, log_m = F.col("m"), F.ln("m")
    alone = m <= 1
    own = sums.select(
        *of, "m",
        # Of presentations: -sum(p ln p) / ln m with p = n / m.
        F.when(alone, 1.0).otherwise((log_m - F.col("style_logs") / m) / log_m).alias("style"),
        # Of texts, each weighted by its pages: 1 - ln n / ln m.
        F.coalesce("texts", F.lit(0)).alias("texts"),
        F.when(alone, F.col("texts")).otherwise(
            F.greatest(F.lit(0.0), F.col("texts") - F.col("text_logs") / log_m)
        ).alias("text_sum"),
    )
    # A place's path is the same wherever it was seen; each place speaks for all places above it.
    paths = found.filter("path IS NOT NULL").select(*of, "path").distinct()
    above = paths.join(own, of).select("host", F.explode("path").alias("place"), "m", "style", "texts", "text_sum", F.col("place").alias("of"))
    return above.groupBy("host", "place").agg(
        F.max(F.when(F.col("of") == F.col("place"), F.col("m"))).alias("pages"),
        F.max((1 - weight) * F.col("style") + weight * F.coalesce(F.col("text_sum") / F.nullif("texts", F.lit(0)), F.lit(0.0))).alias("importance"),
    )


def extract(
    pages: DataFrame, threshold: float = 0.35, least_pages: int = 5, broadcast_bytes: int = 8 << 20
) -> DataFrame:
    """Per page: page_id, url, text and n_chars, without branches less important than ``threshold``."""
    low = style_tree(pages).filter((F.col("pages") >= least_pages) & (F.col("importance") < threshold))
    by_host = written(low.groupBy("host").agg(F.sort_array(F.collect_set("place")).alias("low")))
    size = by_host.agg(F.sum(F.size("low") * 8 + F.octet_length("host") + 32)).first()[0] or 0
    hint = "broadcast" if size <= broadcast_bytes else "merge"

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            hosts: dict[str, frozenset[int]] = {}
            out = []
            for html, host, places in zip(*(rows.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                if host not in hosts:
                    hosts[host] = frozenset(places or ())
                out.append(main_text(html, hosts[host]))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = _pages(pages).join(by_host.hint(hint), "host", "left").select("page_id", "url", "html", "host", "low")
    kinds = dict(pages.dtypes)
    return rows.mapInArrow(text, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")
