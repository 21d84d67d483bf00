"""Main text of web pages by tree scoring.

A page becomes a tree of elements and, in page order, blocks of text. Every paragraph passes points for its length
and its commas to the elements around it, the nearest most; an element's points are discounted by the share of its text that
stands in links. The best container is kept with those siblings that look like it. Menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are left out by what an element is or says it is, and lists of links by their density.

Each page is worked on by itself in an Arrow stage: no shuffle, no state.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds of HTML elements and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, and none of the article either.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("head nav aside footer form menu dialog button fieldset search select datalist noscript template svg math canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class names and ids that say an element isn't the article, unless the part before says it only goes without or along with one.
NAMES = frozenset(
    "ad ads adsbygoogle adslot adunit adv advert advertisement advertisements adverts advertising alert aside banner breadcrumb breadcrumbs comment commentlist comments consent cookie "
    "cookies copyright disqus discussion feedback footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall "
    "popup promo promoted promotion recommended related remarks replies reply respond responses share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription teaser toolbar "
    "topbar widget widgets".split()
)
ALONGSIDE = frozenset("with has no without".split())
#: An article or main element is left out for these alone.
NO_ARTICLE = frozenset("ad advert comment promo related reply sponsored teaser".split())
#: What an opening element closes first, and the elements beyond which it doesn't look.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)), "thead": (("tbody", "tr", "td", "th"), ("table",)),
}

#: Levels of elements that a paragraph's points reach, and the characters of a paragraph that has any.
LEVELS, PARAGRAPH_CHARS = 5, 25
#: Points that an element has for its kind.
BONUS = {"article": 25, "main": 15}

# a quotation mark opens a value only after "=", and a value that nothing closes ends with the tag
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOLD = re.compile(r"class|id|role|hidden|style", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Elements (tag, parent, last element below, first block, past-the-end block) and blocks (element, text, letters in links)."""

    def __init__(self, source: str, strict: bool = True):
        self.tags, self.parents, self.last, self.first, self.end = ["#page"], [-1], [0], [0], [0]
        self.owner: list[int] = []
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.n_links: list[int] = []
        self.strict, self.articles = strict, 0
        self._read(source)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.owner.append(self.stack[self.edges[-1]])
                self.texts.append(text)
                self.linked.append(len(" ".join("".join(self.in_links).split())))
                self.n_links.append(self.links)
            self.parts, self.in_links, self.links = [], [], 0

    def _open(self, tag: str, block: bool) -> None:
        if block:
            self._flush()
            self.edges.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tags))
        self.tags.append(tag)
        self.parents.append(self.stack[-2])
        self.last.append(0)
        self.first.append(len(self.texts))
        self.end.append(0)

    def _close(self, place: int) -> None:
        """Closes everything from this place of the stack on."""
        while len(self.stack) > place:
            if self.edges[-1] == len(self.stack) - 1:
                self._flush()
                self.edges.pop()
            node = self.stack.pop()
            self.places[self.tags[node]].pop()
            self.last[node], self.end[node] = len(self.tags) - 1, len(self.texts)
        if self.silent and len(self.stack) <= self.silent:
            self.silent = 0
        if self.heading_only and len(self.stack) <= self.heading_only:
            self.heading_only = 0

    def _within(self, tags: tuple[str, ...], until: tuple[str, ...]) -> int:
        """Place of the outermost open element of tags inside the innermost one of until; 0 if there is none."""
        floor = max((self.places[t][-1] for t in until if self.places.get(t)), default=0)
        return min((p for t in tags for p in self.places.get(t, ())[-1:] if p > floor), default=0)

    def _read(self, source: str) -> None:
        self.stack, self.edges, self.places = [0], [0], {}
        self.parts, self.in_links, self.links = [], [], 0
        self.silent = self.heading_only = 0
        at, n = 0, len(source)
        while at < n:
            open_at = source.find("<", at)
            if open_at < 0:
                open_at = n
            if open_at > at:
                self._text(source[at:open_at])
            if open_at == n:
                break
            at = open_at
            after = source[at + 1 : at + 2]
            if after == "!" or after == "?":
                if source.startswith("<!--", at):
                    # "<!-->" and "<!--->" are empty comments
                    close = source.find("-->", at + 2)
                    at = n if close < 0 else close + 3
                else:
                    close = source.find(">", at)
                    at = n if close < 0 else close + 1
                continue
            found = _TAG.match(source, at)
            if not found:
                if after == "/" or ("a" <= after.lower() <= "z"):  # no tag: gone up to the next mark, or the end
                    close = source.find(">", at)
                    at = n if close < 0 else close + 1
                else:
                    self._text("<")
                    at += 1
                continue
            at = found.end()
            tag = found[2].lower()
            if found[1]:
                self._end_tag(tag)
            elif tag in RAW:
                # up to its end tag, whatever stands between; an element that is never closed takes the rest
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else n
            else:
                self._start_tag(tag, found[3])
        self._close(1)
        self._flush()
        self.last[0], self.end[0] = len(self.tags) - 1, len(self.texts)

    def _text(self, raw: str) -> None:
        if self.silent:
            return
        if self.heading_only and not any(self.places.get(h) for h in HEADINGS):
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.places.get("a"):
            self.in_links.append(text)

    def _start_tag(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block and self.places.get("p") and self.places["p"][-1] >= self.edges[-1]:
            self._close(self.places["p"][-1])
        if tag in CLOSES:
            place = self._within(*CLOSES[tag])
            if place:
                self._close(place)
        elif tag in HEADINGS and self.tags[self.stack[-1]] in HEADINGS:
            self._close(len(self.stack) - 1)
        elif tag == "a" and self.places.get("a") and self.places["a"][-1] > self.edges[-1]:
            self._close(self.places["a"][-1])
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._text(" ")
            return
        if tag in ("html", "body") and self.places.get(tag):
            return
        inside = any(self.places.get(t) for t in ("article", "main"))
        self._open(tag, block)
        if tag == "a":
            self.links += 1
        if self.silent:
            return
        named = self._named(tag, attributes) if attributes and _TOLD.search(attributes) else ""
        if inside and (tag == "header" or named == "header"):
            self.heading_only = self.heading_only or len(self.stack) - 1
        elif named or tag == "header" or (tag in LEFT_OUT and (self.strict or tag != "form")):
            self.silent = len(self.stack) - 1
        elif tag in ("article", "main"):
            self.articles += 1

    def _named(self, tag: str, attributes: str) -> str:
        """What the attributes say that an element is, if it isn't shown or isn't the article."""
        if tag in ("html", "body"):
            return ""
        names = []
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return name
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return name
            if name == "role" and self.strict and value.strip().lower() in ROLES:
                return name
            if name in ("class", "id") and self.strict and tag not in HEADINGS:
                names += value.split()
        for name in names:
            before = ""
            for part in map(str.lower, _PARTS.findall(name)):
                if part in (NO_ARTICLE if tag in ("article", "main") else NAMES) and before not in ALONGSIDE:
                    return part
                before = part
        return ""

    def _end_tag(self, tag: str) -> None:
        if tag == "br":
            self._text(" ")
        elif tag in ("html", "body"):
            return  # what follows still belongs to them
        elif tag == "p" and not self.places.get("p"):
            self._flush()
        elif self.places.get(tag):
            place = self.places[tag][-1]
            if tag in BLOCKS or place > self.edges[-1]:  # an inline element doesn't close the block it stands in
                self._close(place)

    def main(self) -> list[str]:
        """Blocks of the best container and of its siblings that look like it, in page order."""
        n = len(self.tags)
        letters, links, count = [0], [0], [0]
        for text, linked, k in zip(self.texts, self.linked, self.n_links, strict=True):
            letters.append(letters[-1] + len(text))
            links.append(links[-1] + min(linked, len(text)))
            count.append(count[-1] + k)

        def density(node: int) -> float:
            a, b = self.first[node], self.end[node]
            return (links[b] - links[a]) / (letters[b] - letters[a]) if letters[b] > letters[a] else 0.0

        # lists of links are menus, wherever they stand
        edges = [0] * (len(self.texts) + 1)
        for node in range(1, n):
            if self.tags[node] in ("ul", "ol", "dl", "table", "div", "section"):
                a, b = self.first[node], self.end[node]
                if count[b] - count[a] >= 3 and density(node) >= 0.8:
                    edges[a] += 1
                    edges[b] -= 1
        dropped = [depth > 0 for depth in itertools.accumulate(edges)]
        points = [0.0] * n
        for k, (node, text) in enumerate(zip(self.owner, self.texts, strict=True)):
            if dropped[k] or self.tags[node] in HEADINGS or len(text) < PARAGRAPH_CHARS:
                continue
            gain = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(self.linked[k], len(text)) / len(text))
            # a paragraph's points go to what stands around it; text right in a container is a paragraph of its own
            up = self.parents[node] if self.tags[node] in ("p", "pre", "li", "td", "dd", "dt", "blockquote", "figcaption") else node
            for level in range(LEVELS):
                if up < 0:
                    break
                points[up] += gain / (level + 1 if level < 2 else 2 * level)
                up = self.parents[up]
        for node in range(n):
            if self.end[node] > self.first[node]:
                points[node] = (points[node] + BONUS.get(self.tags[node], 0)) * (1 - density(node))
        if not self.texts or (self.articles and not any(t in BONUS and self.end[k] > self.first[k] for k, t in enumerate(self.tags))):
            return []  # an article without a word is the page's article all the same
        best = max(range(n), key=points.__getitem__)
        up = best
        while up > 0:  # an article is kept whole
            if self.tags[up] == "article":
                best = up
            up = self.parents[up]
        # lists and cells stand for the container they are in
        while self.tags[best] in ("ul", "ol", "dl", "li", "table", "tbody", "tr", "td", "blockquote", "p") and self.parents[best] > 0:
            best = self.parents[best]
        titled = any(t == "h1" for t in self.tags[best : self.last[best] + 1])
        kept, parent, least = [(self.first[best], self.end[best])], self.parents[best], max(2.0, 0.2 * points[best])
        if parent >= 0:
            for node in range(parent + 1, self.last[parent] + 1):
                if self.parents[node] != parent or node == best or self.end[node] == self.first[node] or density(node) >= 0.25:
                    continue
                alike = points[node] >= least and self.tags[best] != "article"
                lone = self.tags[node] == "p" and letters[self.end[node]] - letters[self.first[node]] >= 80
                title = not titled and node < best and self.tags[node] in ("h1", "hgroup")
                if alike or lone or title:
                    kept.append((self.first[node], self.end[node]))
            # and text right in the parent
            kept += [(k, k + 1) for k in range(self.first[parent], self.end[parent]) if self.owner[k] == parent and len(self.texts[k]) >= 80 and self.linked[k] < 0.25 * len(self.texts[k])]
        return [self.texts[k] for a, b in sorted(set(kept)) for k in range(a, b) if not dropped[k]]


def main_text(source: str | None) -> str:
    """The article's blocks joined by an empty line. Where names, roles and forms leave nothing and no article, they are not looked at."""
    page = Page(source or "")
    blocks = page.main()
    if not blocks and source and not page.articles:
        blocks = Page(source, strict=False).main()
    return "\n\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Null and empty html give an empty text; null ids and urls stay null; repeated rows are worked on each; very long pages and very
    deep trees take time in proportion; an empty table gives none; other columns don't matter. A header inside an article or
    main element keeps its headings only; a line break is white space; every block (paragraph, heading, list item, cell) is joined by an
    empty line.
    """
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op13_html(spark, sf_dir) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
