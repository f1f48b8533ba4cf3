"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path; inline elements are part of the block that they stand in. A
path's length ratio is its text over its blocks, links not counted; its punctuation ratio is its marks over its blocks. Both are
smoothed over neighbouring paths in page order, the more so the more two paths have in common, and fused by their product; paths
over a share of the page's mean are content, but for those that hold nothing but links and are no headings.
The text nodes of all content paths, wherever they stand, are the result, and with them short parts (captions, cells, list items,
code) of an article that has content, or of the deepest path that holds nearly all content text: all but lists and divisions of mere links, and
divisions of mere numbers; but nothing inside elements that are something else by
kind, class, id or role (menus, page headers, footers, sidebars, notices, adverts, forms, comments, hidden parts).
Inside an article a name that only may tell so (related-work, search-history, alert-level) counts if the element's own ratios
agree: if none of its paths is content.

Edge cases: null and empty pages have empty text; pages without tags are text as they stand; unclosed elements, comments
and scripts end with the page or, for paragraphs and list items, where the next one begins; repeated rows are treated one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.tokens import _texts

#: Quotation marks hold a value together only right after an equals sign.
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>\"'][^\s>]*+)?)*+)>?")
#: One attribute after another, values and all, so that what stands in a value is no name.
ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?")
TOLD = frozenset(("class", "id", "role", "style", "aria-hidden", "hidden"))
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An element of these ends where one of the same set begins in the same scope.
SIBLINGS = {tag: group for group in (("p",), ("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for tag in group}
#: Elements that begin a block end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul figure figcaption details".split())
SCOPES = frozenset("article aside blockquote body button caption details div fieldset footer form header html main nav section table td th ul ol dl figure".split())
OTHER = frozenset("nav footer aside form button select dialog menu svg canvas audio video object head input optgroup datalist".split())
WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|sidebar\w*|menu\w*|nav|navbar|navigation|breadcrumb\w*|footer\w*|masthead|topbar|comment\w*|disqus\w*|repl(?:y|ies)|respond|share|sharing|social\w*|related\w*|recommend\w*|newsletter\w*|subscribe\w*|signup|login|popup\w*|modal\w*|widget\w*|pagination|pager|toolbar|skip-link|search\w*)(?=$|[\s_-])", re.I)
#: Of those, names that articles use for parts of their own too, where they aren't the whole name.
MAYBE = re.compile(r"(?:notice|alert|menu|nav|repl|respond|shar|social|related|recommend|search|widget|banner|masthead|topbar)", re.I)
#: Blocks that hold text even where it is one link or number.
TEXTUAL = frozenset("p td th dd dt caption figcaption blockquote pre".split())
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar", "tablist"))
#: Neighbours that smooth a path, with their weights; a content path's share of the mean; the share of content text that makes a container.
KERNEL, THRESHOLD, HELD = (0.25, 0.5, 0.25), 0.5, 0.9
MARKS, LETTER = re.compile(r"[.,;:!?。，…]"), re.compile(r"[^\W\d_]")


class Page:
    """A page's elements (tag, parent, whether it is something else by kind) and text nodes, from one scan."""

    def __init__(self, text: str) -> None:
        self.tags, self.parents, self.other, self.paths = ["#page"], [-1], [False], [0]
        self.path_ids: dict[tuple[int, str], int] = {}
        self.above, self.depth = [-1], [0]  # of each path
        self.headings: set[int] = set()
        self.frames: set[int] = set()  # paths of html and body
        self.kinds = ["#page"]  # tag of each path
        self.maybe, self.article = [0], [0]  # of each path: the uppermost one that may be something else; the uppermost article
        self.blocks = [0]  # of each element, itself or, for an inline one, the element that it stands in
        self.nodes: list[tuple[int, str]] = []  # (element, text); (element, "") breaks a block
        self._scan(text)

    def _open(self, tag: str, rest: str, parent: int) -> int:
        named: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(rest):
            if (name := m[1].lower()) in TOLD:
                named.setdefault(name, m[2] or m[3] or m[4] or "")
        label = " ".join(filter(None, (named.get("class"), named.get("id"))))
        doubtful = False
        other = self.other[parent] or tag in OTHER or "hidden" in named or named.get("aria-hidden") == "true" or named.get("role", "").lower() in ROLES
        if not other and tag not in ("html", "body", "article", "main"):
            telling = [name for name in label.split() if WORDS.search(name)]
            doubtful = bool(telling) and self.article[self.paths[parent]] > 0 and all(MAYBE.search(n) and not WORDS.fullmatch(n) and not WORDS.search(MAYBE.sub("", n)) for n in telling)
            other = bool(telling) and not doubtful or "display:none" in named.get("style", "").replace(" ", "").lower()
            other = other or tag == "header" and not self._inside(parent, "article")
        self.tags.append(tag), self.parents.append(parent), self.other.append(other)
        path = self.paths[parent]
        if tag not in INLINE:
            over, path = path, self.path_ids.setdefault((path, f"{tag} {named.get('class', '')}"), len(self.path_ids) + 1)
            if path == len(self.above):
                self.above.append(over), self.depth.append(self.depth[over] + 1), self.kinds.append(tag)
                self.maybe.append(self.maybe[over] or path * doubtful)
                self.article.append(self.article[over] or path * (tag in ("article", "main")))
        self.paths.append(path)
        self.blocks.append(self.blocks[parent] if tag in INLINE else len(self.tags) - 1)
        if tag in HEADINGS:
            self.headings.add(path)
        if tag in ("html", "body"):
            self.frames.add(path)
        return len(self.tags) - 1

    def _inside(self, element: int, tag: str) -> bool:
        while element > 0 and self.tags[element] != tag:
            element = self.parents[element]
        return element > 0

    def _scan(self, text: str) -> None:
        stack, count, at, n = [0], {}, 0, len(text)

        def close(to: int) -> None:
            while len(stack) > to:
                tag = self.tags[stack.pop()]
                count[tag] -= 1
                if tag not in INLINE:
                    self.nodes.append((stack[-1], ""))

        while at < n:
            lt = text.find("<", at)
            lt = n if lt < 0 else lt
            if lt > at:
                self.nodes.append((stack[-1], text[at:lt]))
            if lt == n:
                break
            if text.startswith("<!--", lt):
                end = text.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if text[lt + 1 : lt + 2] in ("!", "?"):
                end = text.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = TAG.match(text, lt)
            if not m:
                self.nodes.append((stack[-1], "<"))
                at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if count.get(tag):
                    k = len(stack) - 1
                    while self.tags[stack[k]] != tag:
                        k -= 1
                    close(k)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}", re.I).search(text, at)
                at = n if end is None else max(text.find(">", end.end()) + 1, end.end())
                continue
            if tag in SIBLINGS or tag in ENDS_P:
                ends = SIBLINGS.get(tag, ("p",))
                for wanted in {*ends, "p"} if tag in ENDS_P else ends:
                    if count.get(wanted):
                        k = len(stack) - 1
                        while k and self.tags[stack[k]] != wanted and self.tags[stack[k]] not in SCOPES:
                            k -= 1
                        if self.tags[stack[k]] == wanted:
                            close(k)
            if tag not in INLINE:
                self.nodes.append((stack[-1], ""))
            if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
                continue
            stack.append(self._open(tag, m[3], stack[-1]))
            count[tag] = count.get(tag, 0) + 1

    def _likeness(self, a: int, b: int) -> float:
        """How much of the longer of two paths they have in common from the root on."""
        most = max(self.depth[a], self.depth[b])
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.above[a]
            else:
                b = self.above[b]
        return (self.depth[a] + 1) / (most + 1)

    def content_paths(self) -> dict[int, float]:
        """Fused ratios of the paths that are content."""
        order: dict[int, list[float]] = {}
        seen: set[int] = set()
        lettered: set[int] = set()
        for element, text in self.nodes:
            if text and not text.isspace() and not self.other[element]:
                sums = order.setdefault(self.paths[element], [0.0, 0.0, 0.0])
                linked = self.tags[element] == "a"
                sums[0] += 0 if linked else len(text.strip())
                sums[1] += 0 if linked else len(MARKS.findall(text))
                sums[2] += self.blocks[element] not in seen
                seen.add(self.blocks[element])
                if self.paths[element] not in lettered and LETTER.search(text):
                    lettered.add(self.paths[element])
        if not order:
            return {}
        lengths, marks = [s[0] / s[2] for s in order.values()], [(s[1] + 0.5) / s[2] for s in order.values()]

        alike = [self._likeness(a, b) ** 2 for a, b in zip(order, list(order)[1:], strict=False)]

        def smooth(x: list[float]) -> list[float]:
            out = []
            for k, own in enumerate(x):
                left, right = KERNEL[0] * alike[k - 1] if k else 0.0, KERNEL[2] * alike[k] if k < len(alike) else 0.0
                out.append((KERNEL[1] * own + left * x[k - 1] + right * x[k + 1 if k < len(alike) else k]) / (KERNEL[1] + left + right))
            return out

        fused = [math.sqrt(a * b) for a, b in zip(smooth(lengths), smooth(marks), strict=True)]
        least = THRESHOLD * sum(fused) / len(fused)
        # smoothing alone would lift a list of links beside long text
        links = {path for (path, _), x in zip(order.items(), lengths, strict=True) if not x and path not in self.headings} if any(lengths) else ()
        content = {path: f for path, f in zip(order, fused, strict=True) if f >= least and path not in links}
        # headings are short, and content where what they stand beside is
        beside, inside = {self.above[path] for path in content}, self._inner({path: order[path][0] for path in content})
        articles, parts = {self.article[path] for path in content} - {0}, {self.maybe[path] for path in content if path not in self.headings} | {0}

        def carried(path: int) -> bool:
            if path in self.headings and self.above[path] in beside:
                return True
            textual = self.kinds[path] in TEXTUAL
            return (inside[path] or self.article[path] in articles) and (textual or path not in links and (path in lettered or self.kinds[path] == "li"))

        return {path: f for path, f in zip(order, fused, strict=True) if self.maybe[path] in parts and (path in content or carried(path))}

    def _inner(self, weights: dict[int, float]) -> list[bool]:
        """By path: whether it lies inside the deepest path that holds nearly all of the weights, the page's frame aside."""
        held, inside = [0.0] * len(self.above), [False] * len(self.above)
        best = [0] * len(self.above)
        for path in range(len(held) - 1, -1, -1):  # paths come after those above them
            held[path] += weights.get(path, 0.0)
            if path:
                over = self.above[path]
                held[over] += held[path]
                if not best[over] or held[path] > held[best[over]]:
                    best[over] = path
        at = 0
        while (down := best[at]) and down not in weights and held[down] >= HELD * held[0]:
            at = down
        if at and at not in self.frames:
            for path in range(at + 1, len(held)):
                inside[path] = self.above[path] == at or inside[self.above[path]]
        return inside

    def text(self) -> str:
        content = self.content_paths()
        parts = [text or " " for element, text in self.nodes if not text or self.paths[element] in content and not self.other[element]]
        return " ".join(html.unescape("".join(parts)).split())


def main_text(page: str | None) -> str:
    return Page(page).text() if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(2)], names=["k", "html"])
            for at, found in _texts(iter([small])):
                texts = [main_text(p) for p in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at[0], len(at)) for c in (0, 1)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")
