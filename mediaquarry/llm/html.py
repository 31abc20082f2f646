"""Main text of web pages by composite text density.

Every element has its characters per tag, adjusted by the share of characters
and tags that lie in links.  Elements of a line of text (bold, links and such)
count as tags of what holds them but have no density of their own.  The element
whose children have the greatest sum of densities holds the main text; the
least density on its path to the body is the threshold that elements beside
that path must reach to be taken as well.  A heading beside the path needs no
density, and takes part wherever it belongs to what is chosen.

Menus, forms, adverts and the like, known by their tag, role or class, have
density zero; a class says nothing where the element holds an article, or a
first heading and most of the text.  That an element is an article or a main
part decides nothing else.

A page is read once, by a regular expression for its tags; nesting is kept in
arrays, so depth and length are bounded by memory only.

Defined results: null, empty or text-free html gives an empty text; markup that
is never closed ends with the page; what isn't valid as a tag is text; a null
url stays null; repeated rows give repeated results; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ready, sliced

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
SPACES = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody"
    " td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
#: Elements that are no part of any text.
SKIP = frozenset(
    "script style head title template noscript iframe noembed noframes object svg canvas audio video nav footer aside form button"
    " select option textarea input dialog menu search math map".split()
)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of a class or id.
SKIP_NAMES = frozenset(
    "nav navbar navigation menu menubar submenu megamenu dropdown breadcrumb breadcrumbs topnav subnav sidenav leftnav rightnav sitemap"
    " sidebar aside footer colophon masthead topbar ad ads adv advert adverts advertisement advertising adbox adslot adunit adsense"
    " adsbygoogle sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices notification disclaimer alert"
    " popup modal overlay toast paywall newsletter subscribe subscription signup login search searchbox searchform comment comments"
    " commentlist commentform usercomments respond replies discussion disqus share sharing social related recommended widget toolbar"
    " skip copyright pagination pager hidden".split()
)
#: Names and tags that are skipped only outside an article or main part.
SKIP_OUTSIDE = frozenset(["header"])
MAIN = frozenset(["article", "main"])
NAMED, SURE = 1, 2
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("body html tbody tfoot thead tr td th caption option optgroup legend summary".split())
#: A start tag of these ends an open one of the set, within the nearest list or table.
ENDS_SAME = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset(["ul", "ol", "menu"]))),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    **dict.fromkeys(["tr"], (frozenset(["tr"]), frozenset(["table"]))),
    **dict.fromkeys(["option"], (frozenset(["option"]), frozenset(["select"]))),
}
P_SCOPE = frozenset("table td th caption button object".split())


class Page:
    """The elements of a page in order, and its runs of text."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.end, self.main = ["#root"], [-1], [0], [False]
        #: 0: part of the page, NAMED: named as something else, SURE: certainly something else
        self.own = [0]
        #: (element, block, text)
        self.runs: list[tuple[int, int, str]] = []
        self._open, self._block = [0], 0
        self._how_many: dict[str, int] = {}
        at, n = 0, len(html)
        while at < n:
            token = TOKEN.search(html, at)
            if token is None:
                break
            self._text(html[at : token.start()])
            at = token.end()
            name = token[2]
            if name is None:
                continue
            name = name.lower()
            if token[1]:
                self._close(name)
                continue
            self._start(name, token[3])
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                at = close.start() if close else n
        self._text(html[at:])
        while self._open:
            self._pop()
        self.skip = self._skipped()

    def _skipped(self) -> list[bool]:
        """Whether each element is part of what is left out."""
        n = len(self.tag)
        chars, article, first = [0] * n, [False] * n, [tag == "h1" for tag in self.tag]
        for node, _, text in self.runs:
            chars[node] += len(text.strip())
        for i in range(n - 1, 0, -1):
            if self.own[i] != SURE:
                p = self.parent[i]
                chars[p] += chars[i]
                article[p] |= article[i] or (self.tag[i] in MAIN and not self.own[i])
                first[p] |= first[i]
        out = [False] * n
        for i in range(1, n):
            named = self.own[i] == NAMED and not article[i] and not (first[i] and 2 * chars[i] > chars[0])
            out[i] = out[self.parent[i]] or named or self.own[i] == SURE
        return out

    def _text(self, text: str) -> None:
        if text:
            self.runs.append((self._open[-1], self._block, entities.unescape(text) if "&" in text else text))

    def _pop(self) -> None:
        node = self._open.pop()
        self.end[node] = len(self.tag)
        if node:
            self._how_many[self.tag[node]] -= 1
        if self.tag[node] in BLOCK:
            self._block += 1

    def _find(self, names: frozenset[str], stop: frozenset[str]) -> int:
        """Where in the open elements the innermost of ``names`` is, or 0 if one of ``stop`` is nearer."""
        if not any(self._how_many.get(x) for x in names):
            return 0
        for k in range(len(self._open) - 1, 0, -1):
            if (tag := self.tag[self._open[k]]) in names:
                return k
            if tag in stop:
                return 0
        return 0

    def _close(self, name: str) -> None:
        if name == "br":
            self._text(" ")
        elif k := self._find(frozenset([name]), frozenset(["table"]) - {name} if name not in MAIN and name in BLOCK - {"body", "html", "div"} else frozenset()):
            while len(self._open) > k:
                self._pop()
        elif name == "p":
            self._block += 1

    def _start(self, name: str, rest: str) -> None:
        if name in ("html", "body") and self._how_many.get(name):
            return
        ends = ENDS_SAME.get(name)
        k = self._find(*ends) if ends else self._find(frozenset("p"), P_SCOPE) if name in ENDS_P else 0
        while k and len(self._open) > k:
            self._pop()
        if name == "body":  # what is still open belongs to the head
            while self.tag[self._open[-1]] not in ("html", "#root"):
                self._pop()
        above = self._open[-1]
        main = self.main[above] or name in MAIN
        own = SURE if name in SKIP or (name in SKIP_OUTSIDE and not main) else 0
        if rest and not own and not rest.isspace():
            given = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(rest)}
            role = given.get("role", "").lower()
            main = main or role in MAIN
            hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").lower().replace(" ", "")
            if name not in ("html", "body", "main"):
                words = {w.lower() for w in WORD.findall(f"{given.get('class', '')} {given.get('id', '')}")}
                own = NAMED if words & SKIP_NAMES else SURE if words & SKIP_OUTSIDE and not main else 0
            if hidden or role in SKIP_ROLES:
                own = SURE
        if name in BLOCK:
            self._block += 1
        elif name == "br":
            self._text(" ")
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(above)
        self.end.append(node + 1)
        self.own.append(own)
        self.main.append(main)
        if name not in VOID:
            self._open.append(node)
            self._how_many[name] = self._how_many.get(name, 0) + 1

    def densities(self) -> tuple[list[float], list[float], list[int]]:
        """For each element its composite density, the sum of its children's, and its characters."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for node, _, text in self.runs:
            if not self.skip[node] and (size := len(text.strip())):
                chars[node] += size
                links[node] += size * in_link[node]
        for i in range(n - 1, 0, -1):
            if not self.skip[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        overall = links[0] / max(1, chars[0])
        own, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if (c := chars[i]) and not self.skip[i]:
                t, lc, lt = max(1, tags[i]), max(1, links[i]), max(1, link_tags[i])
                base = math.log(math.log(c / max(1, c - links[i]) * links[i] + overall * c + math.e))
                own[i] = c / t * math.log(max(math.e, c / lc * t / lt)) / (base if overall and base > 1e-6 else 1.0)
        for i in range(n - 1, 0, -1):
            if self.tag[i] in INLINE:
                own[i] = 0.0
                total[self.parent[i]] += total[i]
            else:
                total[self.parent[i]] += own[i]
        return own, total, chars

    def chosen(self) -> list[int]:
        """The elements whose text is the main one, in page order; none lies in another."""
        own, total, chars = self.densities()
        usable = [i for i in range(len(self.tag)) if chars[i] and not self.skip[i] and self.tag[i] not in INLINE]
        if not usable:
            return []
        best = max(usable, key=lambda i: (total[i], own[i], -i))
        path = [best]
        while path[-1] and self.tag[path[-1]] != "body":
            path.append(self.parent[path[-1]])
        threshold = min(own[i] for i in path if self.tag[i] not in INLINE)
        picked, above = {best}, set(path)
        for i in usable:
            p = self.parent[i]
            if i not in above and p in above and p != best:
                if self.tag[i] in HEADING or own[i] >= threshold:
                    picked.add(i)
        return sorted(picked)

    def text(self) -> str:
        spans = [(i, self.end[i]) for i in self.chosen()]
        out: list[str] = []
        at = None
        inside = [False] * len(self.tag)
        for a, z in spans:
            inside[a:z] = [True] * (z - a)
        for node, block, text in self.runs:
            if self.skip[node] or not inside[node]:
                continue
            if block == at:
                out[-1] += text
            else:
                out.append(text)
                at = block
        return "\n".join(b for b in (SPACES.sub(" ", x).strip() for x in out) if b)


def extract(html: str | None) -> str:
    """The main text of a page."""
    return Page(html).text() if html else ""


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages``."""
    ready(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    """The contract of operator 7 over the whole of ``pages``."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
