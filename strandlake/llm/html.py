"""Main-text extraction by composite text density.

The page becomes a tree; scripts, styles, menus, headers, footers, sidebars, forms, adverts, notices and comments are cut off.
Tags and roles cut for sure. A class or id cuts where one of its tokens is made of such names and of words that say nothing
("cookie-notice", "site-footer"), unless the node holds three quarters of the page's text outside links, an article's text
counted four times; a token that only contains such a name ("related-work", "side-by-side") cuts only what is mostly links. A
form stays if it holds most of that text, a container of comments only if there is no other text. Inside an article a name is as likely
what the article is about: there it cuts a section only if that is mostly links and fields or holds comments
(nodes that are named so, or tags of an author, a date and a reply), and never a heading, a quotation or a paragraph.

Every DOM node then gets its composite text density, characters per tag lowered by the share of links, and the sum of its
children's densities. The node with the largest sum, or the block that it stands in, is the main text. The smallest density on
its path to the body is the threshold: of every node that reaches it, the descendant with the largest sum is main text too. Beside
the path, up to the outermost main element or article that holds it or the body, a line stays unless a third of it is links: a title or a
last sentence in a node of its own is too short for any density, and nothing but the kinds above may be dropped, and a short
copyright line at the page's end.

Places of open tags are kept by name, so reading takes time in proportion to the page whatever its markup.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import text as tx

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CUT = frozenset("script style noscript template head title nav aside footer select option textarea iframe object svg canvas audio video menu dialog input".split())
#: Left out where they make up most of their line.
CONTROLS = frozenset("label button".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
#: Parts of classes and ids, cut at other characters than letters.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar "
    "comment comments disqus reply replies respond share sharing social pagination pager login".split()
)
#: These alone say too little.
MAYBE = NAMES | frozenset("side alert related recommended teaser widget search".split())
#: Words that leave a name what it is.
AROUND = frozenset(
    "site page top bottom left right main primary secondary inner outer box wrapper wrap container block area section list item items bar link links content "
    "text body form message module panel region column col row slot thread entry the post user reader header".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: An open one of the second ends where one of the first begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table td th ul ol dl article section div body main blockquote html".split())
#: Never cut by their own names inside an article, and cut there only for what they hold.
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption table thead tbody tr td th li dl dt dd hgroup caption details summary".split())
FIELDS = frozenset("input select textarea button".split())
#: A longer line that begins with the sign is text.
COPYRIGHT = 120
_OPENS = re.compile("<[A-Za-z/!?]")


def tokens(attrs: dict[str, str | None]) -> list[frozenset[str]]:
    """The words of each class and of the id."""
    return [frozenset(re.findall("[a-z]+", x)) for x in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()]


def made_of(words: frozenset[str], names: frozenset[str]) -> bool:
    """Is one of these words such a name, and does none of the others say more?"""
    return not names.isdisjoint(words) and all(x in names or x in AROUND or x in NAMES or len(x) == 1 for x in words)


def cut_by_tag(tag: str, attrs: dict[str, str | None], inside: bool) -> bool:
    return tag in CUT or (tag == "header" and not inside) or "hidden" in attrs or (attrs.get("role") or "").lower() in ROLES


def cut_by_name(tag: str, words: list[frozenset[str]], inside: bool) -> int:
    """3 if the names cut this node for what it holds, 2 if they alone do, 1 if they do so only where it is mostly links, else 0."""
    if tag in ("article", "main") or (inside and tag in CONTENT):
        return 0
    if inside and tag == "section":
        return 3 * any(not MAYBE.isdisjoint(x) for x in words)
    heads = not inside and any("header" in x and x <= AROUND for x in words)
    if heads or any(made_of(x, NAMES) for x in words):
        return 2
    return int(any(not MAYBE.isdisjoint(x) for x in words))


class Tree(HTMLParser):
    """Nodes in page order. Text goes to ``pieces`` as (node, text), None where a block begins or ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.by_tag, self.by_name = ["body"], [-1], [False], [0]
        self.comments, self.within, self.inside, self.holds, self.signed = [False], [False], [False], [False], [False]
        self.open = [0]
        self.at: dict[str, list[int]] = {"body": [0]}  # where in ``open`` each tag stands, and, under "", every block
        self.pieces: list[tuple[int, str] | None] = []

    def read(self, html: str) -> None:
        """The whole page; a tag that begins after the last end of one is none."""
        end = html.rfind(">") + 1
        broken = _OPENS.search(html, end)
        self.feed(html[: broken.start()] if broken else html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCK:
            self.pieces.append(None)
            self._close({"p"}, SCOPES - {"html"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES - CLOSES[tag])
        if tag in ("br", "hr"):
            self.pieces.append((self.open[-1], " "))
        up, own = self.open[-1], dict(attrs)
        words, inside = tokens(own), self.inside[up]
        content = inside and (tag in CONTENT or tag == "section")
        comments = tag != "main" and not content and any(made_of(x, COMMENTS) for x in words)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.at.setdefault("", []).append(len(self.open))
            self.open.append(len(self.tags))
        self.tags.append(tag)
        self.parents.append(up)
        self.by_tag.append(cut_by_tag(tag, own, inside))
        # what holds an article isn't cut for its name, such as a page "with-sidebar"
        self.holds.append(tag in ("article", "main") and not comments and not self.within[up])
        self.comments.append(comments)
        self.within.append(comments or self.within[up])
        self.by_name.append(cut_by_name(tag, words, inside))
        self.inside.append(inside or tag in ("article", "main"))
        self.signed.append(tag == "time" or any(not x.isdisjoint(("author", "byline", "date", "avatar", "reply")) for x in words))

    def cuts(self) -> list[bool]:
        n = len(self.tags)
        own, linked, hard, link, comments = [0] * n, [0] * n, list(self.by_tag), [False] * n, list(self.comments)
        holds, fields, remarks, signs = list(self.holds), [0] * n, [0] * n, [0] * n
        weight = [4 if tag in ("article", "main") else 1 for tag in self.tags]  # text of an article counts four times
        for i in range(1, n):
            up = self.parents[i]
            hard[i], link[i], comments[i] = hard[i] or hard[up], link[up] or self.tags[i] == "a", comments[i] or comments[up]
            weight[i] = max(weight[i], weight[up])
        texts = [(i, sum(map(len, x.split()))) for i, x in filter(None, self.pieces) if not hard[i]]
        rest = any(size for i, size in texts if not comments[i] and not link[i])
        for i, size in texts:
            if link[i]:
                linked[i] += size * weight[i]
            else:
                own[i] += size * weight[i] * (not rest or not comments[i])
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            own[up] += own[i]
            linked[up] += linked[i]
            holds[up] = holds[up] or holds[i]
            fields[up] += fields[i] + (self.tags[i] in FIELDS)
            remarks[up] += remarks[i] + self.comments[i]
            signs[up] += signs[i] + self.signed[i]
        out = []
        for i, up in enumerate(self.parents):
            name = 0 if holds[i] and not self.holds[i] else self.by_name[i]
            named = (name == 2 and own[i] <= 0.75 * own[0]) or (name == 1 and linked[i] > own[i])
            named = named or (name == 3 and (linked[i] > own[i] or 40 * fields[i] > own[i] or remarks[i] > 0 or signs[i] > 1))
            form = self.tags[i] == "form" and own[i] <= 0.5 * own[0]
            out.append(self.by_tag[i] or named or form or (rest and self.comments[i]) or (up >= 0 and out[up]))
        return out

    def _cut_from(self, k: int) -> None:
        """Close what is open from the k-th on."""
        for i in self.open[k:]:
            tag = self.tags[i]
            self.at[tag].pop()
            if tag in BLOCK:
                self.at[""].pop()
        del self.open[k:]

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        k = self._last(tags)
        if k and k > self._last(stop):
            self._cut_from(k)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.tags[self.open[-1]] == tag:
            self._cut_from(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.pieces.append(None)
        if tag in ("html", "body") or tag in VOID:
            return
        # an inline end tag closes nothing beyond the block it stands in
        k = self._last({tag})
        if k and (tag in BLOCK or k > self._last({""})):
            self._cut_from(k)

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.open[-1], data))


def density(c: float, t: float, lc: float, lt: float, body_c: float, body_lc: float) -> float:
    """Characters per tag, adjusted by the characters and tags in links."""
    if not c:
        return 0.0
    t, other, links, link_tags = max(t, 1), max(c - lc, 1), max(lc, 1), max(lt, 1)
    base = math.log(c / other * links + body_lc / max(body_c, 1) * c + math.e)
    return c / t * math.log(max(c / links * t / link_tags, 1.0)) / math.log(base)


def densities(tree: Tree, cut: list[bool]) -> tuple[list[float], list[float]]:
    """The density of every DOM node, and the sum of its children's; nodes that are cut have none."""
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)
    chars, links, count, link_count, total = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
    linked, control = [False] * n, [False] * n
    for i in range(1, n):
        linked[i] = linked[parents[i]] or tags[i] == "a"
        control[i] = control[parents[i]] or tags[i] in CONTROLS
    for piece in tree.pieces:
        if piece and not cut[piece[0]] and not control[piece[0]]:
            size = sum(map(len, piece[1].split()))
            chars[piece[0]] += size
            links[piece[0]] += size * linked[piece[0]]
    for i in range(n - 1, 0, -1):  # children come after their parents
        if not cut[i]:
            up = parents[i]
            chars[up] += chars[i]
            links[up] += links[i]
            count[up] += count[i] + 1
            link_count[up] += link_count[i] + (tags[i] == "a")
    dense = [0.0 if cut[i] else density(chars[i], count[i], links[i], link_count[i], chars[0], links[0]) for i in range(n)]
    for i in range(1, n):
        total[parents[i]] += dense[i]
    return dense, total


def main_text(html: str | None) -> str:
    """The main text: a line for each block, white space in it as single spaces; empty if there is none."""
    if not html:
        return ""
    tree = Tree()
    tree.read(html)
    tags, parents, cut = tree.tags, tree.parents, tree.cuts()
    n = len(tags)
    dense, total = densities(tree, cut)
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        if not cut[i] and total[best[i]] > total[best[parents[i]]]:
            best[parents[i]] = best[i]
    at, least = best[0], math.inf
    while at >= 0:
        least, at = min(least, dense[at]), parents[at]
    block = list(range(n))  # the block that a node is or stands in
    for i in range(1, n):
        if tags[i] not in BLOCK:
            block[i] = block[parents[i]]
    main = [False] * n
    for i in range(n):
        if not cut[i] and dense[i] >= least:
            main[block[best[i]]] = True
    around, outer = block[best[0]], 0
    while around:  # the outermost one
        if tags[around] in ("article", "main"):
            outer = around
        around = parents[around]
    around = outer
    near, linked, control = [False] * n, [False] * n, [False] * n
    near[around] = True
    for i in range(1, n):
        up = parents[i]
        main[i], near[i] = main[i] or main[up], near[i] or near[up]
        linked[i], control[i] = linked[up] or tags[i] == "a", control[up] or tags[i] in CONTROLS
    lines, now = [], []
    for piece in [*tree.pieces, None]:
        if piece is None:
            if now and (line := _line(now, main, linked, control))[0]:
                lines.append(line)
            now = []
        elif not cut[piece[0]] and (main[piece[0]] or near[piece[0]]):
            now.append(piece)
    while lines and not lines[-1][1] and lines[-1][0].startswith("\u00a9") and len(lines[-1][0]) <= COPYRIGHT:
        lines.pop()
    return "\n".join(line for line, _ in lines)


def _line(pieces: list[tuple[int, str]], main: list[bool], linked: list[bool], control: list[bool]) -> tuple[str, bool]:
    """The text of one block, or nothing if it is links beside the main text, and whether it is main text; controls only inside other text."""
    size = [sum(map(len, x.split())) for _, x in pieces]
    if sum(k for k, (i, _) in zip(size, pieces, strict=True) if control[i]) * 2 >= sum(size):
        size = [k for k, (i, _) in zip(size, pieces, strict=True) if not control[i]]
        pieces = [p for p in pieces if not control[p[0]]]
    line, own = " ".join("".join(x for _, x in pieces).split()), all(main[i] for i, _ in pieces)
    if pieces and not own and 3 * sum(k for k, (i, _) in zip(size, pieces, strict=True) if linked[i]) > sum(size):
        return "", own
    return line, own


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``(page_id, url, text, n_chars)``, a row for each row, from the whole html.

    A null or empty html, or one without main text, gives an empty text with 0 characters. Rows are read one by one, so
    repeated rows and null ids or urls need nothing; of nodes with equal sums the first in the page is taken. Broken markup is
    read as far as it goes, bytes that aren't UTF-8 as U+FFFD, and long pages are read whole, in time that grows with their length. An empty table gives an empty
    result. Other columns are not looked at.
    """
    tx.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x and x.decode("utf-8", "replace")) for x in tx.binaries(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
