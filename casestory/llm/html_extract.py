"""HTML extraction by consensus host paths.

Each page's containers are scored by the text that stands in them, less the part in links. The
containers vote, with their score relative to the page's best, for their path of tags and classes
(digits generalised) from the root; votes are summed per host in Spark. Then every page is
extracted again at its host's winning path, or at its own best container where it has no such
element. Menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments
inside it are left out.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.llm.common import join_groups, stash

# Element and class names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th "
                   "thead tr ul".split())
CONTAINERS = frozenset("body article main section div td blockquote center form aside nav header footer ul ol".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg math canvas textarea select option button audio video datalist map".split())
ASIDES = frozenset("nav header footer aside form menu dialog search fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert newsletter subscribe subscription signup sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "topbar comment comments commentlist respond replies disqus share sharing social related recommended popup modal overlay widget pagination "
    "pager toolbar login search form".split())
HEADLINES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag ends an open element of these kinds, up to the nearest of the others.
ENDS = {"li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
        "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
        "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
        "option": (frozenset(("option",)), frozenset(("select",)))}
SEMANTIC = 2.5


class Node:
    __slots__ = ("tag", "parent", "path", "label", "words", "role", "blocks", "chars", "linked", "links", "score", "aside", "last")

    def __init__(self, tag, parent, words, label, role):
        self.tag, self.parent, self.words, self.label, self.role = tag, parent, words, label, role
        #: the chain of labels from the root, hashed so that deep pages stay small; inline elements add nothing
        self.path = xxhash.xxh3_128_hexdigest((parent.path if parent else "") + ">" + label) if tag in CONTAINERS else parent.path if parent else ""
        self.blocks: list = []
        self.chars = self.linked = self.links = 0
        self.score, self.aside, self.last = 0.0, False, 0


#: A comment, a declaration, or a tag with its attributes; quoted values may hold '>'.
TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NAMED = re.compile(r"\b(?:class|id|role)\s*=", re.I)
#: Elements that can stand in a head; any other start tag, and text, ends a head without end tag.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HEAD = frozenset(("head",))
P = frozenset(("p",))
NOT_P = BLOCKS - P


def named(tag: str, attributes: str):
    """Words of class and id, the label for paths (digits generalised), the role."""
    a: dict[str, str] = {}
    for k, v1, v2, v3 in ATTRIBUTE.findall(attributes):
        a.setdefault(k.lower(), unescape(v1 or v2 or v3))
    names = a.get("class", "").split()
    words = frozenset(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join([*names, a.get("id", "")])).lower()))
    return words, ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in names})]), a.get("role", "").lower()


class Page:
    """A page as its elements in order and its text blocks (element, text, characters in links)."""

    def __init__(self, html: str):
        self.stack: list[Node] = []
        self.nodes: list[Node] = []
        self.blocks: list[tuple[Node, str, int]] = []
        self.held: list[str] = []
        self.held_linked = 0
        #: open unseen elements; depth at which a link is open (-1: none); open named inline elements
        self.hidden, self.link, self.inline = 0, -1, 0
        self._parse(html)
        self._flush()
        for node in self.nodes:
            node.last = node.last or len(self.nodes)

    def _parse(self, html: str):
        at = 0
        while True:
            m = TAG.search(html, at)
            end = m.start() if m else len(html)
            if end > at and self.stack and self.stack[-1].tag == "head" and not html[at:end].isspace():
                self._close(HEAD)
            if end > at and not self.hidden:
                text = html[at:end]
                self.held.append(unescape(text) if "&" in text else text)
                if self.link >= 0:
                    self.held_linked += len(text.strip())
            if not m:
                return
            at = m.end()
            name = m[2]
            if name is None:
                continue
            tag = name.lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:  # its text ends at its end tag, or with the page
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                at = close.start() if close else len(html)

    def _flush(self):
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                at = self.stack[-1] if self.stack else None  # that is a named inline element at times
                self.blocks.append((at, text, min(self.held_linked, len(text))))
            self.held, self.held_linked = [], 0

    def _pop_to(self, depth: int):
        for node in self.stack[depth:]:
            node.last = len(self.nodes)
            if node.tag not in BLOCKS:
                self.hidden -= node.tag in UNSEEN
                self.inline -= node.tag not in UNSEEN
        del self.stack[depth:]
        if depth < self.link:
            self.link = -1

    def _close(self, tags, until=frozenset()):
        """Close the nearest open element of ``tags`` and all in it."""
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag in tags:
                self._pop_to(depth)
                return
            if self.stack[depth].tag in until:
                return

    def _start(self, tag: str, attributes: str):
        if tag == "body" or self.stack and self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self._close(HEAD)
        if tag in BLOCKS:
            self._flush()
            if tag in ENDS:
                self._close(*ENDS[tag])
            elif tag != "html":
                self._close(P, NOT_P)
        elif tag == "br":
            self.held.append(" ")
            return
        elif tag == "a":
            self.link = len(self.stack)
            return
        if tag in VOID:
            return
        words, label, role = frozenset(), tag, ""
        if "=" in attributes and NAMED.search(attributes):
            words, label, role = named(tag, attributes)
        elif tag not in BLOCKS and tag not in UNSEEN:
            return  # an inline element without a name says nothing
        node = Node(tag, self.stack[-1] if self.stack else None, words, label, role)
        self.stack.append(node)
        self.nodes.append(node)
        if tag not in BLOCKS:
            self.hidden += tag in UNSEEN
            self.inline += tag not in UNSEEN

    def _end(self, tag: str):
        if tag in BLOCKS:
            self._flush()
            if tag != "html" and tag != "body":
                if self.stack and self.stack[-1].tag == tag:
                    self._pop_to(len(self.stack) - 1)
                else:
                    self._close((tag,))
        elif tag == "a":
            self.link = -1
        elif self.inline or tag in UNSEEN:
            self._close((tag,), BLOCKS)


def analysed(html: str | None) -> Page:
    """The page with its asides marked and its containers scored."""
    page = Page(html or "")
    for at, text, linked in page.blocks:
        node = at
        while node is not None:
            node.chars += len(text)
            node.linked += linked
            node.links += linked > 0
            node = node.parent
    total = sum(len(b[1]) for b in page.blocks) or 1
    for node in page.nodes:  # parents come first
        own = node.tag in ASIDES or node.role in ASIDE_ROLES or (
            bool(node.words & ASIDE_WORDS) and node.tag not in ("html", "body", "article", "main") and node.chars <= 0.6 * total) or (
            "comment" in node.words or "comments" in node.words) and node.chars <= 0.6 * total or (
            node.tag in ("ul", "ol", "div", "section", "table", "p") and node.links >= 3 and node.linked > 0.8 * node.chars)
        node.aside = bool(own or (node.parent and node.parent.aside))
    for at, text, linked in page.blocks:
        if at is None or at.aside:
            continue
        points = (1 + min(len(text) / 100, 10) + text.count(",") * 0.5) * (1 - linked / len(text)) * (1 if len(text) >= 25 or at.tag in HEADLINES else 0.2)
        holder = at if at.tag in CONTAINERS else next(_up(at.parent), None)
        for share, node in zip((1.0, 0.5, 0.25), _up(holder) if holder else ()):
            node.score += points * share
    for node in page.nodes:
        if node.score:
            node.score *= (1 - node.linked / max(node.chars, 1)) * (SEMANTIC if node.tag in ("article", "main") or node.role in ("main", "article") else 1)
    return page


def _up(node):
    while node is not None:
        if node.tag in CONTAINERS:
            yield node
        node = node.parent


def votes(page: Page) -> dict[str, float]:
    """Path -> score relative to the page's best container."""
    best = max((n.score for n in page.nodes), default=0.0)
    out: dict[str, float] = {}
    if best > 0:
        for n in page.nodes:
            if n.score > 0:
                out[n.path] = max(out.get(n.path, 0.0), n.score / best)
    return out


def main_text(page: Page, path: str | None) -> str:
    """Blocks in the elements at ``path`` (else in the best container, else on the page), joined."""
    chosen, until = [], -1
    for k, n in enumerate(page.nodes):
        if path is not None and n.path == path and n.tag in CONTAINERS and k >= until and not n.aside:
            chosen.append(n)
            until = n.last
    if not chosen:
        best = max(page.nodes, key=lambda n: n.score, default=None)
        chosen = [best] if best is not None and best.score > 0 else []
    inside = {id(n) for n in chosen}

    def kept(at):
        while at is not None:
            if id(at) in inside:
                return True
            at = at.parent
        return not chosen
    return "\n\n".join(text for at, text, _ in page.blocks if not (at and at.aside) and kept(at))


def host_of(url):
    """Lower-case host of a URL column; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, n``: each host's winning path (most votes, then smallest) and its number of pages
    (``pages``: host, html)."""
    def run(batches):
        for batch in batches:
            out = []
            for host, html in zip(batch.column("host"), batch.column("html")):
                found = votes(analysed(html.as_py()))
                out += [(host.as_py(), p, v, 0) for p, v in found.items()]
                out.append((host.as_py(), "", 0.0, 1))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()),
                                              pa.array(cols[3], pa.int64())], ["host", "path", "vote", "n"])
    sums = (pages.select("host", "html").mapInArrow(run, "host string, path string, vote double, n long")
            .groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"), F.sum("n").alias("n")))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("vote", "path")).alias("path"), F.sum("n").alias("n"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``id, url, text``.

    Null or empty html, and pages without main text, give ''. A null url counts as a host of its
    own. Hot hosts vote by pre-aggregated sums and get their path from a small broadcast table.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    paths = stash(host_paths(rows), "host-paths")
    met = join_groups(rows, paths, ["host"], "n", how="left")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(analysed(html.as_py()), path.as_py() or None) for html, path in zip(batch.column("html"), batch.column("path"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])
    return met.select("id", "url", "html", "path").mapInArrow(run, f"id {kind}, url string, text string")
