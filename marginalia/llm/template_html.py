"""HTML extraction with site template removal.

A page becomes a tree of elements. Every block subtree gets a hash of its tags, classes and text; Spark counts, for each host, with how
many different main texts a hash occurs, so that copies of a page count once, and subtrees that recur across many of them are deleted
before the text is read, wherever on the page they are. A list that is nearly all links is hashed by its shape alone, so a menu whose
links differ from page to page recurs too. What a single page gives away is deleted as well: elements and roles that mean menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments, and class names that say so. If article or main elements
are left, their text in page order is the text, with the h1 before them if they have none; else that of the body.

Names. A whole class or id that is a noise name counts anywhere; a part of one outside articles as its last part (site-footer), inside them as any part, but only where it
means adverts, comments, subscriptions or further reading (related-articles). No name deletes an element with half of the text around it, that of the article or, where there is none, of the
page; a form with paragraphs isn't deleted either then. A name never deletes what holds a main element (names of comments do) or, but for names of page headers and
footers, an h1.

Paragraphs, headings and other blocks of text need half of the host's main texts; inside an article they never count as
template, so that a sentence that many articles share stays. A container that holds more than half of its article's text stays, and a
page whose whole text would go keeps it.

Templates of at most BROADCAST_HASHES hashes travel with the tasks; more meet the pages in a join by
host, hash and salt, and each page gets those that it has.

Defined results: null html is empty and gives "", 0; a null url has host "". Repeated rows count once and each gets its row. Markup of any depth and
length is read in linear time and memory. Broken markup is read as browsers do in outline: unclosed elements end with their parent, stray end tags are
ignored, scripts, styles and the like go up to their end tag whatever they hold. Without pages there are no rows. Further columns are left out.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marginalia.llm.common import settle, text_batches
from marginalia.llm.url_cascade import host_of

#: A container is a template from LEAST_PAGES main texts of its host on, if they are LEAST_SHARE of the host's or ENOUGH_PAGES; a block of
#: text from LEAST_PAGES on, if they are TEXT_SHARE of the host's, whatever its size.
LEAST_PAGES, LEAST_SHARE, ENOUGH_PAGES, TEXT_SHARE = 3, 0.02, 20, 0.5
BROADCAST_HASHES, SALTS = 200_000, 64
#: A subtree with at least this share of its characters in links, and LEAST_LINKS of them, is hashed by shape.
LINK_SHARE, LEAST_LINKS = 0.8, 2

# Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TO_END = frozenset("script style textarea title xmp".split())
RAW = RAW_TO_END | frozenset("noscript template iframe svg math object audio video canvas noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption td th address".split())
CONTAINER = frozenset("aside center details div dl fieldset figure footer form header menu nav ol section table ul".split())
NOISE = frozenset("head nav footer aside form button select dialog menu fieldset".split())
PARAGRAPH_ENDS = BLOCK - {"body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
PARAGRAPH_WALLS = ("td", "th", "button", "table")
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
    disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related
    recommended recommendations reply replies respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription
    toolbar topbar widget widgets""".split()
)
#: Names of the frame of a page, which may hold an h1 of the site; and last parts of names that say nothing.
FRAME_NAMES = frozenset("footer header masthead nav navbar navigation sidebar toolbar topbar".split())
COMMENT_NAMES = frozenset("comment comments commentlist respond".split())
#: Names that, as any part of a class or id, mean something beside the text even inside an article.
ASIDE_NAMES = COMMENT_NAMES | frozenset("ad ads advert adverts advertisement adsense newsletter promo promotion recommended recommendations related share sharing signup sponsor sponsored sponsors subscribe".split())
EMPTY_PARTS = frozenset("area bar block body box container content inner list outer panel section wrap wrapper".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAMED = re.compile(r"class|id|role|hidden|style|itemprop", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none")
_NO_ATTRIBUTES: dict[str, str] = {}


class Node:
    __slots__ = ("attributes", "children", "number", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None, number: int) -> None:
        self.tag, self.attributes, self.parent, self.number = tag, attributes, parent, number
        self.children: list[Node | str] = []


def _attributes(raw: str) -> dict[str, str]:
    if not _NAMED.search(raw):
        return _NO_ATTRIBUTES
    return {k.lower(): entities.unescape((v or "").strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(raw))}


class _Open:
    """The stack of open elements, with the places of each tag and of blocks in it."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.blocks = [root], {root.tag: [0]}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def first_after(self, place: int, tags: set[str]) -> int | None:
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect.bisect_right(p, place)) < len(p)]
        return min(found, default=None)


def parse(html: str) -> list[Node]:
    """All elements, parents before children; the first is the root."""
    root = Node("html", _NO_ATTRIBUTES, None, 0)
    nodes, here, at, endless = [root], _Open(root), 0, set()
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            start = len(html)
        if start > at:
            here.stack[-1].children.append(html[at:start])
        at = start
        if at == len(html):
            break
        if html.startswith("<!--", at):
            quick = next((at + len(q) for q in ("<!-->", "<!--->") if html.startswith(q, at)), None)
            end = html.find("-->", at + 4)
            at = quick or (end + 3 if end >= 0 else len(html))
            continue
        if html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            here.stack[-1].children.append(entities.escape(html[at + 9 : end if end >= 0 else len(html)]))
            at = end + 3 if end >= 0 else len(html)
            continue
        if html.startswith(("<!", "<?", "</"), at) and not html[at + 2 : at + 3].isalpha() or html.startswith("<!", at):
            end = html.find(">", at)
            at = end + 1 if end >= 0 else len(html)
            continue
        m = _TAG.match(html, at)
        if not m:
            here.stack[-1].children.append("<")
            at += 1
            continue
        at = m.end()
        closing, tag, raw = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        tag = tag.lower()
        if closing:
            place = here.last(tag)
            if place > 0 and (tag in BLOCK or place > here.blocks[-1]):  # an inline end tag doesn't close blocks
                here.cut(place)
            continue
        if tag in RAW:
            if raw.endswith("/") and tag not in RAW_TO_END or tag in endless:
                continue
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            if end:
                at = end.end()
            elif tag in RAW_TO_END:
                at = len(html)
            else:
                endless.add(tag)
            continue
        if tag == "html":
            continue
        if tag == "body":
            here.cut(1)
        if tag in PARAGRAPH_ENDS and (place := here.last("p")) > here.last(*PARAGRAPH_WALLS):
            here.cut(place)
        if tag in SIBLING_ENDS and (place := here.first_after(here.last(*SCOPE[tag]), SIBLING_ENDS[tag])):
            here.cut(place)
        node = Node(tag, _attributes(raw), here.stack[-1], len(nodes))
        here.stack[-1].children.append(node)
        nodes.append(node)
        if tag not in VOID and not (raw.endswith("/") and tag not in BLOCK):
            here.push(node)
    return nodes


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or bool(node.attributes) and (node.attributes.get("role") == "main" or "articleBody" in node.attributes.get("itemprop", ""))


class Page:
    """A parsed page with what is known of every element by its number, from one pass down and one up."""

    def __init__(self, html: str) -> None:
        self.nodes = parse(html)
        n = len(self.nodes)
        self.in_main = [False] * n  # below a main element
        self.holds_main, self.holds_h1, self.links = [False] * n, [False] * n, [0] * n
        self.chars, self.linked = [0] * n, [0] * n  # of text below, and of that inside links
        self.paragraphs, self.most = [0] * n, [0] * n  # p elements below; characters of the outermost main element around
        for node in self.nodes:
            if node.parent is not None:
                self.in_main[node.number] = self.in_main[node.parent.number] or _is_main(node.parent)
        for node in reversed(self.nodes):
            i = node.number
            self.holds_main[i] = self.holds_main[i] or _is_main(node)
            self.holds_h1[i] = self.holds_h1[i] or node.tag == "h1"
            self.paragraphs[i] += node.tag == "p"
            self.chars[i] += sum(len(c) - c.count(" ") for c in node.children if isinstance(c, str))
            if node.tag == "a":
                self.linked[i], self.links[i] = self.chars[i], 1
            if node.parent is not None:
                p = node.parent.number
                self.holds_main[p] = self.holds_main[p] or self.holds_main[i]
                self.holds_h1[p] = self.holds_h1[p] or self.holds_h1[i]
                self.chars[p] += self.chars[i]
                self.linked[p] += self.linked[i]
                self.links[p] += self.links[i]
                self.paragraphs[p] += self.paragraphs[i]
        for node in self.nodes:
            if (up := node.parent) is not None:
                self.most[node.number] = self.most[up.number] or (self.chars[up.number] if _is_main(up) else 0)

    def is_most(self, node: Node) -> bool:
        """Whether the element has at least half of the text that it would be deleted from: that of the outermost main element around it, or, on a page without any or
        around one, of the page. Beside a main element nothing is."""
        i = node.number
        if self.in_main[i]:
            return 2 * self.chars[i] >= self.most[i]
        return (self.holds_main[i] or not self.holds_main[0]) and 2 * self.chars[i] >= self.chars[0] > 0

    def is_noise(self, node: Node) -> bool:
        i, in_main = node.number, self.in_main[node.number]
        if node.tag in ("html", "body", "main"):
            return False
        if node.tag in NOISE and not (node.tag in ("form", "fieldset") and (self.holds_main[i] or self.paragraphs[i] and self.is_most(node))):
            return True
        if node.tag == "header" and not in_main and not self.holds_main[i]:
            return True
        if not node.attributes:
            return False
        role = node.attributes.get("role", "").lower()
        if (role in NOISE_ROLES and not self.holds_main[i]) or "hidden" in node.attributes or node.attributes.get("aria-hidden") == "true" or _HIDDEN.search(node.attributes.get("style", "")):
            return True
        names = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split()
        whole = NOISE_NAMES & {x.lower() for x in names}
        if in_main or node.tag == "article":
            whole -= {"header"}
        if whole and not (self.holds_main[i] and node.tag != "article" and not whole & COMMENT_NAMES) and not (self.holds_h1[i] and not whole & FRAME_NAMES) and not self.is_most(node):
            return True
        if in_main:
            named = {p.lower() for name in names for p in _PART.findall(name)} & ASIDE_NAMES
            return bool(named) and 2 * self.chars[i] < self.most[i] and not self.holds_h1[i]
        if 2 * self.chars[i] >= self.chars[0]:
            return False
        for name in names:
            parts = [p.lower() for p in _PART.findall(name)]
            while len(parts) > 1 and parts[-1] in EMPTY_PARTS:
                parts.pop()
            if parts and parts[-1] in NOISE_NAMES and not (self.holds_main[i] and parts[-1] not in COMMENT_NAMES) and not (self.holds_h1[i] and parts[-1] not in FRAME_NAMES):
                return True
        return False

    def hashes(self) -> list[int]:
        """A hash of tag, classes and everything below for every element; of the shape alone where nearly everything is links."""
        found, shapes = [0] * len(self.nodes), [""] * len(self.nodes)
        for node in reversed(self.nodes):
            i = node.number
            name = f"{node.tag}\x01{node.attributes.get('class', '')}\x01{node.attributes.get('id', '')}" if node.attributes else node.tag
            inner = dict.fromkeys(shapes[c.number] for c in node.children if isinstance(c, Node))
            shapes[i] = xxhash.xxh3_64_hexdigest(f"{name}({','.join(inner)})")
            if self.links[i] >= LEAST_LINKS and self.linked[i] >= LINK_SHARE * self.chars[i]:
                found[i] = xxhash.xxh3_64_intdigest("links\x02" + shapes[i]) - (1 << 63)
                continue
            parts = [name, *(" ".join(entities.unescape(c).split()) if isinstance(c, str) else str(found[c.number]) for c in node.children)]
            found[i] = xxhash.xxh3_64_intdigest("\x00".join(p for p in parts if p)) - (1 << 63)
        return found

    def candidates(self) -> Iterator[Node]:
        """Elements that may be templates: blocks with text that hold no main element; inside one, containers."""
        for node in self.nodes[1:]:
            if self.chars[node.number] and node.tag != "body":
                if node.tag in CONTAINER if self.in_main[node.number] else node.tag in BLOCK and not self.holds_main[node.number]:
                    yield node

    def template_hashes(self) -> set[tuple[int, bool]]:
        """(hash, whether it is a block of text)"""
        hashes = self.hashes()
        return {(hashes[n.number], n.tag in TEXT_BLOCK) for n in self.candidates()}

    def deleted(self, templates: set[int] | frozenset[int]) -> set[int]:
        if not templates:
            return set()
        hashes = self.hashes()
        return {n.number for n in self.candidates() if hashes[n.number] in templates and 2 * self.chars[n.number] <= (self.most[n.number] or self.chars[0] * 2)}

    def blocks(self, node: Node, gone: set[int]) -> list[str]:
        out: list[str] = []
        line: list[str] = []

        def end() -> None:
            words = entities.unescape("".join(line)).split()
            line.clear()
            if words:
                out.append(" ".join(words))

        todo: list[Node | str | None] = [node]
        while todo:
            at = todo.pop()
            if at is None:
                end()
            elif isinstance(at, str):
                line.append(at)
            elif at is node or not (at.number in gone or self.is_noise(at)):
                if at.tag == "br":
                    line.append(" ")
                if at.tag in BLOCK:
                    end()
                    todo.append(None)
                todo.extend(reversed(at.children))
        end()
        return out

    def read(self, gone: set[int]) -> list[str]:
        """Blocks of the outermost main elements, behind the last h1 before them if they have none; of the body where there are none."""
        mains, heading, todo = [], None, [self.nodes[0]]
        while todo:
            node = todo.pop()
            if node.number and (node.number in gone or self.is_noise(node)):
                continue
            if _is_main(node):
                mains.append(node)
                continue
            if node.tag == "h1" and not mains:
                heading = node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
        if not mains:
            return self.blocks(self.nodes[0], gone)
        first = [heading] if heading is not None and not any(self.holds_h1[m.number] for m in mains) else []
        return [block for m in [*first, *mains] for block in self.blocks(m, gone)]

    def text(self, templates: set[int] | frozenset[int] = frozenset()) -> str:
        gone = self.deleted(templates)
        return "\n".join(self.read(gone) or (self.read(set()) if gone else []))


def template_hashes(html: str) -> set[int]:
    return {h for h, _ in Page(html).template_hashes()}


def main_text(html: str, templates: set[int] | frozenset[int] = frozenset()) -> str:
    return Page(html).text(templates)


def find_templates(pages: DataFrame) -> DataFrame:
    """(host, hash): subtrees with enough main texts of their host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found, kinds, texts = [], [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                some = [(None, False), *page.template_hashes()]  # None stands for the page itself
                found.extend(h for h, _ in some)
                kinds.extend(k for _, k in some)
                hosts.extend([host] * len(some))
                texts.extend([xxhash.xxh3_64_intdigest(page.text().encode("utf-8", "surrogatepass")) - (1 << 63)] * len(some))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(kinds, pa.bool_()), pa.array(texts, pa.int64())], ["host", "hash", "is_text", "main"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, hash long, is_text boolean, main long").distinct()
    counts = settle(seen.groupBy("host", "hash", "is_text").agg(F.count(F.lit(1)).alias("n")).filter(F.col("hash").isNull() | (F.col("n") >= LEAST_PAGES)))
    totals = counts.filter("hash is null").select("host", F.col("n").alias("pages"))
    part = lambda share, enough: F.least(F.lit(share) * F.col("pages"), F.lit(enough))
    least = F.when(F.col("is_text"), F.lit(TEXT_SHARE) * F.col("pages")).otherwise(part(LEAST_SHARE, ENOUGH_PAGES))
    return counts.filter(F.col("hash").isNotNull()).join(totals, "host").filter(F.col("n") >= least).select("host", "hash").distinct()


def _own_templates(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """rows with templates: those of the host that occur on a page of this page_id and url."""
    rows = rows.withColumn("_key", F.xxhash64("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, found = [], [], []
            for page, host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = template_hashes(html or "")
                ids.extend([page] * len(some))
                hosts.extend([host] * len(some))
                found.extend(some)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(found, pa.int64())], ["_key", "host", "hash"])

    seen = rows.select("_key", "host", "html").mapInArrow(run, "_key long, host string, hash long")
    seen = seen.withColumn("salt", F.pmod("_key", F.lit(SALTS)).cast("int"))
    salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = seen.join(salted, ["host", "hash", "salt"]).groupBy("_key", "host").agg(F.collect_set("hash").alias("templates"))
    return rows.join(own, ["_key", "host"], "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    text_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    templates = settle(find_templates(rows))
    known: dict[str, set[int]] = {}
    if templates.count() <= BROADCAST_HASHES:
        for row in templates.collect():
            known.setdefault(row["host"], set()).add(row["hash"])
        rows = rows.withColumn("templates", F.lit(None).cast("array<bigint>"))
    else:
        rows = _own_templates(rows, templates)
    rows = rows.select("page_id", "url", "host", "html", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html or "", set(own) if own else known.get(host, frozenset())) for host, html, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType())]))
