"""Main text of web pages by wrapper induction.

Each page becomes a tree of blocks; runs of like siblings are folded into one node. The
trees of a host's pages are aligned by simple tree matching (the largest number of node
pairs that keeps labels, ancestry and order) and merged into one template, which counts
the pages of each node, and of each of its most frequent texts, with a few signatures of these
pages (the hash of a page's longest text, so copies of one article have one). A text that half of
the host's pages have at a node, and at least MIN_PAGES different articles, is constant: it
belongs to the template, wherever it stands. Other texts are in slots, where pages vary, or in
copies of one article.

Text is kept if it lies in a slot, outside blocks that are no article text by their element
or class (menus, headers, footers, sidebars, notices, adverts, forms, comments: these may vary
from page to page too). Where a page marks articles and they hold a third of what was kept or
more, only what lies inside of them stays; with less, they are teasers, and all slots stay.

Templates are merged inside each task before anything is shuffled, then by host and salt in
three steps, so a host with most pages is no large group.

Edge cases: null or empty html gives the empty text; rows with a null url share the host "";
hosts with under MIN_PAGES different articles have no constant nodes; unclosed elements end with
their parent; unknown character references stay as they are; repeated rows are kept. Elements
nested deeper than DEPTH count as part of the block at that depth, with their text in place.
Templates of over NODES nodes lose those on under a hundredth of their pages, which can't become
constant unless the host changes its layout. Columns of any other name don't matter.
"""

from __future__ import annotations

import json
import re
import zlib
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import ship
from tallyweave.shared import written

# Element names of the HTML standard by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
SILENT = set("script style noscript template iframe svg math canvas object video audio select option button textarea input head title".split())
AROUND = set("nav header footer aside form dialog menu".split())
# Words in class, id or role that mark blocks beside the article.
BESIDE = set(
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promoted promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget related recommended notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments commentlist respond disqus replies reply form search searchbox pagination pager toolbar skip".split()
)
# Words that may follow such a word in a name without a change of its meaning, and words
# before it that say what a block has beside it.
NEUTRAL = set(
    "left right top bottom main primary secondary wrapper wrap container inner outer box bar list items item links link area section block group row col panel posts post articles article "
    "stories buttons button icons icon policy text title body content form field results inline mobile desktop large small fixed sticky".split()
)
HAVING = set("has have no not with without is hide show toggle".split())
#: A start tag of the key ends an open element of these names, unless a block in between holds it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "td", "nav", "footer", "header", "aside"}

MIN_PAGES, SHARE = 3, 0.5
#: Templates beyond so many nodes lose those on under a hundredth of their pages.
NODES = 1000
#: Texts of a node that are counted.
TEXTS = 24
#: Levels of blocks that are told apart.
DEPTH = 150
#: Part of the kept text that marked articles must hold to be the page's article.
MARKED = 1 / 3
SPACES = re.compile(r"\s+")
BOGUS = re.compile(r"<!\[[^>]*(>|$)")


def marked(names: str) -> bool:
    """Whether a class, id or role says that a block stands beside the article. Whole names count: one
    that is such a word, ends with one, or goes on with neutral words after one; not `has-sidebar`,
    `with-header` or `social-science`."""
    for name in names.split():
        parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        if parts and parts[0] not in HAVING and (parts[-1] in BESIDE or (parts[0] in BESIDE and NEUTRAL.issuperset(parts[1:]))):
            return True
    return False


class Block:
    """An element with its blocks and texts in page order."""

    __slots__ = ("beside", "items", "label", "node", "tag")

    def __init__(self, tag: str, label: str, beside: bool):
        self.tag, self.label, self.beside, self.items, self.node = tag, label, beside, [], None


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Block("#page", "#page", False)
        self.open: list[Block] = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if tag == "br":
                self.handle_data(" ")
            return
        if self.open[-1].tag == "p":  # a paragraph ends where the next block begins
            self.open.pop()
        if tag in ENDS:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ENDS[tag]:
                    del self.open[k:]
                    break
                if self.open[k].tag in HOLDS:
                    break
        names = {k: v for k, v in attrs if v and k in ("class", "id", "role")}
        whole = " ".join(names.values())
        block = Block(tag, f"{tag}.{names.get('class', '')}#{names.get('id', '')}", tag in SILENT or tag in AROUND or marked(whole))
        if tag in ("body", "html", "article", "main"):  # page-wide marks don't make the whole page a side block
            block.beside = tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(re.findall(r"[a-z]+", whole.lower()))
            for above in self.open if tag == "main" else ():  # what holds the main part isn't beside it, whatever its name
                above.beside &= above.tag in SILENT or above.tag in AROUND
        above = self.open[-1]
        if len(self.open) > DEPTH and (not block.beside or above.beside or len(self.open) > 2 * DEPTH):
            block.items = above.items  # no block of its own: its text stands in the one above
            self.handle_data(" ")
            block.beside = above.beside
        else:
            above.items.append(block)
        if tag not in VOID:
            self.open.append(block)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE and self.open[-1].tag == tag and tag in ("svg", "object", "iframe", "div"):
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in INLINE:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        items = self.open[-1].items
        if items and isinstance(items[-1], str):
            items[-1] += data
        else:
            items.append(data)


def parse(html: str) -> Block:
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError):  # a declaration of no known kind is a comment up to its end
        if BOGUS.search(html):
            return parse(BOGUS.sub(" ", html))
    return reader.root


# A node of a template: [label, pages, texts, children, shape]; texts has the pages with each of its
# most frequent texts, by hash, and up to MIN_PAGES signatures of these pages.
def _node(label: str, n: int, texts: dict[int, tuple], children: list) -> list:
    return [label, n, texts, children, f"{label}({','.join(c[4] for c in children)})"]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def signature(block: Block) -> tuple[int, ...]:
    """The hash of the longest text of a page."""
    longest, todo = "", [block]
    while todo:
        for item in todo.pop().items:
            if not isinstance(item, str):
                if item.tag not in SILENT:
                    todo.append(item)
            elif len(item) > len(longest) or len(item) == len(longest) and item > longest:
                longest = item
    return (_hash(SPACES.sub(" ", longest).strip()),)


def tree(block: Block, mark: tuple[int, ...] | None = None) -> list:
    """The block's node; like neighbours are folded into one."""
    if block.node is not None:
        return block.node
    mark = signature(block) if mark is None else mark
    children: list = []
    for item in block.items:
        if isinstance(item, str):
            text = SPACES.sub(" ", item).strip()
            if not text:
                continue
            h = _hash(text)
            child = _node("#text", 1, {h: (1, mark)}, [])
        elif item.tag in SILENT:
            continue
        else:
            child = tree(item, mark)
        if children and children[-1][4] == child[4]:
            children[-1] = _fold(children[-1], child)
        else:
            children.append(child)
    block.node = _node(block.label, 1, {}, children)
    return block.node


def _fold(a: list, b: list) -> list:
    """Two like siblings of one page as one node."""
    return [a[0], a[1], {**a[2], **b[2]}, [_fold(x, y) for x, y in zip(a[3], b[3], strict=True)], a[4]]


def _counted(a: dict[int, tuple], b: dict[int, tuple]) -> dict[int, tuple]:
    """The texts of both, the most frequent ones if there are more than TEXTS."""
    out = dict(a)
    for h, (n, marks) in b.items():
        m, others = out.get(h, (0, ()))
        out[h] = (m + n, tuple(sorted({*others, *marks})[:MIN_PAGES]))
    if len(out) > TEXTS:
        out = dict(sorted(out.items(), key=lambda x: (-x[1][0], x[0]))[:TEXTS])
    return out


_sizes: dict[tuple[str, str], int] = {}


def matched(a: list, b: list) -> int:
    """Simple tree matching: the most node pairs of an order-keeping mapping."""
    if a[0] != b[0]:
        return 0
    key = (a[4], b[4])
    if key not in _sizes:
        if len(_sizes) > 200_000:
            _sizes.clear()
        _sizes[key] = 1 + _align(a[3], b[3])[-1][-1]
    return _sizes[key]


def _align(left: list, right: list) -> list[list[int]]:
    m = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + matched(x, y))
    return m


def pairs(left: list, right: list) -> list[tuple[int | None, int | None]]:
    """The children of two nodes in a common order, matched ones together."""
    if [x[4] for x in left] == [y[4] for y in right]:
        return [(k, k) for k in range(len(left))]
    m, i, j, out = _align(left, right), len(left), len(right), []
    while i or j:
        if i and j and (w := matched(left[i - 1], right[j - 1])) and m[i][j] == m[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif j and m[i][j] == m[i][j - 1]:
            j -= 1
            out.append((None, j))
        else:
            i -= 1
            out.append((i, None))
    return out[::-1]


def merge(a: list, b: list) -> list:
    """The template of the pages of both."""
    children = [a[3][i] if j is None else b[3][j] if i is None else merge(a[3][i], b[3][j]) for i, j in pairs(a[3], b[3])]
    return _node(a[0], a[1] + b[1], _counted(a[2], b[2]), children)


def _count(node: list) -> int:
    return 1 + sum(map(_count, node[3]))


def _prune(node: list, least: float) -> list:
    return _node(*node[:3], [_prune(c, least) for c in node[3] if c[1] >= least])


def merged(a: list | None, b: list) -> list:
    out = b if a is None else merge(a, b)
    return _prune(out, out[1] / 100) if _count(out) > NODES else out


def _pack(node: list) -> list:
    return [node[0], node[1], [[h, n, *marks] for h, (n, marks) in node[2].items()], list(map(_pack, node[3]))]


def _unpack(node: list) -> list:
    return _node(node[0], node[1], {h: (n, tuple(marks)) for h, n, *marks in node[2]}, list(map(_unpack, node[3])))


def dumps(node: list) -> str:
    return json.dumps(_pack(node), ensure_ascii=False, separators=(",", ":"))


def loads(text: str) -> list:
    return _unpack(json.loads(text))


def _texts(block: Block, node: list | None, pages: int, inside: bool, tag: str, out: list[tuple[str, bool]]) -> None:
    """Appends the texts of slots below `block`, and whether an element `tag` holds them; `node` is
    the template's node for the block."""
    children, shapes = [], []  # the block's items in runs of like ones, as tree() folds them
    for item in block.items:
        if isinstance(item, str):
            text = SPACES.sub(" ", item).strip()
            if text:
                children.append((item, text, "#text()"))
        elif item.tag not in SILENT:
            own = tree(item)
            children.append((item, own, own[4]))
    folded: list = []
    for _, own, shape in children:
        if not folded or folded[-1][4] != shape:
            folded.append(_node("#text", 1, {}, []) if isinstance(own, str) else own)
        shapes.append(len(folded) - 1)
    to = {j: node[3][i] for i, j in pairs(node[3], folded) if i is not None and j is not None} if node else {}
    for (item, own, _), k in zip(children, shapes, strict=True):
        known = to.get(k)
        if isinstance(own, str):
            n, marks = known[2].get(_hash(own), (0, ())) if known else (0, ())
            if n < SHARE * pages or len(marks) < MIN_PAGES:
                out.append((own, inside))
        elif not item.beside:
            _texts(item, known, pages, inside or item.tag == tag, tag, out)


def main_text(html: str, template: list | None = None) -> str:
    """The page's main text: its blocks in page order, joined by spaces."""
    page = parse(html)
    for tag in ("article", "main"):
        out: list[tuple[str, bool]] = []
        _texts(page, template, template[1] if template else 0, False, tag, out)
        marked = [text for text, inside in out if inside]
        if sum(map(len, marked)) >= MARKED * sum(len(text) for text, _ in out):
            return " ".join(marked)
    return " ".join(text for text, _ in out)


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", url or "", re.I)
    return m[1].lower() if m else ""


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) of all hosts, from all pages."""
    ship(pages.sparkSession)

    def inside(batches):  # one template for each host and task (or 5,000 hosts)
        own: dict[str, list] = {}
        for b in batches:
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = host(url)
                own[h] = merged(own.get(h), tree(parse(html)))
                if len(own) > 5000:
                    yield pa.RecordBatch.from_pydict({"host": list(own), "template": list(map(dumps, own.values()))})
                    own = {}
        if own:
            yield pa.RecordBatch.from_pydict({"host": list(own), "template": list(map(dumps, own.values()))})

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        out = None
        for t in sorted(rows.template):
            out = merged(out, loads(t))
        return pd.DataFrame({"host": [rows.host.iloc[0]], "template": [dumps(out)]})

    made = pages.select("url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(inside, "host string, template string")
    for salts in (4096, 64, 1):
        salted = made.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(salts)))
        made = salted.groupBy("host", "salt").applyInPandas(lambda rows: together(rows), "host string, template string")
    return made


#: Templates of all hosts up to so many bytes are sent to every executor; more are joined by host.
BROADCAST = 32_000_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page."""
    ship(pages.sparkSession)
    made = written(templates(pages), "html-templates")
    size = made.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    made = F.broadcast(made) if size <= BROADCAST else made
    at = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), at.alias("host"))
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string"

    def run(batches):
        known: dict[str, list] = {}
        for b in batches:
            texts = []
            for html, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if t is not None and t not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[t] = loads(t)
                texts.append(main_text(html, known[t] if t is not None else None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.join(made, "host", "left").select("page_id", "url", "html", "template").mapInArrow(run, schema)
