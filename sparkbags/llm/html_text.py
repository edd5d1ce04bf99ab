"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree.  A node is a path of elements with their
presentation (tag, class, id); the contents it has on a page are the texts directly in
it and its branches, each branch as one content (a hash of all that is below).  So a
page adds as many contents as it has texts and nodes, however deep it is.  A node's
importance is the mean, over its contents on the host's different pages (copies of a
page count once), of 1 - log(pages with the content) / log(pages with the node): near 0
for what stands on page after page, 1 for what differs; a node seen on one page has
importance 1.  Nodes on at least ``LEAST_PAGES`` pages whose importance is below
``LEAST`` are removed with all that is below them.  Plain text elements (paragraphs,
headings, list items without class or id) are never nodes of their own: a paragraph
that several articles share is content.

All branches of a page are in the tree.  Two priors stand beside the entropy.  An
element whose tag, role, class or id says that it is no content (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) is left out, for an advert
that differs on every page has importance 1; but not if it holds the page's main or
largest article element, or most of the page's text: then the tree decides.  A class or
id says so if all its words do or are words for parts of a page ("site-footer", but not
"ad-hoc" or "related-work").  If a page has an article or main element, what stands
outside is read only if the tree vouches for it: some node around it, without such a
name, is on at least ``LEAST_PAGES`` pages and has an importance of ``MOST`` or more.
Scripts, styles and controls are no text.

The blocks that are left, in page order, are the text.  Character references are
decoded; white space (a line break element too) becomes one space.

The tree is counted with grouped aggregates that combine before they shuffle; what
reaches the pages is the list of removed nodes of each host, which are those of its
templates.  A page takes time in proportion to its length.  Null and empty pages have
empty texts; null urls are one host.  Rows with equal or null keys are pages of their
own; an empty table has no rows.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, settle, tidied

LEAST = 0.1
MOST = 0.9
LEAST_PAGES = 8
_SLICE = 1 << 20

# Fixed values of HTML: kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("caption dd dt body html legend li optgroup option tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
#: A start tag ends the nearest open element of the first set, not beyond the second.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
PLAIN = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre tr tbody thead tfoot figcaption caption summary".split())
# Fixed values of this extractor: what is no content.
NO_TEXT = set("head script style noscript template button select textarea input iframe object embed applet canvas svg datalist noembed noframes".split())
NO_CONTENT = set("nav footer aside form dialog menu".split())
NO_ROLE = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NO_NAME = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices sidebar menu navbar nav navigation breadcrumb breadcrumbs comment comments disqus respond share sharing social related recommended newsletter subscribe signup popup modal widget footer pagination pager toolbar masthead".split())
NO_NAME_OUTSIDE = {"header"}
#: Words for parts of a page, which a name of no content may hold besides.
PARTS = set("area bar block body bottom box btn button buttons card cell col column container content entry fixed form foot head inner item items label layout left link links list main message module outer page panel post posts right row section site slot small sticky top unit view wrap wrapper".split())

_START = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I) for tag in RAW}


def _tags(page: str):
    """(start, end, whether it ends an element, tag, attributes) of each tag; comments
    and declarations have no tag.  A tag that the page's end cuts off runs up to there."""
    at = 0
    while m := _START.search(page, at):
        if not m[2]:
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, m.end())
            at = len(page) if end < 0 else end + len(mark)
            yield m.start(), at, False, "", ""
            continue
        end = _REST.match(page, m.end()).end()
        if end < len(page) and page[end] != ">":  # a quote that nothing closes
            end = page.find(">", end)
        at = len(page) if end < 0 or end >= len(page) else end + 1
        if at == len(page) and (end < 0 or end >= len(page)):
            yield m.start(), at, False, "", ""
            return
        tag = m[2].lower()
        at = (yield m.start(), at, bool(m[1]), tag, page[m.end() : end]) or at


def _no_content(names: str, outside: bool) -> bool:
    """Whether some class or id among ``names`` says that an element is no content."""
    for name in names.split():
        words = {x.lower() for x in _NAME.findall(name)}
        bad = words & NO_NAME or (outside and words & NO_NAME_OUTSIDE)
        if bad and words <= NO_NAME | NO_NAME_OUTSIDE | PARTS:
            return True
    return False


class Page:
    """A page's nodes and blocks.

    ``nodes``: place of the node around (-1: none), number, whether an article or main
    element is at or above it, whether it may be in the tree.  ``blocks``: place of the
    node, inside an article or main element, text, left out for a name, below any name.
    """

    def __init__(self, page: str | None):
        self.nodes: list[tuple[int, int, bool, bool]] = []
        found: list[tuple[int, bool, str, int, int]] = []
        # tag, no text, main, node, named element around, article or main element around
        stack: list[tuple[str, bool, bool, int, int, int]] = [("", False, False, -1, -1, -1)]
        named: list[list[int]] = []  # characters below, named element around
        mains: list[list[int]] = []  # characters below, main element, named element and main around
        opened: dict[str, int] = {}
        held: list[str] = []
        page = page or ""
        at = 0

        def flush():
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text and not stack[-1][1]:
                    _, _, main, node, doubt, within = stack[-1]
                    found.append((node, main, text, doubt, within))
                    if doubt >= 0:
                        named[doubt][0] += len(text)
                    if within >= 0:
                        mains[within][0] += len(text)

        def say(text: str):
            if text and not stack[-1][1]:
                held.append(html.unescape(text))

        def close(k: int):
            if any(s[0] in BLOCK for s in stack[k:]):
                flush()
            for s in stack[k:]:
                opened[s[0]] -= 1
            del stack[k:]

        tags = _tags(page)
        item = next(tags, None)
        while item:
            start, end, ends, tag, attributes = item
            say(page[at:start])
            at = end
            if tag in RAW and not ends:
                if tag in BLOCK:
                    flush()
                at = _ENDS[tag].search(page, at).end()
                try:
                    item = tags.send(at)
                except StopIteration:
                    item = None
                continue
            item = next(tags, None)
            if not tag:
                continue
            if ends:
                if opened.get(tag):
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                elif tag == "p":
                    flush()
                continue
            if tag in CLOSES_P and opened.get("p"):
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p" or stack[k][0] in BLOCK), 0)
                if k and stack[k][0] == "p":
                    close(k)
            if tag in IMPLIED and any(opened.get(x) for x in IMPLIED[tag][0]):
                ends_, stop = IMPLIED[tag]
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in ends_ or stack[k][0] in stop), 0)
                if k and stack[k][0] in ends_:
                    close(k)
            if tag in BLOCK:
                flush()
            if tag == "br":
                say(" ")
            if tag in VOID or (attributes.endswith("/") and tag not in BLOCK):
                continue
            _, dropped, main, node, doubt, within = stack[-1]
            if not dropped:
                attrs = {a.lower(): html.unescape(x or y or z) for a, x, y, z in _ATTR.findall(attributes)} if "=" in attributes else {}
                style = f"{attrs.get('class', '')} {attrs.get('id', '')}"
                role = attrs.get("role", "").lower()
                whole = tag in ("html", "body", "main")
                bad = False
                if tag in NO_TEXT:
                    dropped = True
                elif tag in NO_CONTENT or (role in NO_ROLE and not whole) or (tag == "header" and not main):
                    bad = True
                elif style != " " and tag == "article":
                    bad = bool({x.lower() for x in _NAME.findall(style)} & {"comment", "comments"})
                elif style != " " and not whole:
                    bad = _no_content(style, not main)
                if not bad and (tag in ("article", "main") or role == "main"):
                    main = True
                    mains.append([0, tag != "article", doubt, within])
                    within = len(mains) - 1
                if bad:
                    named.append([0, doubt])
                    doubt = len(named) - 1
                if tag in BLOCK and (tag not in PLAIN or style != " "):
                    label = " ".join([tag, *sorted(style.split())])
                    above = self.nodes[node] if node >= 0 else (0, 0, False, False)
                    inside = above[2] or tag in ("article", "main")
                    self.nodes.append((node, xxhash.xxh64_intdigest(label.encode(), above[1]), inside, tag not in ("html", "body", "main", "article")))
                    node = len(self.nodes) - 1
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, dropped, main, node, doubt, within))
        say(page[at:])
        flush()
        for x in reversed(mains):
            if x[3] >= 0:
                mains[x[3]][0] += x[0]
        for x in reversed(named):
            if x[1] >= 0:
                named[x[1]][0] += x[0]
        total = sum(len(b[2]) for b in found)
        spared = {i for i, n in enumerate(named) if 2 * n[0] > total}
        largest = max((m[0] for m in mains if not m[1]), default=0)
        for n, is_main, i, _ in mains:
            if n and (is_main or n == largest):
                while i >= 0 and i not in spared:
                    spared.add(i)
                    i = named[i][1]
        out: list[bool] = []
        for i, (_, around) in enumerate(named):
            out.append(i not in spared or (around >= 0 and out[around]))
        self.blocks = [(node, main, text, doubt >= 0 and out[doubt], doubt >= 0) for node, main, text, doubt, _ in found]
        self.has_main = any(b[1] and not b[3] for b in self.blocks)

    def contents(self) -> list[tuple[int, bool, set[int]]]:
        """Of each node in the tree: number, outside of article and main elements,
        contents.  What stands above an article or main element isn't in the tree."""
        above: set[int] = set()
        free: list[int] = []  # the next node around that is outside of these elements
        for i, (around, _, inside, _) in enumerate(self.nodes):
            free.append(i if not inside else free[around] if around >= 0 else -1)
        for i in {free[b[0]] for b in self.blocks if b[1] and not b[3] and b[0] >= 0}:
            while i >= 0 and i not in above:
                above.add(i)
                i = self.nodes[i][0]
        own: list[list[int]] = [[] for _ in self.nodes]
        for node, _, text, *_ in self.blocks:
            if node >= 0:
                own[node].append(_hash(text.encode()))
        out = []
        for i in range(len(self.nodes) - 1, -1, -1):  # branches come after what they are in
            if not own[i]:
                continue
            around, number, inside, may = self.nodes[i]
            if may and not (self.has_main and i in above):
                out.append((number, not inside, set(own[i])))
            if around >= 0:
                own[around].append(_hash(b"".join(x.to_bytes(8, "little") for x in (number, *own[i]))))
        return out

    def text(self, removed: frozenset[int] | set[int] = frozenset(), vouched: frozenset[int] | set[int] = frozenset()) -> str:
        gone: list[bool] = []
        good: list[bool] = []
        for around, number, *_ in self.nodes:
            gone.append(number in removed or (around >= 0 and gone[around]))
            good.append(number in vouched or (around >= 0 and good[around]))
        keep = []
        for node, main, text, left_out, named in self.blocks:
            outside = self.has_main and not main
            if left_out or (node >= 0 and gone[node]) or (outside and (named or node < 0 or not good[node])):
                continue
            keep.append(text)
        return "\n\n".join(keep)


def text_of(page: str | None) -> str:
    """The text of a page whose host isn't known."""
    return Page(page).text()


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rows(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), host.alias("host"), F.col(page).alias("t"))


def style_tree(pages: DataFrame, url: str = "url", page: str = "html", key: str = "page_id") -> DataFrame:
    """(host, node, outside, m, importance): every node of every host's tree, and the
    number of different pages it is on."""
    rows = _rows(pages, key, url, page).select("host", "t")

    def run(it):
        for b in it:
            for part in chunks(b, "t", _SLICE):
                out = []
                for host, t in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    whole = _signed(_hash((t or "").encode()))
                    out += [(host, _signed(node), outside, _signed(x), whole) for node, outside, own in Page(t).contents() for x in own]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()], strict=True)], ["host", "node", "outside", "content", "page"])

    seen = settle(rows.mapInArrow(tidied(run), "host string, node long, outside boolean, content long, page long").distinct())
    content = seen.groupBy("host", "node", "content").agg(F.count("*").alias("f"), F.min("outside").alias("outside"))
    mean = content.groupBy("host", "node").agg(F.avg(F.log("f")).alias("h"), F.min("outside").alias("outside"))
    size = seen.select("host", "node", "page").distinct().groupBy("host", "node").agg(F.count("*").alias("m"))
    importance = F.when(F.col("m") > 1, 1 - F.col("h") / F.log(F.greatest("m", F.lit(2)))).otherwise(1.0)
    return mean.join(size, ["host", "node"]).select("host", "node", "outside", "m", importance.alias("importance"))


def low_nodes(pages: DataFrame, url: str = "url", page: str = "html", key: str = "page_id", least: float = LEAST, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, nodes, vouched): of each host the nodes of little importance, and those of
    high importance outside article and main elements.  Article and main elements and
    what stands above them are neither."""
    low, high = F.col("importance") < least, (F.col("importance") >= MOST) & F.col("outside")
    known = style_tree(pages, url, page, key).where((F.col("m") >= least_pages) & (low | high))
    return known.groupBy("host").agg(F.collect_list(F.when(low, F.col("node"))).alias("nodes"), F.collect_list(F.when(~low, F.col("node"))).alias("vouched"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars): a row for each page."""
    low = settle(low_nodes(pages, url, page, key))  # its size is known: broadcast if small
    joined = _rows(pages, key, url, page).join(low, "host", "left").select("k", "u", "t", "nodes", "vouched")

    def run(it):
        for b in it:
            for part in chunks(b, "t", _SLICE):
                texts = []
                for t, n, v in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    removed, vouched = ({x & (1 << 64) - 1 for x in some or ()} for some in (n, v))
                    texts.append(Page(t).text(removed, vouched))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["k", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInArrow(tidied(run), f"k {kind}, url string, text string, n_chars long").withColumnRenamed("k", key)
