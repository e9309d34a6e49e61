"""Main text of web pages: site templates are learnt per host and cut out.

A page is parsed into a tree. Every element subtree gets a hash of its tag, its text and its children's
hashes; Spark counts on how many different pages of a host each hash occurs, and subtrees that recur on
many pages are deleted before the text is read. Elements whose role is fixed by HTML or by their name
(menus, forms, scripts, adverts, comments, ...) are not read; a name is a whole token of class or id, and does
not hide the only article of a page or its ``main``. Where a page has ``article`` or ``main``,
only these are read, and of what a host repeats there only boxes of links, and elements named as standing around an
article (notices, sidebars, ...), go: its prose, lists and tables stay. Parsing takes time linear in the page.

Counting is one aggregation by (host, hash), combined before the shuffle, so that a host with a third of
all pages is spread over all tasks; a page meets the templates of its host by its own hashes, so no list of a
host's templates or pages is ever made. Copies of a page count once.

Defined cases: null or empty pages give the empty text; pages without a host have no template; repeated
rows give equal rows; unclosed tags end with their parent; other columns of the input stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import extended, map_batches, put_back, set_aside, stored, texts_of

MIN_PAGES = 5
MIN_SHARE = 0.02

# fixed values: element roles of HTML
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset(
    "head script style noscript template iframe object svg math canvas audio video map nav footer aside form button select "
    "textarea input label datalist dialog menu title noembed noframes xmp".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td figcaption".split())
_CORE = frozenset(("article", "main"))
_CLOSES = {  # an open element of the second kind ends where one of the first begins
    **dict.fromkeys("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                    "main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_STOPS = frozenset("ul ol dl table article main section div body nav aside form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
# fixed values: words in names of elements; menus, adverts, comments and forms are no part of an article wherever they stand
_APART = frozenset(
    "ad ads adv advert advertisement adverts adsense adslot breadcrumb breadcrumbs comment comments commentlist disqus menu nav navbar navigation "
    "newsletter pagination pager promo respond share sharing signup social sponsor sponsored subscribe toolbar".split()
)
_AROUND = frozenset(
    "banner cookie cookies consent disclaimer footer gdpr masthead modal notice notices overlay popup related sidebar skip widget widgets".split()
)
_BOILERPLATE = _APART | _AROUND
_NO_DISPLAY = re.compile(r"display\s*:\s*none")
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"""
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
_WORD = re.compile(r"[^\W\d_]+")


def _roles(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is out of sight or has a role that is never read, whether a name sets it apart, and whether a name
    tells that it stands around articles."""
    never = apart = around = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden":
            never |= value.strip() != "false"
        elif name == "aria-hidden":
            never |= value.strip() == "true"
        elif name == "style":
            never |= bool(_NO_DISPLAY.search(value))
        elif name == "role":
            never |= not _ROLES.isdisjoint(value.split())
        elif name in ("class", "id"):
            # a token counts whole: sidebar, cookie-notice and ad-1, but not has-sidebar
            tokens = [words for words in map(_WORD.findall, value.split()) if words and _BOILERPLATE.issuperset(words)]
            apart |= any(not _APART.isdisjoint(words) for words in tokens)
            around |= bool(tokens)
    return never, apart, around and not apart


class Node:
    """``apart`` and ``around`` are what names tell: the first never belongs to an article, the second only outside of one."""

    __slots__ = ("tag", "never", "apart", "around", "kids", "hash", "full", "plain", "links")

    def __init__(self, tag: str, attributes: str, inside_core: bool):
        self.tag = tag
        self.kids: list = []
        self.hash = 0
        self.full = False
        self.links = tag == "a"
        self.plain = not attributes.strip(" /")
        self.never = tag in _NEVER or (tag == "header" and not inside_core)
        self.apart = self.around = False
        if not self.never and not self.plain and tag not in _CORE and tag not in ("html", "body"):
            self.never, self.apart, self.around = _roles(attributes)

    def goes(self, in_core: bool) -> bool:
        """Whether tag or names leave the element out, whatever its host repeats."""
        return self.never or self.apart or (self.around and not in_core)

    def close(self) -> None:
        """Hash the finished subtree."""
        parts = [self.tag]
        for kid in self.kids:
            if isinstance(kid, str):
                text = " ".join(kid.split())
                if text:
                    self.full = True
                    parts.append(text)
            else:
                self.full |= kid.full
                self.links |= kid.links
                parts.append(f"\0{kid.hash}")
        self.hash = xxhash.xxh3_64_intdigest("\1".join(parts).encode("utf-8", "surrogatepass")) >> 1


class _Stack:
    """The open elements of a page, and for each tag where it is open; every step costs what it closes."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.stops: list[int] = [0]
        self.cores = 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _STOPS:
            self.stops.append(len(self.nodes))
        self.cores += node.tag in _CORE
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        """Close elements until ``size`` are open."""
        while len(self.nodes) > size:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in _STOPS:
                self.stops.pop()
            self.cores -= node.tag in _CORE
            node.close()

    def innermost(self, *tags: str) -> int:
        """Where the innermost open element of these tags is; 0 if none is."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(text: str) -> Node:
    """The tree of a page in time linear in its length; end tags without a beginning are passed over, what stays open ends with its parent."""
    root = Node("html", "", False)
    stack, at = _Stack(root), 0
    last = text.rfind(">")  # behind it no tag ends
    data = text.rfind("]]>")
    while at <= last and (m := _TOKEN.search(text, at)) and m.start() < last:
        if m.start() > at:
            stack.nodes[-1].kids.append(html.unescape(text[at : m.start()]))
        at = m.end()
        if name := m[1]:
            if place := stack.innermost(name.lower()):
                stack.cut(place)
        elif name := m[2] or m[4]:
            name = name.lower()
            ends = _CLOSES.get(name, ())
            while ends and (place := stack.innermost(*ends)) > stack.stops[-1]:
                stack.cut(place)
            attributes = m[3] or m[5] or ""
            node = Node(name, attributes, stack.cores > 0)
            stack.nodes[-1].kids.append(node)
            if name in _VOID or attributes.endswith("/") and name not in _BLOCKS:
                node.close()
            elif name in _RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(text, at, last + 1) if at <= last else None
                at = stop.end() if stop else len(text)
                node.close()
            else:
                stack.push(node)
        elif text.startswith("<![CDATA[", m.start()) and m.start() < data:
            at = text.index("]]>", m.start()) + 3
    rest = text[at:]
    if rest:
        opened = rest.find("<!--")  # a comment that does not end
        stack.nodes[-1].kids.append(html.unescape(rest if opened < 0 else rest[:opened]))
    stack.cut(1)
    root.close()
    return root


def _cores(root: Node) -> list[Node]:
    """The outermost ``article`` and ``main`` elements, else the whole page.

    A wrapper's name never hides ``main``; it hides an ``article`` only if another one stands outside such wrappers.
    """
    found: list[Node] = []
    wrapped: list[tuple] = []  # articles below named elements, with a chain of these
    article = False
    todo: list[tuple] = [(root, None, False)]
    while todo:
        node, names, in_main = todo.pop()
        if node.never:
            continue
        if node.tag == "article" and node.full:
            if names:
                wrapped.append((node, names, in_main))
            else:
                article = True
                if not in_main:
                    found.append(node)
            continue
        if node.tag == "main" and node.full and not in_main:
            found.append(node)
            names, in_main = None, True
        elif node.apart or node.around:
            names = (node, names)
        todo += [(k, names, in_main) for k in reversed(node.kids) if not isinstance(k, str)]
    if not article:
        alone = not found
        for node, names, in_main in wrapped:
            if in_main:
                while names:
                    names[0].apart = names[0].around = False
                    names = names[1]
            elif alone:
                found.append(node)
    return found or [root]


def _may_go(node: Node, in_core: bool) -> bool:
    """Whether a recurring subtree is deleted: of an article only menus, which hold links and are no plain prose, and what a
    name tells to stand around articles."""
    if in_core and not node.around and (not node.links or node.plain and node.tag in _PROSE):
        return False
    return node.full and node.tag not in ("html", "body", *_CORE)


def subtree_hashes(root: Node) -> set[int]:
    """The hashes of all subtrees that a template may hold."""
    out: set[int] = set()
    for core in _cores(root):
        in_core = core.tag in _CORE
        todo = [core]
        while todo:
            node = todo.pop()
            if node.goes(in_core):
                continue
            if _may_go(node, in_core) and node.tag in _BLOCKS:
                out.add(node.hash)
            todo += [k for k in node.kids if not isinstance(k, str)]
    return out


def main_text(root: Node, template: frozenset[int] = frozenset()) -> str:
    """The blocks of a page, one per line, without fixed roles and template subtrees."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    for core in _cores(root):
        in_core = core.tag in _CORE
        todo: list = [core]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                line.append(node)
            elif node is None:
                flush()
            elif node.goes(in_core) or template and node.hash in template and node.tag in _BLOCKS and _may_go(node, in_core):
                if node.tag in _BLOCKS:
                    flush()
            elif node.tag in _BLOCKS:
                flush()
                todo.append(None)
                todo += reversed(node.kids)
            elif node.tag == "br":
                line.append(" ")
            else:
                todo += reversed(node.kids)
        flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``(_page, _template array<long>)``: per page the hashes of its subtrees that recur on its host.

    ``pages`` has ``_host``, ``_page`` (a hash of host and html) and ``html``.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(host, page, h) for h in subtree_hashes(parse(text or ""))]
            cols = list(zip(*out)) or [(), (), ()]
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["_host", "_page", "hash"])

    hosted = pages.where("_host <> ''")
    found = stored(map_batches(hosted.select("_host", "_page", "html"), hashes, "_host string, _page bigint, hash bigint"))
    sizes = hosted.groupBy("_host").agg(F.count_distinct("_page").alias("pages"))
    counts = found.groupBy("_host", "hash").agg(F.count_distinct("_page").alias("n")).where(F.col("n") >= min_pages)
    templates = counts.join(sizes, "_host").where(F.col("n") >= F.col("pages") * min_share).select("_host", "hash")
    return found.join(templates, ["_host", "hash"]).groupBy("_page").agg(F.collect_set("hash").alias("_template"))


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; columns of these names are replaced."""
    pages = pages.drop("text", "n_chars")
    names = pages.columns
    pages, taken = set_aside(pages, "_host", "_page", "_template")
    pages = pages.withColumn("_host", host_of(F.col("url")))
    pages = pages.withColumn("_page", F.xxhash64("_host", "html"))
    own = pages.drop("_host", "_page")
    at = own.columns.index("html")
    joined = pages.join(site_templates(pages, min_pages, min_share), "_page", "left").select(*own.columns, "_template")

    def read(batches):
        for batch in batches:
            templates = batch.column(batch.num_columns - 1).to_pylist()
            texts = [main_text(parse(t), frozenset(h or ())) for t, h in zip(texts_of(batch.column(at)), templates)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*batch.schema.names[:-1], "text", "n_chars"],
            )

    return put_back(map_batches(joined, read, extended(own, "text string, n_chars bigint")), taken).select(*names, "text", "n_chars")
