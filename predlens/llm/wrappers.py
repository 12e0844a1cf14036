"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page becomes a stream of opening and closing block tags and text. Pages of one host are
aligned one after the other: where they agree the wrapper keeps the tag, a part that only some
have becomes optional, a part that follows itself becomes repeated, and text becomes a slot that
is fixed if it is the same everywhere. The wrapper then says where the host keeps its main
text, and the blocks at those places are taken from every page. Wrappers of parts of a host are
aligned like pages, so a host of any size is inferred in parts.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.llm.batches import in_small_batches
from predlens.llm.urls import url_parts
from predlens.session import durable

# Element kinds of the HTML standard.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot "
    "thead tr ul".split()
)
SILENT = set("head script style noscript template title textarea select option button iframe object svg math canvas audio video map datalist".split())
RAW = set("script style textarea title iframe noscript".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = set("html head base basefont bgsound link meta title noscript noframes style script template".split())
SPACING = set("br td th hr wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"tr", "tbody", "thead"}, "tfoot": {"tr", "tbody", "thead"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
IN_PARAGRAPH = BLOCKS - {"html", "body", "li", "dt", "dd", "tr", "tbody", "thead", "tfoot", "caption", "figcaption", "summary"}

ARTICLES = ("article", "main")
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"}
NAMED = {"div", "section", "ul", "ol", "dl", "p", "table", "details", "article", "li", "figure", "header", "main", "blockquote"}
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted "
    "promotion recommended related replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
CONTENT = set("article content entry main post story".split())
DEEPEST = 60  # deeper elements get no node in the tree; the path to a block still names those that say what they hold

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<cut_end>/?)(?P<cut_tag>[a-zA-Z][^\s/>]*)(?P<cut_attributes>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
TELLING = BLOCKS | SILENT | RAW | SPACING  # the other tags change neither blocks nor text
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.IGNORECASE) for tag in RAW}
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")


class Node:
    """A tag with what lies between it and its end; ``#`` is a text slot, ``()`` a group.

    ``text`` is what a slot always holds, None once it differs; ``mass`` the characters seen.
    """

    __slots__ = ("symbol", "children", "optional", "repeated", "text", "mass", "key")

    def __init__(self, symbol, children=None, optional=False, repeated=False, text=None, mass=0):
        self.symbol, self.children, self.optional, self.repeated, self.text, self.mass = symbol, children or [], optional, repeated, text, mass
        self.key = f"({','.join(child.key for child in self.children)})" if symbol == "()" else symbol

    def dump(self) -> list:
        return [self.symbol, [child.dump() for child in self.children], self.optional, self.repeated, self.text, self.mass]

    @staticmethod
    def load(fields: list) -> Node:
        return Node(fields[0], [Node.load(child) for child in fields[1]], *fields[2:])

    def expression(self) -> str:
        """The wrapper as text: tags, ``#`` for text that varies, ``( )?`` and ``( )+``."""
        inside = "".join(child.expression() for child in self.children)
        if self.symbol == "#":
            body = "#" if self.text is None else repr(self.text)
        elif self.symbol == "()":
            body = inside
        else:
            body = f"<{self.symbol}>{inside}</{self.symbol.split('.')[0]}>"
        if not (self.optional or self.repeated):
            return body
        return f"({body})" + ("*" if self.optional and self.repeated else "+" if self.repeated else "?")


def merged(a: Node, b: Node, repeated: bool = False) -> Node:
    """Two wrappers of the same tag as one."""
    return Node(
        a.symbol, aligned(a.children, b.children), a.optional or b.optional, a.repeated or b.repeated or repeated,
        a.text if a.text == b.text else None, a.mass + b.mass,
    )


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """The longest common run of keys, the rest optional; then what follows itself is folded."""
    left, right = [n.key for n in a], [n.key for n in b]
    if left == right:
        return [merged(x, y) for x, y in zip(a, b)]
    start = 0
    while start < min(len(a), len(b)) and left[start] == right[start]:
        start += 1
    rows, columns = len(a) - start, len(b) - start
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows - 1, -1, -1):
        for j in range(columns - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[start + i] == right[start + j] else max(best[i + 1][j], best[i][j + 1])
    found, i, j = [merged(x, y) for x, y in zip(a[:start], b[:start])], 0, 0
    while i < rows or j < columns:
        if i < rows and j < columns and left[start + i] == right[start + j]:
            found.append(merged(a[start + i], b[start + j]))
            i, j = i + 1, j + 1
        else:
            take_left = j == columns or (i < rows and best[i + 1][j] >= best[i][j + 1])
            node = a[start + i] if take_left else b[start + j]
            node.optional = True
            found.append(node)
            i, j = (i + 1, j) if take_left else (i, j + 1)
    return folded(found)


def folded(nodes: list[Node], longest: int = 3) -> list[Node]:
    """Nodes with each stretch of up to ``longest`` nodes that follows itself as one repeated group."""
    if len({node.key for node in nodes}) == len(nodes):
        return nodes
    found: list[Node] = []
    for node in nodes:
        found.append(node)
        changed = len(found) > 1
        while changed:
            changed = False
            for size in range(1, longest + 1):
                last = [n.key for n in found[-size:]]
                before = found[-size - 1] if len(found) > size else None
                if size > 1 and before is not None and before.symbol == "()" and [n.key for n in before.children] == last:
                    group = Node("()", [merged(x, y) for x, y in zip(before.children, found[-size:])], before.optional, True)
                    found[-size - 1 :] = [group]
                elif len(found) >= 2 * size and [n.key for n in found[-2 * size : -size]] == last:
                    pairs = [merged(x, y, size == 1) for x, y in zip(found[-2 * size : -size], found[-size:])]
                    if size == 1:
                        pairs[0].optional = found[-2].optional and found[-1].optional
                    found[-2 * size :] = pairs if size == 1 else [Node("()", pairs, False, True)]
                else:
                    continue
                changed = True
                break
    return found


def role(tag: str, attributes: str) -> str:
    """The tag, with the first telling word of its class, id or role.

    An article, a main element or a part with a name of content is boilerplate only if a whole name
    says so: ``sidebar`` does, ``has-sidebar`` does not.
    """
    if tag not in NAMED or not attributes:
        return tag
    names = " ".join(value.strip("\"'") for value in NAMES.findall(attributes)).lower().split()
    words = [WORD.findall(name) for name in names]
    content = tag in ("article", "main") or any(not CONTENT.isdisjoint(parts) and BOILERPLATE.isdisjoint(parts) for parts in words)
    for kind, parts in ((BOILERPLATE, names if content else sum(words, [])), (CONTENT, sum(words, []))):
        for word in parts:
            if word in kind:
                return f"{tag}.{word}"
    return tag


class Page:
    """A page's blocks in order with the path of each, and the tree of its blocks if that is wanted."""

    def __init__(self, source: str, with_tree: bool = True):
        self.with_tree = with_tree
        self.blocks: list[tuple[tuple[str, ...], str]] = []
        self.root = Node("page")
        self.open: list[Node] = [self.root]  # of every open element the node that gathers its content
        self.tags: list[str] = ["page"]
        self.many: Counter[str] = Counter()  # open elements by tag
        self.ways: list[int] = [0]  # length of the path before every open element
        self.path: tuple[str, ...] = ()
        self.pending: list[str] = []
        self.silent: list[str] = []
        self._read(source)
        self._close_to(1)
        if with_tree:
            self.root.children = folded(self.root.children)

    def _read(self, source: str) -> None:
        at = 0
        while (token := TOKEN.search(source, at)) is not None:
            if token.start() > at:
                self._between(source[at : token.start()])
            at = token.end()
            end, tag, attributes, cut_end, cut_tag, cut_attributes = token.groups()
            tag = (tag or cut_tag or "").lower()
            if tag and not (end or cut_end) and tag not in IN_HEAD:
                self._end_head()
            if tag not in TELLING:
                continue
            if end or cut_end:
                self._end(tag)
                continue
            self._start(tag, attributes or cut_attributes or "")
            if tag in RAW:
                close = RAW_END[tag].search(source, at)
                at = close.start() if close else len(source)
        self._between(source[at:])

    def _end_head(self) -> None:
        """A head left open ends where something stands that it cannot hold."""
        if self.silent and self.silent[-1] == "head":
            self.silent = []

    def _between(self, text: str) -> None:
        if self.silent and text.strip():
            self._end_head()
        if not self.silent:
            self._text(text)

    def _text(self, text: str) -> None:
        if text:
            self.pending.append(entities.unescape(text) if "&" in text else text)

    def _flush(self) -> None:
        if not self.pending:
            return
        text = " ".join("".join(self.pending).split())
        self.pending = []
        if text:
            self.blocks.append((self.path, text))
            if self.with_tree:
                self.open[-1].children.append(Node("#", text=text if len(text) <= 200 else None, mass=len(text)))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in SPACING:
            self.pending.append(" ")
        if tag in SILENT and not attributes.rstrip().endswith("/"):
            self.silent.append(tag)
        if tag not in BLOCKS or self.silent:
            return
        self._flush()
        if tag in IN_PARAGRAPH and self.many["p"]:
            self._close_to(self._level("p"))
        if tag in CLOSED_BY:
            for level in range(len(self.tags) - 1, 0, -1):
                if self.tags[level] in CLOSED_BY[tag]:
                    self._close_to(level)
                    break
                if self.tags[level] in STOPS.get(tag, ()):
                    break
        if tag in VOID or tag in ("html", "body"):
            return
        symbol, deep = role(tag, attributes), len(self.open) > DEEPEST
        node = self.open[-1] if deep else Node(symbol)
        if self.with_tree and not deep:
            self.open[-1].children.append(node)
        self.open.append(node)
        self.tags.append(tag)
        self.many[tag] += 1
        self.ways.append(len(self.path))
        if not deep or outside((*self.path, symbol)) != outside(self.path) or (tag in ARTICLES and not in_article(self.path)):
            self.path = (*self.path, symbol)

    def _level(self, tag: str) -> int:
        """Where the innermost open element of a tag stands."""
        level = len(self.tags) - 1
        while self.tags[level] != tag:
            level -= 1
        return level

    def _end(self, tag: str) -> None:
        if tag in self.silent:
            del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
            return
        if tag in SPACING:
            self.pending.append(" ")
        if tag not in BLOCKS or self.silent:
            return
        self._flush()
        if self.many[tag]:
            self._close_to(self._level(tag))

    def _close_to(self, level: int) -> None:
        self._flush()
        while len(self.open) > level:
            node, way = self.open.pop(), self.ways.pop()
            if node is not self.open[-1] and len(node.children) > 1:
                node.children = folded(node.children)
            self.many[self.tags.pop()] -= 1
            self.path = self.path[:way]


def in_article(path: tuple[str, ...]) -> bool:
    return any(symbol.partition(".")[0] in ARTICLES for symbol in path)


def outside(path: tuple[str, ...]) -> bool:
    """Whether a path leads through a part that is never main text."""
    in_article = False
    for symbol in path:
        tag, _, word = symbol.partition(".")
        if tag in OUTSIDE or word in BOILERPLATE or (tag == "header" and not in_article):
            return True
        in_article = in_article or tag in ("article", "main")
    return False


def main_places(wrapper: Node) -> list[tuple[str, ...]]:
    """The paths under which a wrapper's main text lies.

    Articles, else main elements, else parts named like content; without any, the
    smallest part that holds most of the text that varies.
    """
    kinds: dict[str, list] = {"article": [], "main": [], "named": []}

    def look(node: Node, path: tuple[str, ...]) -> None:
        for child in node.children:
            if child.symbol == "#":
                continue
            if child.symbol == "()":
                look(child, path)
                continue
            place = (*path, child.symbol)
            if outside(place):
                continue
            tag, _, word = child.symbol.partition(".")
            if tag in ("article", "main"):
                kinds[tag].append(place)
            elif word in CONTENT:
                kinds["named"].append(place)
            look(child, place)

    look(wrapper, ())
    for found in kinds.values():
        if found:
            return sorted(set(found))
    return [_heaviest(wrapper)]


def _heaviest(wrapper: Node) -> tuple[str, ...]:
    """Down from the top while one part holds nearly all text that varies."""

    def mass(node: Node, path: tuple[str, ...]) -> int:
        if outside(path):
            return 0
        own = node.mass if node.symbol == "#" and node.text is None else 0
        return own + sum(mass(child, path if child.symbol in ("#", "()") else (*path, child.symbol)) for child in node.children)

    def parts(node: Node):
        for child in node.children:
            if child.symbol == "()":
                yield from parts(child)
            elif child.symbol != "#":
                yield child

    path: tuple[str, ...] = ()
    node, total = wrapper, mass(wrapper, ())
    while True:
        heavy = [child for child in parts(node) if not child.repeated and 10 * mass(child, (*path, child.symbol)) >= 8 * total]
        if not total or not heavy:
            return path
        node = heavy[0]
        path = (*path, node.symbol)


def main_text(source: str | None, places: list[tuple[str, ...]]) -> str:
    """The blocks of a page at the places of its host's wrapper, else at those of its own."""
    if not source:
        return ""
    return "\n".join(_at(places, source) or _at(main_places(Page(source).root), source))


def _at(places: list[tuple[str, ...]], source: str) -> list[str]:
    blocks = Page(source, with_tree=False).blocks if places else []
    kept = {path: any(path[: len(top)] == top for top in places) and not outside(path) for path in {path for path, _ in blocks}}
    return [text for path, text in blocks if kept[path]]


def _inferred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper per host of a partition; passed on early if there are very many hosts."""
    wrappers: dict[str, list] = {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(host, json.dumps(w.dump()), n) for host, (w, n) in wrappers.items()], columns=["host", "wrapper", "pages"])

    for batch in batches:
        for host, source in zip(batch["host"], batch["html"]):
            tree = Page(source or "").root
            held = wrappers.get(host)
            wrappers[host] = [merged(held[0], tree), held[1] + 1] if held else [tree, 1]
            if len(wrappers) >= 5000:
                yield rows()
                wrappers = {}
    yield rows()


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    total = None
    for fields in parts.sort_values("wrapper")["wrapper"]:
        tree = Node.load(json.loads(fields))
        total = tree if total is None else merged(total, tree)
    return pd.DataFrame({"host": [parts["host"].iloc[0]], "wrapper": [json.dumps(total.dump())], "pages": [int(parts["pages"].sum())]})


def infer_wrappers(pages: DataFrame, salts: int = 32) -> DataFrame:
    """(host, wrapper, pages): the wrapper of each host, inferred from all its pages (host, html).

    Every task reduces its pages to a wrapper per host first; a host's parts meet in ``salts``
    groups and those in one, so a host with most pages brings few rows to any task.
    """
    kind = "host string, wrapper string, pages long"
    parts = pages.select("host", "html").mapInPandas(_inferred, kind).withColumn("salt", F.spark_partition_id() % salts)
    halfway = parts.groupBy("host", "salt").applyInPandas(lambda p: _joined(p), kind)
    return halfway.groupBy("host").applyInPandas(lambda p: _joined(p), kind)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Blocks are separated by a line feed, white space within one is a space, character references
    are decoded. A NULL or empty page, and one without main text, has the empty text. Pages whose
    url has no host share the empty host. Repeated rows give equal rows. Reads page_id, url, html.
    """
    hosted = in_small_batches(url_parts(pages.select("page_id", "url", "html")))

    @F.pandas_udf("string")
    def places(wrappers: pd.Series) -> pd.Series:
        return wrappers.map(lambda fields: json.dumps(main_places(Node.load(json.loads(fields)))))

    @F.pandas_udf("string")
    def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, tops in batches:
            known = {top: [tuple(path) for path in json.loads(top)] for top in tops.unique()}
            yield pd.Series([main_text(source, known[top]) for source, top in zip(sources, tops)], dtype=object)

    # Written down, their size is known: few hosts are sent to the pages, many are joined.
    known = durable(infer_wrappers(hosted).select("host", places("wrapper").alias("places")), "places")
    found = hosted.join(known, "host").withColumn("text", texts("html", "places"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
