"""The one Python pass over crawled pages.

``page_pass`` reads each page once inside ``mapInPandas`` and returns the raw texts,
attributes and counts that a query asks for; all choices, patterns and rules after
that are Spark columns. There is no shuffle: pages stay in their partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())

# how a pick is taken from a page -> its column type
KINDS: dict[str, T.DataType] = {
    "first": TEXTS,  # per selector: trimmed text of the first match, or null
    "joined": TEXTS,  # per selector: trimmed text of all matches together
    "all": TEXTS,  # trimmed text of every match, selector by selector
    "attr": TEXTS,  # per selector: an attribute of the first match
    "attrs": TEXTS,  # an attribute of every match
    "count": T.IntegerType(),  # elements that match any selector
    "tags": TEXTS,  # distinct tags of the elements that match any selector
    "longest": T.StringType(),  # the longest trimmed text among the matches, first of equals
    "text": T.StringType(),  # all text of the page
    "links": T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])),
    "tagged": T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])),
    "lists": T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("items", TEXTS)])),
}


@dataclass(frozen=True)
class Pick:
    """One output column: selectors in priority order, and what to take from their matches.

    With ``scope`` the parts are taken inside every element that matches it, and the
    column is an array with one struct per element.
    """

    name: str
    kind: str = "first"
    selectors: tuple[str, ...] = ()
    attribute: str = ""
    scope: str = ""
    parts: tuple[Pick, ...] = field(default=())

    def type(self) -> T.DataType:
        if self.scope:
            return T.ArrayType(T.StructType([T.StructField(p.name, p.type()) for p in self.parts]))
        return KINDS[self.kind]


def first(name: str, *selectors: str) -> Pick:
    return Pick(name, "first", selectors)


# fixed values of HTML itself
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"},
         "dt": {"dl"}, "dd": {"dl"}}
HEAD = frozenset("html head title meta link script style base noscript template".split())
# tags as most are written; all else, and elements whose content is no markup, is left to the parser
PLAIN_TAG = re.compile(r"""<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?: [a-z][a-z-]*="[^"&]*")*))>""")
PLAIN_ATTRIBUTE = re.compile(r'([a-z-]+)="([^"]*)"')
RAW = frozenset((*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())))


class Node:
    __slots__ = ("tag", "attrs", "classes", "parent", "start", "end", "before", "index", "stop", "ends_here")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, start: int, before: Node | None, index: int):
        self.tag, self.attrs, self.parent, self.start, self.before = tag, attrs, parent, start, before
        self.end, self.index, self.stop, self.ends_here = start, index, index + 1, False
        self.classes = (attrs.get("class") or "").split()


class Page(HTMLParser):
    """Elements in reading order; each spans a range of the text pieces and of the elements inside it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.pieces: list[str] = []
        self.open: list[Node] = []
        self.reopen: list[tuple[str, dict]] = []
        self.last_child: dict[int, Node] = {}
        self.seen: dict[str, list[Node]] = {}  # elements by tag, and by class with a dot
        rest = html[self._feed_plain(html) :]
        if rest:
            self.feed(rest)
            self.close()
        while self.open:
            self._pop()
        self.whole = True  # nothing is dropped
        self.dropped = bytearray(len(self.pieces))
        self.gone = bytearray(len(self.nodes))

    # -- building --

    def _feed_plain(self, html: str) -> int:
        """Read plain tags and the texts before them, as ``feed`` does but faster; returns where they end."""
        i = 0
        while True:
            j = html.find("<", i)
            tag = PLAIN_TAG.match(html, j) if j >= 0 else None
            if tag is None:
                return i
            closed, opened, attributes = tag.groups()
            if opened and opened.lower() in RAW:
                return i
            if i < j:
                self.handle_data(unescape(html[i:j]))
            if closed:
                self.handle_endtag(closed.lower())
            else:
                self.handle_starttag(opened.lower(), PLAIN_ATTRIBUTE.findall(attributes) if attributes else ())
            i = tag.end()

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are not asked for, so they are not counted."""
        return j

    def _push(self, tag: str, attrs: dict) -> None:
        parent = self.open[-1] if self.open else None
        node = Node(tag, attrs, parent, len(self.pieces), self.last_child.get(id(parent)), len(self.nodes))
        self.last_child[id(parent)] = node
        self.seen.setdefault(tag, []).append(node)
        for name in node.classes:
            self.seen.setdefault("." + name, []).append(node)
        self.nodes.append(node)
        self.open.append(node)

    def _pop(self) -> Node:
        node = self.open.pop()
        node.end, node.stop = len(self.pieces), len(self.nodes)
        return node

    def _close_to(self, tags: Iterable[str], fence: Iterable[str] = ()) -> None:
        """Close the nearest open element of these tags; formatting cut off by that goes on after it."""
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth].tag
            if tag in tags:
                while len(self.open) > depth:
                    node = self._pop()
                    if len(self.open) > depth and node.tag in FORMATTING and not node.ends_here:
                        self.reopen.insert(0, (node.tag, node.attrs))
                return
            if tag in fence:
                return

    def _resume(self) -> None:
        waiting, self.reopen = self.reopen, []
        for tag, attrs in waiting:
            self._push(tag, attrs)

    def _ensure_body(self) -> None:
        if "body" not in self.seen:
            self._close_to({"head"})
            self._push("body", {})

    def handle_starttag(self, tag: str, attrs: Iterable[tuple[str, str | None]]) -> None:
        values = {k: (v or "") for k, v in attrs}
        if tag in ("html", "head", "body"):
            if tag == "body":
                self._close_to({"head"})
            if tag not in self.seen:
                self._push(tag, values)
            return
        if tag not in HEAD:
            self._ensure_body()
        if tag in CLOSES_P:
            self._close_to({"p"}, {"button", "table", "td", "th", "body"})
        elif tag in SELF_CLOSING:
            self._close_to(SELF_CLOSING[tag], FENCE[tag])
        elif tag not in HEAD:
            self._resume()
        if tag in FORMATTING:
            # of equal open formatting only the last three go on after a block ends
            same = [n for n in self.open if n.tag == tag and n.attrs == values and not n.ends_here]
            if len(same) >= 3:
                same[0].ends_here = True
        self._push(tag, values)
        if tag in VOID:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if any(name == tag for name, _ in self.reopen) and tag in FORMATTING:
            self.reopen = [r for r in self.reopen if r[0] != tag]
            return
        self._close_to({tag}, {"td", "th"} if tag in FORMATTING else ())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![..]>`` is a comment in a page, never an error."""
        return self.parse_bogus_comment(i, 0)

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1].tag in ("html", "head"):
            if not data.strip():
                return
            self._ensure_body()
        if self.reopen:
            self._resume()
        self.pieces.append(data)

    # -- reading --

    def text(self, node: Node | None = None) -> str:
        start, end = (node.start, node.end) if node else (0, len(self.pieces))
        if self.whole:
            return "".join(self.pieces[start:end])
        return "".join(p for i, p in enumerate(self.pieces[start:end], start) if not self.dropped[i])

    def drop(self, selector: str) -> list[str]:
        """Remove the matches and everything inside them; returns their tags."""
        hits = self.find(selector)
        self.whole = self.whole and not hits
        for node in hits:
            self.dropped[node.start : node.end] = b"\x01" * (node.end - node.start)
            self.gone[node.index : node.stop] = b"\x01" * (node.stop - node.index)
        return [n.tag for n in hits]

    def restore(self) -> None:
        """Undo every removal."""
        self.whole = True
        self.dropped[:] = bytes(len(self.dropped))
        self.gone[:] = bytes(len(self.gone))

    def find(self, selector: str, scope: Node | None = None) -> list[Node]:
        """Matches of a comma list in reading order, inside an element when one is given."""
        low, high = (scope.index + 1, scope.stop) if scope else (0, len(self.nodes))
        hits: dict[int, Node] = {}
        for keys, key, plain, chain in compiled(selector):
            if not keys <= self.seen.keys():
                continue
            # elements with the wanted class, else the wanted tag, else all
            for node in self.nodes if key is None else self.seen.get(key, ()):
                i = node.index
                if low <= i < high and not self.gone[i] and i not in hits and (plain or chain_matches(self, node, chain)):
                    hits[i] = node
        return [hits[i] for i in sorted(hits)]


PART = re.compile(
    r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|\[(?P<attr>[\w-]+)(?:(?P<op>[*^]?=)["']?(?P<val>[^"'\]]*)["']?)?\]"""
    r"""|:not\((?P<no>[^()]+)\)|:contains\(["']?(?P<has>[^"')]*)["']?\)"""
)
_compiled: dict[str, list] = {}


def compiled(selector: str) -> list:
    """Each alternative as (keys, key, plain, [(relation, tests)] from the element outwards); kept per worker.

    Without elements of all ``keys`` a page has no match. The key is that of the elements to look
    through; with ``plain`` each of them is a match.
    """
    if selector not in _compiled:
        chains = [_chain(alternative.strip()) for alternative in selector.split(",")]
        keys = [[_key(tests) for _, tests in chain] for chain in chains]
        _compiled[selector] = [
            (frozenset(ks) - {None}, ks[0], ks[0] is not None and len(c) == len(c[0][1]) == 1, c) for ks, c in zip(keys, chains)
        ]
    return _compiled[selector]


def _key(tests: list[dict]) -> str | None:
    """The wanted class with a dot, else the wanted tag, else nothing."""
    return next(("." + t["cls"] for t in tests if t["cls"]), None) or next(
        (t["tag"] for t in tests if t["tag"] and t["tag"] != "*"), None
    )


def _chain(text: str) -> list:
    steps, relation = [], ""
    for word in re.findall(r"\+|(?:\([^)]*\)|\[[^\]]*\]|[^\s+])+", text):
        if word == "+":
            relation = "+"
        else:
            steps.append((relation, [m.groupdict() for m in PART.finditer(word)]))
            relation = " "
    return list(reversed(steps))


def chain_matches(page: Page, node: Node, chain: list) -> bool:
    if not simple_matches(page, node, chain[0][1]):
        return False
    for i in range(1, len(chain)):
        if chain[i - 1][0] == "+":
            node = node.before
            if node is None or not simple_matches(page, node, chain[i][1]):
                return False
        else:
            up = node.parent
            while up is not None and not simple_matches(page, up, chain[i][1]):
                up = up.parent
            if up is None:
                return False
            node = up
    return True


def simple_matches(page: Page, node: Node, tests: list[dict]) -> bool:
    for t in tests:
        if t["tag"]:
            ok = t["tag"] == "*" or node.tag == t["tag"]
        elif t["cls"]:
            ok = t["cls"] in node.classes
        elif t["id"]:
            ok = node.attrs.get("id") == t["id"]
        elif t["attr"]:
            value = node.attrs.get(t["attr"])
            ok = value is not None and (
                t["op"] is None
                or (t["op"] == "=" and value == t["val"])
                or (t["op"] == "*=" and t["val"] in value)
                or (t["op"] == "^=" and value.startswith(t["val"]))
            )
        elif t["no"]:
            ok = not simple_matches(page, node, [m.groupdict() for m in PART.finditer(t["no"])])
        else:
            ok = t["has"] in page.text(node)
        if not ok:
            return False
    return True


def take(page: Page, pick: Pick, scope: Node | None = None):
    """The value of one pick."""
    if pick.scope:
        return [{p.name: take(page, p, node) for p in pick.parts} for node in page.find(pick.scope, scope)]
    if pick.kind == "text":
        return page.text(scope)
    found = [page.find(s, scope) for s in pick.selectors]

    def texts(nodes: list[Node]) -> list[str]:
        return [page.text(n).strip() for n in nodes]

    if pick.kind == "first":
        return [page.text(ns[0]).strip() if ns else None for ns in found]
    if pick.kind == "joined":
        return ["".join(page.text(n) for n in ns).strip() if ns else None for ns in found]
    if pick.kind == "attr":
        return [ns[0].attrs.get(pick.attribute) if ns else None for ns in found]
    every = [n for ns in found for n in ns]
    if pick.kind == "all":
        return texts(every)
    if pick.kind == "attrs":
        return [n.attrs[pick.attribute] for n in every if n.attrs.get(pick.attribute)]
    if pick.kind == "count":
        return len({n.index for n in every})
    if pick.kind == "tags":
        return list(dict.fromkeys(n.tag for n in every))
    if pick.kind == "longest":
        return max(texts(every), key=len, default="")
    if pick.kind == "links":
        return [{"href": n.attrs.get("href"), "text": page.text(n)} for n in every]
    if pick.kind == "tagged":
        return [{"tag": n.tag, "text": page.text(n).strip()} for n in every]
    return [{"tag": n.tag, "items": texts(page.find("li", n))} for n in every]


#: Characters of pages whose rows a Python worker holds at a time, and bytes of pages that one batch brings to it.
SLICE = 1 << 20
BATCH_BYTES = 8 << 20


def slices(sizes: Iterable[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with ``most`` characters together, or of one when that has more."""
    start, total, end = 0, 0, 0
    for end, size in enumerate(sizes):
        if end > start and total + size > most:
            yield start, end
            start, total = end, 0
        total += size
    yield start, end + 1


def _read(pages: DataFrame, look: Callable[[str], dict], keep: list[str], fields: list[T.StructField], html: str) -> DataFrame:
    """Pages through ``look``. What is taken from pages can be many times their size, so rows go out slice by slice."""
    names = [f.name for f in fields]
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                yield batch[keep].reindex(columns=names)
                continue
            for start, end in slices(len(source or "") for source in batch[html]):
                part = batch.iloc[start:end]
                out = pd.DataFrame([look(source) for source in part[html]], index=part.index)
                yield pd.concat([part[keep], out], axis=1)[names]

    return pages.mapInPandas(read, T.StructType(fields))


def page_pass(
    pages: DataFrame,
    picks: list[Pick],
    drop: Iterable[str] = (),
    late: list[Pick] = (),
    html: str = "html",
) -> DataFrame:
    """Read every page once: take ``picks``, remove ``drop``, then take ``late``.

    The columns beside ``html`` are kept. ``dropped_tags`` holds the distinct tags removed.
    """
    keep = [c for c in pages.columns if c != html]
    drop, late = tuple(drop), tuple(late)
    fields = [*[pages.schema[c] for c in keep], *[T.StructField(p.name, p.type()) for p in (*picks, *late)]]
    if drop:
        fields.append(T.StructField("dropped_tags", TEXTS))

    def look(source: str) -> dict:
        page = Page(source or "")
        row = {p.name: take(page, p) for p in picks}
        if drop:
            tags = [t for selector in drop for t in page.drop(selector)]
            row.update({p.name: take(page, p) for p in late})
            row["dropped_tags"] = list(dict.fromkeys(tags))
        return row

    return _read(pages, look, keep, fields, html)


def page_views(pages: DataFrame, views: dict[str, tuple[Iterable[str], list[Pick]]], html: str = "html") -> DataFrame:
    """Read every page once and look at it in several ways: each view removes its own elements from the whole page.

    A view's columns are named ``view_pick`` and ``view_dropped_tags``.
    """
    keep = [c for c in pages.columns if c != html]
    views = {name: (tuple(drop), list(late)) for name, (drop, late) in views.items()}
    fields = [pages.schema[c] for c in keep]
    for name, (_, late) in views.items():
        fields += [T.StructField(f"{name}_{p.name}", p.type()) for p in late] + [T.StructField(f"{name}_dropped_tags", TEXTS)]

    def look(source: str) -> dict:
        page, row = Page(source or ""), {}
        for name, (drop, late) in views.items():
            page.restore()
            tags = [t for selector in drop for t in page.drop(selector)]
            row.update({f"{name}_{p.name}": take(page, p) for p in late})
            row[f"{name}_dropped_tags"] = list(dict.fromkeys(tags))
        return row

    return _read(pages, look, keep, fields, html)
