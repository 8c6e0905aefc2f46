"""Pages parsed once, into an array of nodes that column expressions select from."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import trim

#: Elements without an end tag, and those whose start ends an open one of the same kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in "div ul ol table h1 h2 h3 h4 h5 h6 section article header footer nav form pre blockquote".split()}
SCOPE = frozenset("div ul ol table section article body td".split())
NODES = "array<struct<id: int, parent: int, stop: int, tag: string, classes: array<string>, attrs: map<string, string>, text: string>>"


def _shut(nodes, open_, tags, scope=frozenset()):
    """End the innermost open node of ``tags`` that no open node of ``scope`` is in front of, and all inside it."""
    for i in range(len(open_) - 1, -1, -1):
        if open_[i]["tag"] in tags:
            for n in open_[i:]:
                n["stop"] = len(nodes)
            del open_[i:]
            return
        if open_[i]["tag"] in scope:
            return


class _Tree(HTMLParser):
    """Nodes in document order; the descendants of node x are those with x.id < id < x.stop."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open = [], []

    def add(self, tag, attrs, text):
        n = {"id": len(self.nodes), "parent": self.open[-1]["id"] if self.open else -1, "stop": len(self.nodes) + 1, "tag": tag, "classes": (attrs.get("class") or "").split(), "attrs": list(attrs.items()), "text": text}
        self.nodes.append(n)
        return n

    def shut(self, tags, scope=frozenset()):
        _shut(self.nodes, self.open, tags, scope)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self.shut(CLOSES[tag], SCOPE - CLOSES[tag])
        n = self.add(tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag):
        self.shut({tag})

    def handle_data(self, data):
        self.add("#text", {}, data)


_HEAD = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9_:.-]*(?:="[^"<>&]*")?)*)[ \t\n\r\f]*|!--[^<>-]*--|!(?i:doctype)[^<>"'\[\]-]*""")
_ATTR = re.compile(r'([a-zA-Z][a-zA-Z0-9_:.-]*)(?:="([^"]*)")?')
_RAW = frozenset(("script", "style"))
_SPECIAL = frozenset("textarea iframe noembed noframes xmp plaintext noscript svg math".split())
#: Tags as they are spelled, with what they say, since pages repeat them; not more than these are kept.
_heads: dict[str, tuple | None] = {}
MAX_HEADS, MAX_HEAD = 20_000, 500


def _head(text: str) -> tuple | None:
    """What a tag says: 1 for a start, 2 for an end, 0 for what is no node; null for what only the parser can read."""
    m = _HEAD.fullmatch(text)
    if m is None or (m[1] and m[3]):
        return None
    if m[2] is None:
        return 0, "", [], [], None, None
    name = m[2].lower()
    if m[1]:
        return 2, name, [], [], None, None
    attrs = {k.lower(): v for k, v in reversed(_ATTR.findall(m[3]))}
    return (1, name, attrs.get("class", "").split(), list(attrs.items()), CLOSES.get(name), SCOPE - CLOSES.get(name, set())) if name not in _SPECIAL else None


def head(text: str) -> tuple | None:
    """``_head``, kept."""
    found = _heads.get(text, 0)
    if found == 0:
        found = _head(text)
        if len(text) <= MAX_HEAD:
            if len(_heads) >= MAX_HEADS:
                _heads.clear()
            _heads[text] = found
    return found


def _plain(html: str) -> list[dict] | None:
    """The nodes of a page that is written in the plainest way, without a parser; null for any other page."""
    if "\0" in html:
        return None
    pieces = html.split("<")
    nodes, open_, raw, title, none = [], [], None, False, []
    add, known = nodes.append, _heads.get
    if pieces[0]:
        nodes.append({"id": 0, "parent": -1, "stop": 1, "tag": "#text", "classes": [], "attrs": [], "text": unescape(pieces[0])})
    for piece in pieces[1:]:
        text, _, data = piece.partition(">")
        if raw is not None:
            if text.lower().rstrip(" \t\n\r\f") != "/" + open_[-1]["tag"]:
                if text[: len(open_[-1]["tag"]) + 1].lower() == "/" + open_[-1]["tag"] or text.startswith("!--"):
                    return None
                raw += "<" + piece
                continue
            if raw:
                nodes.append({"id": len(nodes), "parent": open_[-1]["id"], "stop": len(nodes) + 1, "tag": "#text", "classes": [], "attrs": [], "text": raw})
            raw = None
        if not _:
            return None
        said = known(text, 0)
        if said == 0:
            said = head(text)
        if said is None:
            return None
        kind, tag, classes, attrs, closes, scope = said
        if title and (kind, tag) != (2, "title"):
            return None
        title = False
        if kind == 1:
            if closes and open_:
                _shut(nodes, open_, closes, scope)
            k = len(nodes)
            n = {"id": k, "parent": open_[-1]["id"] if open_ else -1, "stop": k + 1, "tag": tag, "classes": classes, "attrs": attrs, "text": None}
            add(n)
            if tag not in VOID:
                open_.append(n)
            if tag in _RAW:
                raw = data
                continue
            title = tag == "title"
        elif kind == 2:
            if open_ and open_[-1]["tag"] == tag:
                open_.pop()["stop"] = len(nodes)
            else:
                _shut(nodes, open_, (tag,))
        if data:
            k = len(nodes)
            add({"id": k, "parent": open_[-1]["id"] if open_ else -1, "stop": k + 1, "tag": "#text", "classes": none, "attrs": none, "text": unescape(data) if "&" in data else data})
    if raw is not None or title:
        return None
    for n in open_:
        n["stop"] = len(nodes)
    return nodes


def _parsed(html: str) -> list[dict]:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    for n in tree.open:
        n["stop"] = len(tree.nodes)
    return tree.nodes


def parse(html: str | None) -> list[dict]:
    nodes = _plain(html or "")
    return _parsed(html) if nodes is None else nodes


_REFERENCE = re.compile(r"(?is)<(script|style)\b.*?</\1\b|<!--.*?-->|&(#[0-9]+;|#x[0-9a-f]+;|[a-z][a-z0-9]*;)?")


def closed(html: str | None) -> str | None:
    """``html`` in which a character reference without its semicolon is text, so that ``&amp`` stays as it is (browsers
    read some of those as if they were closed)."""
    if html is None or "&" not in html:
        return html
    return _REFERENCE.sub(lambda m: m[0] if m[0][0] == "<" or (m[2] and (m[2][0] == "#" or m[2] in html5)) else "&amp;" + m[0][1:], html)


#: Pages a task parses, at most, where ``spread`` deals them; and tasks of a core, at most.
PAGES_A_TASK, TASKS_A_CORE = 10_000, 16


def spread(pages: DataFrame) -> DataFrame:
    """``pages`` (a plain scan) dealt evenly over the cores.

    A file's row groups decide how many tasks have rows, whatever its splits, so a large file could keep one core busy; the
    rows are counted (by the files' footers) so that tasks stay short as tables grow."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(min(max(cores, -(-pages.count() // PAGES_A_TASK)), cores * TASKS_A_CORE))


def columnar(values: list, kind: pa.DataType) -> pa.Array:
    """``pa.array(values, kind)``, a column of the innermost values at a time: structs are dicts, maps lists of pairs."""
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        ends, n = [], 0
        for v in values:
            ends.append(None if v is None else n)
            n += len(v or ())
        flat = [x for v in values if v for x in v]
        offsets = pa.array([*ends, n], pa.int32())
        if pa.types.is_list(kind):
            return pa.ListArray.from_arrays(offsets, columnar(flat, kind.value_type), type=kind)
        return pa.MapArray.from_arrays(offsets, columnar([k for k, _ in flat], kind.key_type), columnar([v for _, v in flat], kind.item_type), type=kind)
    if pa.types.is_struct(kind) and kind.num_fields:
        gone = [v is None for v in values]
        if any(gone):
            return pa.array(values, kind)
        return pa.StructArray.from_arrays([columnar([v[f.name] for v in values], f.type) for f in kind], fields=list(kind))
    return pa.array(values, kind)


#: Pages whose nodes a task holds at a time.
AT_ONCE = 50


def few_at_once(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of at most ``most`` rows, copied, so that none is held while the next one is read."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.take(pa.array(np.arange(i, min(i + most, b.num_rows))))
        del b


@contextmanager
def _no_cycles() -> Iterator[None]:
    """No search for cycles meanwhile: nodes are many and have none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def with_nodes(pages: DataFrame, html_col: str = "html", inner: dict[str, str] | None = None) -> DataFrame:
    """``pages`` with a column ``nodes`` in place of the html, which goes no further.

    ``inner`` names further columns: the markup inside the first match of a selector, null without one."""
    tests = {k: [[_test(*step) for step in steps] for steps in selector_parts(css)] for k, css in (inner or {}).items()}
    keep = [c for c in pages.columns if c != html_col]
    kind = pa.list_(pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("stop", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_at_once(batches):
            with _no_cycles():
                read = [Page(h) for h in part.column(len(keep)).to_pylist()]
            more = [pa.array([x.inner(x.select(test)) for x in read], pa.string()) for test in tests.values()]
            made = columnar([x.nodes for x in read], kind)
            del read
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), made, *more], names=[*keep, "nodes", *tests])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), f"nodes {NODES}", *(f"{k} string" for k in tests)])
    return pages.select(*keep, html_col).mapInArrow(run, schema)


class Page:
    """Small queries over one parsed page; a node's descendants are a slice of the page's nodes."""

    def __init__(self, html: str | None):
        self.nodes = parse(html)
        self.data = [n["text"] or "" for n in self.nodes]

    def below(self, box: dict) -> list[dict]:
        return self.nodes[box["id"] + 1 : box["stop"]]

    def text(self, box: dict | None) -> str | None:
        return None if box is None else "".join(self.data[box["id"] + 1 : box["stop"]])

    def inner(self, box: dict | None) -> str | None:
        """The markup inside a node, rebuilt from what was parsed."""
        if box is None:
            return None
        out, open_ = [], []
        for n in self.below(box):
            while open_ and open_[-1]["stop"] <= n["id"]:
                out.append(f"</{open_.pop()['tag']}>")
            if n["tag"] == "#text":
                out.append(escape(n["text"], quote=False))
                continue
            out.append("".join([f"<{n['tag']}", *(f' {k}="{escape(v)}"' for k, v in reversed(n["attrs"])), ">"]))
            if n["tag"] not in VOID:
                open_.append(n)
        return "".join([*out, *(f"</{n['tag']}>" for n in reversed(open_))])

    def joined(self, boxes: list[dict]) -> str:
        return "".join(map(self.text, boxes))

    @staticmethod
    def within(nodes: list[dict], boxes: list[dict]) -> list[dict]:
        """Those of ``nodes`` that are below one of ``boxes``, both in document order."""
        if not nodes or not boxes:
            return []
        out, k, stop = [], 0, -1
        for n in nodes:
            while k < len(boxes) and boxes[k]["id"] < n["id"]:
                stop, k = max(stop, boxes[k]["stop"]), k + 1
            if n["id"] < stop:
                out.append(n)
        return out

    def matches(self, selector: list[list[Callable[[dict], bool]]]) -> list[dict]:
        """All matches of any alternative, each once, in document order."""
        every = {}
        for parts in selector:
            found = [n for n in self.nodes if parts[0](n)]
            for test in parts[1:]:
                found = [n for n in self.within(self.nodes, found) if test(n)]
            every |= {n["id"]: n for n in found}
        return [every[k] for k in sorted(every)]

    def select(self, selector: list[list[Callable[[dict], bool]]]) -> dict | None:
        """The first match of the first alternative that has one."""
        for parts in selector:
            found = [n for n in self.nodes if parts[0](n)]
            for test in parts[1:]:
                found = [n for n in self.within(self.nodes, found) if test(n)]
            if found:
                return found[0]
        return None


_PART = re.compile(r"([\w-]+|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[*^]?=\"?[^\"\]]*\"?)?\]|:checked)*)")
_BIT = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^]?=)\"?([^\"\]]*)\"?)?\]|(:checked)")


def selector_parts(selector: str) -> list[list[tuple[str, list[tuple[str, str, str]]]]]:
    """Alternatives of steps of a tag (or \\*) and conditions (attribute, operator, value); anything else is an error."""
    out = []
    for alternative in selector.split(","):
        steps = []
        for part in alternative.split():
            m = _PART.fullmatch(part)
            if not m:
                raise ValueError(f"unsupported selector {part!r}")
            bits = [("class", "word", c) if c else ("id", "=", i) if i else ("checked", "has", "") if checked else (name, op or "has", value) for c, i, name, op, value, checked in _BIT.findall(m[2])]
            steps.append((m[1] or "*", bits))
        if not steps:
            raise ValueError(f"unsupported selector {selector!r}")
        out.append(steps)
    return out


def _test(tag_name: str, bits: list[tuple[str, str, str]]) -> Callable[[dict], bool]:
    how = {"has": lambda a, v: True, "=": lambda a, v: a == v, "*=": lambda a, v: v in a, "^=": lambda a, v: a.startswith(v), "word": lambda a, v: v in a.split()}

    def run(n: dict) -> bool:
        if (n["tag"] == "#text" if tag_name == "*" else n["tag"] != tag_name) or (bits and not n["attrs"]):
            return False
        attrs = dict(n["attrs"]) if bits else {}
        return all(name in attrs and how[op](attrs[name], value) for name, op, value in bits)

    return run


def compiled(css: str) -> list[list[Callable[[dict], bool]]]:
    return [[_test(*step) for step in steps] for steps in selector_parts(css)]


def _as(a: pa.Array, kind: pa.DataType) -> pa.Array:
    """``a`` in a type; lists of nothing in any type of list."""
    return pa.ListArray.from_arrays(a.offsets, pa.nulls(0, kind.value_type), type=kind) if pa.types.is_null(a.type.value_type) else a.cast(kind)


#: What ``with_records`` is told for many pages at once: their columns, and which pages (a mask) are to be read one by one.
Columns = tuple[Callable, Callable]
#: Plain pages that are read at once, at most, and bytes of their markup unless one page alone has more.
MANY, MANY_BYTES = 500, 2_000_000


def with_records(
    pages: DataFrame, record: Callable[[Page], dict], schema: str, selectors: dict[str, tuple[str, str | None]], html_col: str = "html", programs: str | None = None, attributes: dict[str, str | None] | None = None,
    strict: bool = False, columns: Columns | None = None,
) -> DataFrame:
    """One parse of each page: ``pages`` with, in place of the html, ``found`` (of each selector's first match the
    attribute asked for, else its text) and the columns of ``record``, which has the types of ``schema``.

    ``programs`` names a struct column with further selectors, each page's own: a task compiles each text once.  Of their
    matches ``attributes`` tells what is asked for; a null selector finds nothing.  ``strict``: see ``closed``.

    ``columns`` gives what ``record`` does for many plain pages at once, all columns but ``found``, and which pages it can't
    read; those, and pages that aren't plain, go to ``record``.
    """
    from . import many

    own = attributes or {}
    keep = [c for c in pages.columns if c != html_col]
    names = ", ".join(f"{k}: string" for k in (*selectors, *own)) or "none: string"
    head = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    table = T.StructType.fromDDL(f"{head}found struct<{names}>, {schema}")
    kinds = [to_arrow_type(f.dataType) for f in table.fields[len(keep) :]]

    tests = {k: (compiled(css), attribute) for k, (css, attribute) in selectors.items()}

    def one(html: str | None, asked: dict) -> tuple[dict, dict]:
        page, found = Page(closed(html) if strict else html), {}
        for k, (parts, attribute) in asked.items():
            n = page.select(parts)
            found[k] = page.text(n) if attribute is None else dict(n["attrs"]).get(attribute) if n else None
        return found, record(page)

    def each_read(html: list, asked: list[dict]) -> list[pa.Array]:
        rows = [one(*x) for x in zip(html, asked, strict=True)]
        made = [pa.array([f for f, _ in rows], kinds[0])]
        return made + [columnar([r[f.name] for _, r in rows], kind) for f, kind in zip(table.fields[len(keep) + 1 :], kinds[1:], strict=True)]

    def at_once(html: pa.Array) -> list[pa.Array]:
        pages, plain = many.read(pa.array(list(map(closed, html.to_pylist())), pa.string()) if strict else html, columns[1])
        found = []
        for parts, attribute in tests.values():
            nodes = pages.select(parts)
            found.append(pages.texts_of(nodes) if attribute is None else pages.attrs(nodes, attribute))
        made = [pa.StructArray.from_arrays(found, fields=list(kinds[0])) if found else pa.array([{}] * len(plain), kinds[0])]
        made += [_as(a, kind) for a, kind in zip(columns[0](pages), kinds[1:], strict=True)]
        if len(plain) == len(html):
            return made
        others = np.setdiff1d(np.arange(len(html)), plain)
        order = pa.array(np.argsort(np.concatenate([plain, others])))
        rest = [each_read(html.take(pa.array(others[i : i + AT_ONCE])).to_pylist(), [tests] * len(others[i : i + AT_ONCE])) for i in range(0, len(others), AT_ONCE)]
        return [pa.concat_arrays([a, *(r[k] for r in rest)]).take(order) for k, a in enumerate(made)]

    def parts_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if columns is None or programs is not None:
            yield from (b.slice(i, AT_ONCE) for i in range(0, b.num_rows, AT_ONCE))
            return
        sizes, start, held = pc.fill_null(pc.binary_length(b.column(len(keep))), 0).to_pylist(), 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > MANY_BYTES or i - start >= MANY):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}

        def asked(row: dict) -> dict:
            for css in row.values():
                if css and css not in known:
                    known[css] = compiled(css)
            return tests | {k: (known[row[k]], a) for k, a in own.items() if row.get(k)}

        for b in batches:
            for part in parts_of(b):
                with _no_cycles():
                    if columns is not None and programs is None:
                        made = at_once(part.column(len(keep)))
                    else:
                        html = part.column(len(keep)).to_pylist()
                        made = each_read(html, [tests] * len(html) if programs is None else [asked(r or {}) for r in part.column(keep.index(programs)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *made], names=table.names)

    return pages.select(*keep, html_col).mapInArrow(run, table)


Test = Callable[[Column], Column]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; in a lambda's body an expression is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tag(*names: str) -> Test:
    return lambda n: n["tag"].isin(*names)


def cls(*names: str) -> Test:
    def test(n: Column) -> Column:
        out = F.array_contains(n["classes"], names[0])
        for x in names[1:]:
            out = out & F.array_contains(n["classes"], x)
        return out

    return test


def attr(n: Column, name: str) -> Column:
    return F.try_element_at(n["attrs"], F.lit(name))


def has(name: str) -> Test:
    return lambda n: attr(n, name).isNotNull()


def both(*tests: Test) -> Test:
    def test(n: Column) -> Column:
        out = tests[0](n)
        for t in tests[1:]:
            out = out & t(n)
        return out

    return test


def inside(n: Column, box: Column) -> Column:
    return (n["id"] > box["id"]) & (n["id"] < box["stop"])


def find(nodes: Column, test: Test, box: Column | None = None) -> Column:
    """Matching nodes in document order, below ``box`` if given."""
    if box is None:
        return F.filter(nodes, test)
    return let(box, lambda b: F.filter(nodes, lambda n: inside(n, b) & test(n)))


def below(nodes: Column, outer: Test, inner: Test, box: Column | None = None) -> Column:
    """The descendant combinator: nodes of ``inner`` below one of ``outer``."""
    return let(find(nodes, outer, box), lambda above: F.filter(nodes, lambda n: inner(n) & F.exists(above, lambda o: inside(n, o))))


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _raw(nodes: Column, box: Column) -> Column:
    return F.array_join(F.transform(F.filter(nodes, lambda n: (n["tag"] == "#text") & inside(n, box)), lambda n: n["text"]), "")


def text(nodes: Column, box: Column) -> Column:
    """All text below a node, trimmed; null for a null node."""
    return trim(let(box, lambda b: F.when(b.isNotNull(), _raw(nodes, b))))


def texts(nodes: Column, boxes: Column) -> Column:
    return F.transform(boxes, lambda b: trim(_raw(nodes, b)))


def joined(nodes: Column, boxes: Column) -> Column:
    """The text of several nodes in one, trimmed; empty for none."""
    return trim(F.array_join(F.transform(boxes, lambda b: _raw(nodes, b)), ""))


def without(nodes: Column, test: Test) -> Column:
    """Text that no matching node holds."""
    kept = let(find(nodes, test), lambda out: F.filter(nodes, lambda n: (n["tag"] == "#text") & ~F.exists(out, lambda h: inside(n, h))))
    return trim(F.array_join(F.transform(kept, lambda n: n["text"]), ""))


def visible(nodes: Column) -> Column:
    """Text outside script, style and head."""
    return without(nodes, tag("script", "style", "head"))


def own_text(nodes: Column, box: Column) -> Column:
    own = let(box, lambda b: F.filter(nodes, lambda n: (n["tag"] == "#text") & (n["parent"] == b["id"])))
    return trim(F.array_join(F.transform(own, lambda n: n["text"]), ""))
