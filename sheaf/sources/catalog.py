"""What catalog pages say, as raw text: their labelled fields and related items, from one parse of each page."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .dom import Columns, Page, with_records
from .many import Pages

ENTRY = "struct<at: int, name: string, link_text: string, href: string, role: string>"
TYPES = dict.fromkeys(("label", "first_label", "first_value", "entry_text", "value", "kind", "scale", "height", "direct", "link", "date", "variant", "plain", "product", "buy_title", "buy_text", "boxed_text"), "string")
TYPES |= dict.fromkeys(("ord", "after", "previous", "boxes"), "int") | dict.fromkeys(("own", "spans", "tags", "roles", "smalls"), "array<string>") | dict.fromkeys(("grouped", "single"), f"array<{ENTRY}>")
RELATED = "related array<struct<at: int, relation: string, href: string, title: string, text: string, image: string>>"


def attr(n: dict, name: str) -> str | None:
    for k, v in n["attrs"]:
        if k == name:
            return v
    return None


def _entry(page: Page, link: dict | None, at: int, role: str | None, switches: list[dict]) -> dict:
    spans = page.within(switches, [link]) if link else []
    return {"at": at, "name": page.joined(spans) if spans else None, "link_text": page.text(link), "href": attr(link, "href") if link else None, "role": role}


class _Field:
    """Raw text behind one field, asked for by name; null where the element isn't there."""

    def __init__(self, page: Page, field: dict, after: int | None, previous: int | None = None):
        self.page, self.ord, self.after, self.previous = page, field["id"], after, previous
        self.labels, self.values, self.boxes = [], [], []
        kinds = self.kinds = {"a": [], "span": [], "small": [], "em": [], "strong": [], "meta": [], "#text": []}
        for n in page.below(field):
            tag, classes = n["tag"], n["classes"]
            if tag in kinds:
                kinds[tag].append(n)
            if classes:
                if "data-label" in classes:
                    self.labels.append(n)
                if "data-value" in classes:
                    self.values.append(n)
                if "item-entries" in classes:
                    self.boxes.append(n)
        self.links, self.switches = kinds["a"], [n for n in kinds["span"] if attr(n, "switch") is not None]
        self.lights = [n for n in kinds["small"] if "light" in n["classes"]]

    def valued(self, kind: str) -> list[dict]:
        """Elements of a kind inside the values."""
        return self.page.within(self.kinds[kind], self.values)

    def roles_in(self, boxes: list[dict] | None) -> list[dict]:
        """Roles, of some nodes or (null) of the whole field."""
        within = self.page.within
        ems, lights = self.kinds["em"], self.lights
        return within(ems, lights) if boxes is None else within(within(ems, boxes), within(lights, boxes))

    def first(self, found: list[dict]) -> str | None:
        return self.page.text(found[0]) if found else None

    def all(self, found: list[dict]) -> str | None:
        return self.page.joined(found) if found else None

    def texts(self, found: list[dict]) -> list[str]:
        return [self.page.text(n) for n in found]

    def own(self) -> list[str]:
        return ["".join(n["text"] for n in self.kinds["#text"] if n["parent"] == x["id"]) for x in self.values]

    def spans(self) -> list[str]:
        within = self.page.within
        return self.texts(within(within(self.switches, self.values), within(self.valued("a"), within(self.boxes, self.values))))

    def direct(self) -> str | None:
        of_values = {n["id"] for n in self.values}
        return self.all([n for n in self.valued("a") if n["parent"] in of_values and attr(n, "switch") is not None])

    def grouped(self) -> list[dict]:
        page, out = self.page, []
        for b in self.boxes:
            links = page.within(self.links, [b])
            out.append(_entry(page, links[0] if links else None, b["id"], page.joined(self.roles_in([b])), self.switches))
        return out

    def plain(self) -> str:
        inner = self.valued("#text")
        shut = sorted(self.valued("a") + self.valued("small"), key=lambda n: n["id"])
        hidden = {n["id"] for n in self.page.within(inner, shut)}
        return "".join(n["text"] for n in inner if n["id"] not in hidden)

    def buys(self) -> list[dict]:
        return [n for n in self.valued("a") if (attr(n, "title") or "").startswith("Buy")]

    def linked(self, name: str) -> list[dict]:
        return [n for n in self.valued("a") if name in n["classes"]]


#: How each part of a field is found.
PARTS = {
    "ord": lambda f: f.ord,
    "after": lambda f: f.after,
    "previous": lambda f: f.previous,
    "label": lambda f: f.page.joined(f.labels),
    "first_label": lambda f: f.first(f.labels),
    "first_value": lambda f: f.first(f.values),
    "entry_text": lambda f: f.first(f.page.within(f.switches, f.boxes)),
    "value": lambda f: f.page.joined(f.values),
    "own": _Field.own,
    "spans": _Field.spans,
    "kind": lambda f: f.all([n for n in f.valued("span") if (attr(n, "class") or "").startswith("item-category")]),
    "scale": lambda f: f.all(f.linked("item-scale")),
    "height": lambda f: f.all(f.valued("strong")),
    "direct": _Field.direct,
    "link": lambda f: f.first(f.valued("a")),
    "tags": lambda f: f.texts(f.valued("a")),
    "boxes": lambda f: len(f.boxes),
    "roles": lambda f: f.texts(f.roles_in(None)),
    "grouped": _Field.grouped,
    "single": lambda f: [_entry(f.page, n, n["id"], None, f.switches) for n in f.page.within(f.links, f.boxes)],
    "date": lambda f: f.first(f.linked("time")),
    "variant": lambda f: f.first(f.roles_in(f.values)),
    "plain": _Field.plain,
    "smalls": lambda f: f.texts(f.valued("small")),
    "product": lambda f: next((attr(n, "content") for n in f.valued("meta") if attr(n, "itemprop") == "productID"), None),
    "buy_title": lambda f: attr(f.buys()[0], "title") if f.buys() else None,
    "buy_text": lambda f: f.all(f.buys()),
    "boxed_text": lambda f: f.all(f.linked("tbx-window")),
}


def recorder(parts: tuple[str, ...], related: bool = True) -> Callable[[Page], dict]:
    """A function of a page: its fields, each with ``parts``, and its related items, none unless asked for."""
    asked = [(k, PARTS[k]) for k in parts]

    def record(page: Page) -> dict:
        last: dict[int, int] = {}  # of each parent the element before
        fields, items, previous = [], [], None
        for n in page.nodes:
            if n["text"] is not None:
                continue
            classes = n["classes"]
            if classes:
                if asked and "data-field" in classes:
                    field = _Field(page, n, last.get(n["parent"]), previous)
                    fields.append({k: part(field) for k, part in asked})
                    previous = n["id"]
                if related and "item-linked-group" in classes:
                    items += _related(page, n)
            last[n["parent"]] = n["id"]
        return {"fields": fields, "related": items}

    return record


def _related(page: Page, box: dict) -> list[dict]:
    inner, out = page.below(box), []
    kind = page.joined([x for x in inner if "item-linked-category" in x["classes"]])
    for item in (x for x in inner if "item-linked-item" in x["classes"]):
        link = next((x for x in page.below(item) if x["tag"] == "a" and "/item/" in (attr(x, "href") or "")), None)
        image = next((x for x in page.below(item) if x["tag"] == "img"), None)
        out.append({"at": item["id"], "relation": kind, "href": attr(link, "href") if link else None, "title": attr(link, "title") if link else None, "text": page.text(link), "image": attr(image, "src") if image else None})
    return out


record = recorder(tuple(PARTS))


class _Fields:
    """``_Field`` for the fields of many pages at once: masks over their nodes, and a value for each field."""

    def __init__(self, pages: Pages):
        self.p = pages
        self.ids = np.flatnonzero(pages.cls("data-field"))
        self.n, self.owner = len(self.ids), pages.owner(self.ids)

    def mine(self, mask: np.ndarray) -> np.ndarray:
        return mask & (self.owner >= 0)

    kind = lambda self, tag: self.mine(self.p.kind(tag))
    labels = cached_property(lambda self: self.mine(self.p.cls("data-label")))
    values = cached_property(lambda self: self.mine(self.p.cls("data-value")))
    boxes = cached_property(lambda self: self.mine(self.p.cls("item-entries")))
    links = cached_property(lambda self: self.kind("a"))
    switches = cached_property(lambda self: self.kind("span") & self.p.having("switch"))
    lights = cached_property(lambda self: self.kind("small") & self.p.cls("light"))
    valued_links = cached_property(lambda self: self.valued("a"))

    def valued(self, kind: str) -> np.ndarray:
        return self.p.within(self.kind(kind), self.values)

    def roles_in(self, boxes: np.ndarray | None) -> np.ndarray:
        within, ems = self.p.within, self.kind("em")
        return within(ems, self.lights) if boxes is None else within(within(ems, boxes), within(self.lights, boxes))

    def first(self, found: np.ndarray) -> pa.Array:
        ids = np.flatnonzero(found)
        return self.p.texts_of(self.p.firsts(ids, self.owner[ids], self.n))

    def joined(self, found: np.ndarray, empty: str | None = "") -> pa.Array:
        ids = np.flatnonzero(found)
        there = None if empty == "" else np.bincount(self.owner[ids], minlength=self.n) > 0
        return self.p.joined(ids, self.owner[ids], self.n, there)

    def all(self, found: np.ndarray) -> pa.Array:
        return self.joined(found, None)

    def texts(self, found: np.ndarray) -> pa.Array:
        ids = np.flatnonzero(found)
        return self.p.lists(self.p.texts_of(ids), self.owner[ids], self.n)

    def own(self) -> pa.Array:
        values = np.flatnonzero(self.values)
        texts = np.flatnonzero(self.p.is_text & (self.p.parent >= 0))
        texts = texts[self.values[self.p.parent[texts]]]
        group = np.searchsorted(values, self.p.parent[texts])
        order = np.argsort(group, kind="stable")
        return self.p.lists(self.p.joined(texts[order], group[order], len(values)), self.owner[values], self.n)

    def spans(self) -> pa.Array:
        within = self.p.within
        return self.texts(within(within(self.switches, self.values), within(self.valued_links, within(self.boxes, self.values))))

    def direct(self) -> pa.Array:
        found = self.valued_links & self.p.having("switch")
        return self.all(found & self.values[self.p.parent])

    def entries(self, links: np.ndarray, at: np.ndarray, role: pa.Array, owner: np.ndarray) -> pa.Array:
        """``_entry`` of links (ids, -1 for none), none below another, as a list for each field."""
        p, n = self.p, len(links)
        real = links[links >= 0]
        of_link = p.owner(real)
        spans = np.flatnonzero(self.switches & (of_link >= 0))
        group = np.flatnonzero(links >= 0)[of_link[spans]]
        name = p.joined(spans, group, n, np.bincount(group, minlength=n) > 0)
        made = [p.local(at), name, p.texts_of(links), p.attrs(links, "href"), role]
        return p.lists(pa.StructArray.from_arrays(made, names=["at", "name", "link_text", "href", "role"]), owner, self.n)

    def grouped(self) -> pa.Array:
        p, boxes = self.p, np.flatnonzero(self.boxes)
        of_box = p.owner(boxes)
        links, roles = np.flatnonzero(self.links & (of_box >= 0)), np.flatnonzero(self.roles_in(self.boxes))
        return self.entries(p.firsts(links, of_box[links], len(boxes)), boxes, p.joined(roles, of_box[roles], len(boxes)), self.owner[boxes])

    def single(self) -> pa.Array:
        links = np.flatnonzero(self.p.within(self.links, self.boxes))
        return self.entries(links, links, pa.nulls(len(links), pa.string()), self.owner[links])

    def plain(self) -> pa.Array:
        inner = self.p.within(self.mine(self.p.is_text), self.values)
        return self.joined(inner & ~self.p.within(inner, self.valued_links | self.valued("small")))

    def attr_of_first(self, found: np.ndarray, name: str) -> pa.Array:
        ids = np.flatnonzero(found)
        return self.p.attrs(self.p.firsts(ids, self.owner[ids], self.n), name)

    @cached_property
    def buys(self) -> np.ndarray:
        return self.valued_links & self.p.having("title", lambda v: v.startswith("Buy"))

    def linked(self, name: str) -> np.ndarray:
        return self.valued_links & self.p.cls(name)


#: ``PARTS`` for many pages at once.
MANY_PARTS = {
    "ord": lambda f: f.p.local(f.ids),
    "after": lambda f: f.p.local(f.p.before(f.ids)),
    "previous": lambda f: f.p.local(np.where(f.p.page[f.ids] == np.append(-1, f.p.page[f.ids])[:-1], np.append(-1, f.ids)[:-1], -1)),
    "label": lambda f: f.joined(f.labels),
    "first_label": lambda f: f.first(f.labels),
    "first_value": lambda f: f.first(f.values),
    "entry_text": lambda f: f.first(f.p.within(f.switches, f.boxes)),
    "value": lambda f: f.joined(f.values),
    "own": _Fields.own,
    "spans": _Fields.spans,
    "kind": lambda f: f.all(f.valued("span") & f.p.having("class", lambda v: v.startswith("item-category"))),
    "scale": lambda f: f.all(f.linked("item-scale")),
    "height": lambda f: f.all(f.valued("strong")),
    "direct": _Fields.direct,
    "link": lambda f: f.first(f.valued_links),
    "tags": lambda f: f.texts(f.valued_links),
    "boxes": lambda f: pa.array(np.bincount(f.owner[f.boxes], minlength=f.n)),
    "roles": lambda f: f.texts(f.roles_in(None)),
    "grouped": _Fields.grouped,
    "single": _Fields.single,
    "date": lambda f: f.first(f.linked("time")),
    "variant": lambda f: f.first(f.roles_in(f.values)),
    "plain": _Fields.plain,
    "smalls": lambda f: f.texts(f.valued("small")),
    "product": lambda f: f.attr_of_first(f.valued("meta") & f.p.having("itemprop", lambda v: v == "productID"), "content"),
    "buy_title": lambda f: f.attr_of_first(f.buys, "title"),
    "buy_text": lambda f: f.all(f.buys),
    "boxed_text": lambda f: f.all(f.linked("tbx-window")),
}


def _all_related(p: Pages) -> pa.Array:
    groups = np.flatnonzero(p.cls("item-linked-group"))
    of_group = p.owner(groups)
    kinds = np.flatnonzero(p.cls("item-linked-category") & (of_group >= 0))
    items = np.flatnonzero(p.cls("item-linked-item") & (of_group >= 0))
    of_item = p.owner(items)
    firsts = lambda mask: p.firsts(found := np.flatnonzero(mask & (of_item >= 0)), of_item[found], len(items))
    links = firsts(p.kind("a") & p.having("href", lambda v: "/item/" in v))
    relation = p.joined(kinds, of_group[kinds], len(groups)).take(pa.array(of_group[items]))
    made = [p.local(items), relation, p.attrs(links, "href"), p.attrs(links, "title"), p.texts_of(links), p.attrs(firsts(p.kind("img")), "src")]
    return p.lists(pa.StructArray.from_arrays(made, names=["at", "relation", "href", "title", "text", "image"]), p.page[items], p.size)


def columns(parts: tuple[str, ...], related: bool = True) -> Columns:
    """``recorder`` for many pages at once."""

    def made(p: Pages) -> list[pa.Array]:
        out = []
        if parts:
            fields = _Fields(p)
            rows = pa.StructArray.from_arrays([MANY_PARTS[k](fields) for k in parts], names=list(parts))
            out.append(p.lists(rows, p.page[fields.ids], p.size))
        else:
            out.append(pa.array([[]] * p.size, pa.list_(pa.null())))
        return [*out, _all_related(p) if related else pa.array([[]] * p.size, pa.list_(pa.null()))]

    def odd(p: Pages) -> np.ndarray:
        return np.logical_or.reduce([p.nested(p.cls(c)) for c in ("data-field", "item-entries", "item-linked-group", "item-linked-item")] + [p.nested(p.kind("a"))])

    return made, odd


def fields_schema(parts: tuple[str, ...]) -> str:
    """``FIELDS`` with these parts of a field only."""
    return f"fields array<struct<{', '.join(f'{k}: {TYPES[k]}' for k in parts)}>>, {RELATED}"


FIELDS = fields_schema(tuple(PARTS))


def with_fields(pages: DataFrame, selectors: dict[str, tuple[str, str | None]] | None = None, parts: tuple[str, ...] | None = None, related: bool = True, strict: bool = False) -> DataFrame:
    """``pages`` with found, fields and related in place of the html.

    ``parts`` names what is looked up of each field (all, if null; without any no field is read), ``related`` whether related
    items are: a query that needs little is spared the rest.  ``strict``: see ``dom.closed``."""
    if parts is None and related:
        return with_records(pages, record, FIELDS, selectors or {}, strict=strict, columns=columns(tuple(PARTS)))
    parts = tuple(PARTS) if parts is None else parts
    return with_records(pages, recorder(parts, related), fields_schema(parts or ("ord",)), selectors or {}, strict=strict, columns=columns(parts, related))
