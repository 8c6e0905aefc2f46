"""Records of catalog pages are put together within their rows."""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa

from oracle import SF
from sheaf.operators import fields as C
from sheaf.operators import generic as G
from sheaf.sources import catalog, many
from sheaf.sources.render import catalog_pages


def _field(label: str, value: str) -> str:
    return f'<div class="data-field"><div class="data-label">{label}</div><div class="data-value">{value}</div></div>'


def _entry(href: str, name: str, role: str = "") -> str:
    shown = f'<small class="light"><em>{role}</em></small>' if role else ""
    return f'<div class="item-entries"><a href="{href}"><span switch="x">{name}</span></a>{shown}</div>'


COMPANIES = _field("Manufacturer", _entry("/m/1", "x")) + _field("Distributor", _entry("/d/1", "Cd") + _entry("/d/2", "cd")) + _field("Company", _entry("/c/1", "Ab", "Painters") + _entry("/c/2", "aB", "painter") + _entry("#", " "))
SHOWN = '<a class="time">{}</a>'
PAGES = [
    COMPANIES, _field("Releases", SHOWN.format("1/2/2020")) + _field("", SHOWN.format("3/2021")) + _field("", "") + _field("", SHOWN.format("4/2021")), _field("Title", '<a switch="x">T</a>') * 2 + _field("Owned by", "1,234 x") + _field("Bogus", "1"),
    _field("Artists", _entry("/a/1", "in", "Odd") + "x" + _field("Artist", _entry("/a/9", "in"))), '<div class="item-linked-group"><div class="item-linked-item"><a href="/item/7" title="q"></a></div></div>', "", None,
]


def test_records_need_no_other_row(spark):
    """five shuffles put a record together from tables of its parts."""
    pages = catalog_pages(spark.read.parquet(f"{SF}/part.parquet"))
    plan = G.assemble(G.records(pages, G.SITES["catalog"], tuple(dict.fromkeys((*G.EXTRACT_PARTS, *C.RECORD_PARTS)))), G.SITES["catalog"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1  # the pages, dealt


def test_records_have_what_the_tables_of_parts_have(spark):
    odd = spark.createDataFrame(list(enumerate(PAGES, -10)), "page_id bigint, html string")
    pages = catalog_pages(spark.read.parquet(f"{SF}/part.parquet").limit(50)).unionByName(odd)
    got = {r.page_id: r for r in G.extract_catalog(pages).collect()}
    assert len(got) == 50 + len(PAGES)
    read = catalog.with_fields(pages)
    table = C.field_table(read)
    for name, rows in (("companies", C.entries(table, "company", "Manufacturer")), ("artists", C.entries(table, "artist", "Unknown")), ("releases", C.releases(table)), ("related_items", C.related_items(read))):
        want: dict = {}
        for r in rows.orderBy("page_id", "pos").drop("pos").collect():
            want.setdefault(r[0], []).append(tuple(r)[1:])
        assert {k: [tuple(x) for x in r[name]] for k, r in got.items() if r[name] is not None} == want
    parts = {r.page_id: r.asDict() for r in C.catalog_fields(table).collect()}
    for k, r in got.items():
        p = parts.get(k, {})
        assert all(r[c] == p.get(c) for c in (*C.KEYS, "tags", "unknown_labels")) and (r.community_stats.owned if r.community_stats else None) == p.get("owned")
    assert [tuple(c) for c in got[-10].companies] == [("Ab", "Painter", 1), ("Cd", "Distributor", 1)]
    assert [(r.date, r.is_rerelease) for r in got[-9].releases] == [(datetime.date(2020, 1, 2), False), (datetime.date(2021, 3, 1), True)]
    assert got[-10].manufacturer == "Ab" and got[-8].name == "T" and got[-4].companies is None


def test_tags_are_tried_once_for_all_that_is_asked(monkeypatch):
    """every part of a field tried each tag of 500 pages anew."""
    html = pa.array([_field("Company", _entry("/c/1", "Ab", "Painters")) + '<a href="/item/3" title="Buy (1)">x</a>'] * 3)
    made, odd = catalog.columns(C.RECORD_PARTS)
    pages, _ = many.read(html, odd)
    monkeypatch.setattr(pages, "where", None)
    assert len(made(pages)[0]) == 3
    assert np.array_equal(pages.kind("a"), np.array([h["tag"] == "a" for h in pages.heads])[pages.head])
