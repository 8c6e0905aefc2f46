"""Pages read many at once give what each gives by itself."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import SF
from sheaf.operators import generic
from sheaf.sources import catalog, dom, many
from sheaf.sources.render import catalog_pages

FIELD = '<div class="data-field"><div class="data-label">{}</div><div class="data-value">{}</div></div>'
PLAIN = ["", '<div></div><p class="data-field">a &amp; b<!-- c -->d</p>', '<style>"<p>"</style>' + FIELD.format("A", 'x<a switch href="/1">y<img></a><small class="light"><em>z</em></small>') * 2]
ODD = ["a", "<p>x<p>y</p>", "<b><i></b></i>", "<a href='x'>y</a>", "<script>a", "<p", FIELD.format("A", FIELD.format("B", "<a><a></a></a>"))]


def _rows(pages, whole):
    read = catalog.with_records(pages, catalog.record, catalog.FIELDS, generic.selectors(generic.SITES["catalog"]), columns=catalog.columns(tuple(catalog.PARTS)) if whole else None)
    return sorted(read.collect(), key=lambda r: r.page_id)


def test_catalog_pages_at_once_as_one_by_one(spark):
    odd = spark.createDataFrame(list(enumerate([*PLAIN, *ODD, None], -20)), "page_id bigint, html string")
    pages = catalog_pages(spark.read.parquet(f"{SF}/part.parquet")).unionByName(odd).coalesce(2).where(F.lit(True))
    assert _rows(pages, True) == _rows(pages, False)


@pytest.mark.parametrize("parts", [(k,) for k in catalog.PARTS] + [()])
def test_parts_at_once(spark, parts):
    made, odd = catalog.columns(parts, not parts)
    pages, plain = many.read(pa.array([*ODD, *PLAIN, *ODD]), odd)
    assert plain.tolist() == [len(ODD) + k for k in range(len(PLAIN))]
    want = [catalog.recorder(parts, not parts)(dom.Page(h)) for h in PLAIN]
    nothing, none = many.read(pa.array(ODD), odd)
    assert len(none) == 0 and [len(a) for a in made(nothing)] == [0, 0]
    assert [a.to_pylist() for a in made(pages)] == [[r["fields"] for r in want], [r["related"] for r in want]]


def test_plain_pages_are_not_parsed_one_by_one(spark, monkeypatch):
    made, odd = catalog.columns(("label",), False)
    monkeypatch.setattr(dom, "parse", None)
    pages, plain = many.read(pa.array([FIELD.format("A", "b")] * 3), odd)
    assert len(plain) == 3 and made(pages)[0].to_pylist() == [[{"label": "A"}]] * 3
