"""Pages read without a parser, references without a semicolon, and queries that parse each page once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oracle import SF, same
from sheaf.functions import rules
from sheaf.queries import ORACLES, QUERIES
from sheaf.sources import catalog, dom

PLAIN = ["", "a", "<p>x<p>y</p>z", '<html><title>a &amp; b</title><script>x = "</p>"; a<b</script><!-- c --><ul><li>1<li>2</ul><br><a HREF="/x" href="/y" class="b c">t&eacute;</a></html>', "<!DOCTYPE html><td>1<tr><td>2</table>"]
ODD = ["a < b", "<br/>", "<a href='x'>y</a>", '<a title="a>b">y</a>', '<a href="?a&b">y</a>', "<title>a<b>c</b></title>", "<textarea><b></textarea>", "<script>never ends", "<p", "<!-->x", "</ p>", "<script><!-- <script> --></script>", "\0<p>"]


@pytest.mark.parametrize("html", PLAIN)
def test_plain_pages_as_the_parser_reads_them(html):
    assert dom._plain(html) == dom._parsed(html)


@pytest.mark.parametrize("html", ODD)
def test_other_pages_are_left_to_the_parser(html):
    assert dom._plain(html) is None and dom.parse(html) == dom._parsed(html)


def test_references_without_semicolon_are_text_where_asked():
    assert [dom.closed(x) for x in ("a&amp", "&amp;&#39;&#x41;&lt;", "&notit;", "<script>a && b</script>&", None)] == ["a&amp;amp", "&amp;&#39;&#x41;&lt;", "&amp;notit;", "<script>a && b</script>&amp;", None]


def _cut_headings(spark, tmp_path) -> str:
    rows = [(k, f"https://example.net/{k}", f"<html><body><article><h1>{h}</h1><p>x</article></body></html>") for k, h in enumerate(("A &amp;&amp", "B&lt", "C &amp;lt; d", "&#39;E&quot;", "F & G"), 1)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet(f"{SF}/part.parquet").limit(20).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["generic_extract", "page_table", "sites_extract"])
def test_headings_cut_inside_a_reference(spark, tmp_path, name):
    folder = _cut_headings(spark, tmp_path)
    sql = ORACLES[name]
    for table in ("pages", "part"):
        sql = sql.replace(f"from {table}", f"from read_parquet('{folder}/{table}.parquet/*.parquet')")
    same(spark, QUERIES[name], sql, folder)


@pytest.mark.parametrize("name", ["artists", "companies", "catalog_fields", "releases"])
def test_each_page_is_parsed_once(spark, name):
    assert QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_a_query_reads_only_the_parts_it_needs():
    page = dom.Page('<div class="data-field"><div class="data-label">L</div><div class="data-value">v</div></div>')
    assert catalog.recorder(("label",), related=False)(page) == {"fields": [{"label": "L"}], "related": []}
    whole = catalog.record(page)["fields"][0]
    assert tuple(whole) == tuple(catalog.PARTS) and (whole["label"], whole["value"]) == ("L", "v")


@pytest.mark.parametrize("table,found", [(rules.LABELS, rules.label_rule), (rules.ROLES, rules.role_name)])
def test_usual_spellings_are_looked_up_as_the_patterns_decide(spark, table, found):
    usual = sorted({s for p, *_ in table for s in rules._spellings(p)})
    texts = usual + [x.upper() for x in usual] + ["", "owned  by", "Releases View all (+3)hide", "top 10", "s", "ſculptor", "Kircle"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    slow = rules._tried(F.col("t"), [(p, i) for i, (p, *_) in enumerate(table)], lambda r: F.lit(r[0]))
    got = rows.select("t", found(F.col("t")).alias("quick"), slow.alias("n")).collect()
    assert len(usual) > 20
    for r in got:
        want = None if r.n is None else table[r.n]
        if table is rules.LABELS:
            assert (r.quick and (r.quick.prio - 1, r.quick.strategy)) == (want and (r.n, want[1]))
        else:
            assert r.quick == (want[1] if want else r.t)


def test_spread_deals_rows_by_their_number(spark):
    rows = spark.range(0, 50_000, 1, 1)
    assert dom.spread(rows).rdd.getNumPartitions() == 5


def test_list_details_parse_each_page_once_and_keep_lists_without_items(spark):
    from sheaf.operators import lists

    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan("list_detail").count("MapInArrow") == 1
    pages = [(1, 1, '<h1 class="title">T</h1><div class="object-stats">0 items</div>'), (1, 2, '<span class="item-icon"><a href="/item/5">x</a><a href="/item/x">y</a></span>'), (2, 1, "<p>"), (3, 2, '<span class="item-icon"><a href="/item/6">x</a></span>')]
    rows = dom.with_nodes(spark.createDataFrame(pages, "list_id bigint, page_no int, html string"), inner={"description": lists.DESCRIPTION})
    assert sorted(map(tuple, lists.detail(rows).collect())) == [(1, "T", 1, None, 1), (2, None, 0, None, 0)]


def test_a_list_row_keeps_only_its_own_nodes(spark):
    from sheaf.operators import lists

    pages = dom.with_nodes(spark.createDataFrame([(1, "<p>before</p>" + '<div class="dgst-wrapper"><b>x</b></div>' * 3)], "page_no int, html string"))
    assert [len(r.cut.nodes) for r in pages.select(lists._cut(dom.find(F.col("nodes"), dom.cls("dgst-wrapper"))).alias("cut")).collect()] == [3, 3, 3]
