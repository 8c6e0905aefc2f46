"""Lists and collections, rendered from customers and orders with 20 entries a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import lists as L
from ..sources import dom as D
from ..sources.render import html
from .registry import Tables, query

_LIST = (
    '<div class="dgst-wrapper"><div class="dgst-icon"><img src="/i/{{c_custkey}}.png"></div><div class="dgst-anchor"><a href="/list/{{c_custkey}}" title="{{if(c_custkey % 5 = 0, \'\', c_name)}}">{{if(c_custkey % 10 = 0, \'\', \'shown\')}}</a></div>'
    '<div class="dgst-meta"><div class="meta" title="{{c_mktsegment}}">t</div><span class="meta">3 likes</span><span class="meta">{{c_custkey % 40}} items</span>'
    '<span class="meta"><span title="{{c_nationkey % 12 + 1}}/{{c_custkey % 28 + 1}}/2021, 01:02:03">then</span></span><span class="meta category">{{element_at(array(\'Private\', \'Friends only\', \'Public\'), cast(c_custkey % 3 + 1 as int))}}</span></div></div>'
)


def _paged(rows: DataFrame, key: str | None, order: str, body: str, before: str = "", extra: str = "1 = 1") -> DataFrame:
    """Twenty entries a page, and one empty page at the end of each key."""
    by = Window.partitionBy(*([key] if key else [F.floor(F.col(order) / 1000)])).orderBy(order)
    rows = rows.withColumn("n", F.row_number().over(by) - 1).withColumn("page_no", (F.floor(F.col("n") / 20) + 1).cast("int"))
    rows = rows.withColumn("page_key", F.col(key) if key else F.floor(F.col(order) / 1000))
    pages = rows.groupBy("page_key", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", html(body).alias("h")))), lambda x: x["h"]), "").alias("body"), F.count(F.lit(1)).alias("count"))
    return pages.select("page_key", "page_no", F.concat(F.lit("<html><body>"), html(before), F.col("body"), F.lit("</body></html>")).alias("html"))


@query("""
    select c_custkey as list_id, case when c_custkey % 5 <> 0 then c_name when c_custkey % 10 <> 0 then 'shown' else 'List ' || c_custkey end as name, cast(c_custkey % 40 as int) as item_count,
           list_extract(['private', 'friends', 'public'], cast(c_custkey % 3 + 1 as int)) as privacy, c_mktsegment as teaser, strftime(make_date(2021, c_nationkey % 12 + 1, cast(c_custkey % 28 + 1 as int)), '%Y-%m-%d') || 'T01:02:03.000Z' as created_at from customer
""")
def lists_overview(t: Tables) -> DataFrame:
    pages = D.with_nodes(_paged(t.customer, None, "c_custkey", _LIST))
    return L.overview(pages).select("list_id", "name", "item_count", "privacy", "teaser", "created_at")


_ICON = '<span class="item-icon"><a href="/item/{{o_orderkey}}"><img alt="Order {{o_orderkey}}" src="/upload/items/1/{{o_orderkey}}.jpg"></a></span>'
_HEAD = '{{if(page_no = 1, concat(\'<h1 class="title"> List \', page_key, \'</h1><div class="object-stats">\', if(page_key % 3 = 0, \'0 items\', \'77 items\'), \'</div><div class="object-description"> Kept <b title="x">since</b> \', page_key, \'<br></div>\'), \'\')}}'


def _list_pages(t: Tables) -> DataFrame:
    return D.with_nodes(_paged(t.orders, "o_custkey", "o_orderkey", _ICON, _HEAD), inner={"description": L.DESCRIPTION}).withColumnRenamed("page_key", "list_id")


@query("""
    with n as (select o_custkey as list_id, count(*) as item_count from orders group by o_custkey)
    select list_id, 'List ' || list_id as title, case when list_id % 3 = 0 then item_count else 77 end as total, 'Kept <b title="x">since</b> ' || list_id || '<br>' as description, item_count from n
""")
def list_detail(t: Tables) -> DataFrame:
    return L.detail(_list_pages(t)).select("list_id", "title", "total", "description", "item_count")


@query("""
    select o_custkey as list_id, row_number() over (partition by o_custkey order by o_orderkey) as pos, o_orderkey as item_id, 'Order ' || o_orderkey as name, '/upload/items/2/' || o_orderkey || '.jpg' as image_url from orders
""")
def list_items(t: Tables) -> DataFrame:
    return L.items(_list_pages(t)).drop("page_no")


@query("""
    with o as (select *, case o_orderstatus when 'F' then 'owned' when 'O' then 'ordered' else 'wished' end as category from orders),
    r as (select *, row_number() over (partition by category order by o_orderkey) - 1 as n from o)
    select category, o_orderkey as item_id, case category when 'owned' then 2 when 'ordered' then 1 else 0 end as status_code, n as activity_order from r
""")
def collection_grid(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("category", F.expr("case o_orderstatus when 'F' then 'owned' when 'O' then 'ordered' else 'wished' end"))
    pages = D.with_nodes(_paged(rows, "category", "o_orderkey", _ICON)).withColumnRenamed("page_key", "category")
    return L.collection(pages).select("category", "item_id", "status_code", "activity_order")


@query("""
    with n as (select o_custkey as list_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders),
    g as (select list_id, string_agg(cast(o_orderkey as varchar), ',' order by pos) as ids, string_agg('Order ' || o_orderkey, ',' order by pos) as names from n group by list_id)
    select c_custkey as list_id, case when list_id is not null then 'Kept <b title="x">since</b> ' || c_custkey || '<br>' end as description, ids as item_ids, names as item_names from customer left join g on list_id = c_custkey
""")
def lists_with_details(t: Tables) -> DataFrame:
    overview = L.overview(D.with_nodes(_paged(t.customer, None, "c_custkey", _LIST)))
    pages = _list_pages(t)
    out = L.with_details(overview, L.detail(pages), L.items(pages))
    ids, names = F.col("item_ids").cast("array<string>"), F.transform("item_details", lambda x: x["name"])
    return out.select("list_id", "description", F.array_join(ids, ",").alias("item_ids"), F.array_join(names, ",").alias("item_names"))


@query("select c_custkey // 100 as list_id, cast(c_custkey % 100 as int) as page_no from customer where c_custkey % 100 <= 7 + (c_custkey // 100) % 3")
def pages_read(t: Tables) -> DataFrame:
    """Pages 0 to 99 of each list, of which one a list has no link to a next page; two kinds of link."""
    link = "{{case when page_no = 7 + list_id % 3 then '<a>next</a>' when list_id % 2 = 0 then '<a rel=\"next\">2</a>' else '<div class=\"pagination\"><p class=\"next\"><a>2</a></p></div>' end}}"
    pages = t.customer.selectExpr("floor(c_custkey / 100) as list_id", "cast(c_custkey % 100 as int) as page_no")
    return L.pages_read(D.with_nodes(pages.withColumn("html", html(f"<html><body>{link}</body></html>"))), "list_id").select("list_id", "page_no")


@query("select c_custkey as page_id, case when c_custkey % 4 <> 0 then 'user' || c_nationkey end as username from customer")
def usernames(t: Tables) -> DataFrame:
    body = "<html><body><a href='/about'>x</a>{{if(c_custkey % 4 = 0, '', concat('<a href=\"/profile/user', c_nationkey, '?tab=1\">me</a><a href=\"/profile/other\">o</a>'))}}</body></html>"
    pages = D.with_nodes(t.customer.select(F.col("c_custkey").alias("page_id"), html(body).alias("html")))
    return pages.select("page_id", L.username(F.col("nodes")).alias("username"))
