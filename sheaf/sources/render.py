"""Catalog pages and files rendered from plain tables, for round trips: render, extract, compare with the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dom import spread


def html(template: str) -> Column:
    """A template with SQL expressions in double braces."""
    parts = template.split("{{")
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        body, rest = p.split("}}", 1)
        out += [F.coalesce(F.expr(body).cast("string"), F.lit("")), F.lit(rest)]
    return F.concat(*out)


def field(label: str, value: str) -> str:
    head = f'<div class="data-label">{label}</div>' if label else ""
    return f'<div class="data-field">{head}<div class="data-value">{value}</div></div>'


def entry(href: str, name: str, role: str = "") -> str:
    return f'<div class="item-entries"><a href="{href}"><span switch="x">{name}</span></a>{role}</div>'


ROLE = '<small class="light">as <em>{}</em></small>'
PAGE = (
    '<html><head><title>Item {{p_partkey}}</title><script>var x = "</p>";</script></head><body><h1>Heading {{p_partkey}}</h1>'
    '<div class="item-picture"><div class="main"><img src="https://static.example.net/upload/items/{{p_partkey % 3}}/{{p_partkey}}.jpg"></div></div>'
    + field("Company", entry("/entry/company/{{p_partkey % 50 + 1}}", "{{p_brand}}", "{{if(p_partkey % 2 = 0, '" + ROLE.format("Manufacturers") + "', '')}}") + entry("#", "{{upper(p_brand)}}"))
    + field("Distributors", entry("/entry/company/{{p_partkey % 7 + 100}}", "Dealer {{p_partkey % 7}}"))
    + field("Artist", entry("/entry/artist/{{p_partkey % 11}}", "Artist {{p_partkey % 11}}", ROLE.format("Sculptors")))
    + field("Sculptor", entry("#", "ARTIST {{p_partkey % 11}}") + entry("/entry/artist/9", "Solo {{p_partkey % 13}}"))
    + field("Title", '<a switch="jp"> {{p_name}} </a>')
    + field("Origins", entry("/entry/origin/3", "Origin {{p_partkey % 4}}"))
    + field("Category", '<span class="item-category-{{p_size % 9}}">{{p_type}}</span>')
    + field("Materials", "{{if(p_size % 2 = 0, '" + entry("#", "PVC") + entry("#", "ABS") + "', '" + entry("#", "Resin") + "')}}")
    + field("Dimensions", '<a class="item-scale"><small>1/</small>{{p_size % 8 + 4}}</a> <small>H=</small><strong>{{p_size * 10}}</strong><small>mm</small>')
    + field("Various", '<a href="/t/1">{{p_brand}}</a><a href="/t/2">  </a><a href="/t/3">{{p_type}}</a>')
    + field("Score", "{{p_size % 13}}.5 / 10")
    + field("Owned by", "{{format_number(p_partkey * 37, 0)}} users")
    + field("Wished by", "{{if(p_partkey % 4 = 0, 'nobody', concat(p_partkey, ' users'))}}")
    + field("Average rating", "<b>4</b>")
    + "{{if(p_partkey % 3 = 0, '" + field("Mystery", "x") + "', '')}}"
    + field("Releases", '<a class="time">{{p_size % 12 + 1}}/{{p_partkey % 28 + 1}}/{{2000 + p_size % 20}}</a> ' + ROLE.format("Standard") + '<br>{{format_number(p_retailprice, 2)}} <small>JPY (<a href="#">USD</a>)</small> <meta itemprop="productID" content="jan:{{lpad(p_partkey, 4 + p_size % 12, 7)}}">')
    + field("", '<a class="time">{{p_size % 12 + 1}}/{{2010 + p_size % 9}}</a><br>€{{p_size}} • <a class="tbx-window" title="Buy ({{p_partkey + 1000000000}})">x</a>')
    + "{{if(p_partkey % 2 = 0, '" + field("Shops", "none") + "', '')}}"
    + field("", '<a class="time">1/2020</a>')
    + '<div class="item-linked-group"><div class="item-linked-category">Variant</div>'
    '<div class="item-linked-item"><a href="/item/{{p_partkey + 1}}" title="Part {{p_partkey + 1}}"><img src="/s/{{p_partkey + 1}}.jpg"></a></div>'
    '<div class="item-linked-item"><a href="/item/">none</a></div></div>'
    '<form><input type="radio" name="score" value="{{p_size % 13}}" checked><input type="radio" name="score" value="3">'
    '<input type="radio" name="wishability" value="{{p_size % 7}}" checked></form></body></html>'
)


def catalog_pages(part: DataFrame) -> DataFrame:
    """One page per part: page_id, html."""
    return spread(part).select(F.col("p_partkey").alias("page_id"), html(PAGE).alias("html"))
