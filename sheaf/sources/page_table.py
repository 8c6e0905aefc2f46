"""A table function over pages for SQL: what a selector matches, a row for each match.

``select p.page_id, m.text from pages p, lateral page_matches(p.html, 'article h1') m``.  Rows go through Arrow; a lateral
join with a function of whole Arrow batches isn't something Spark 4.1 plans.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import dom

SCHEMA = "ord int, tag string, text string, link string"


def _matches(known: dict, html: str | None, selector: str | None) -> Iterator[tuple]:
    if html is None or selector is None:
        return
    if selector not in known:
        known[selector] = dom.compiled(selector)
    page = dom.Page(html)
    for k, n in enumerate(page.matches(known[selector])):
        yield k, n["tag"], page.text(n), dict(n["attrs"]).get("href")


@udtf(returnType=SCHEMA, useArrow=True)
class PageMatches:
    """The page's nodes in document order: their tag, text and href.  A null page or selector matches nothing."""

    def __init__(self) -> None:
        self.known: dict = {}

    def eval(self, html: str, selector: str) -> Iterator[tuple]:
        yield from _matches(self.known, html, selector)


@udtf(returnType=SCHEMA, useArrow=True)
class StrictPageMatches:
    """``PageMatches`` of pages in which only references with their semicolon count (``dom.closed``)."""

    def __init__(self) -> None:
        self.known: dict = {}

    def eval(self, html: str, selector: str) -> Iterator[tuple]:
        yield from _matches(self.known, dom.closed(html), selector)


def register(spark: SparkSession, name: str = "page_matches", strict: bool = False) -> None:
    spark.udtf.register(name, StrictPageMatches if strict else PageMatches)
