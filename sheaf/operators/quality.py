"""Is a page content at all, and is a request complete?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import collapse, host_allowed

#: Titles of blocked pages.
BLOCKED = ("Access denied", "Just a moment", "Attention Required")


def with_challenge(pages: DataFrame, title: str = "title", body: str = "body", titles: tuple = (), bodies: tuple = ()) -> DataFrame:
    """``pages`` with ``challenge``: do they ask the visitor to wait or prove something?  ``titles`` and ``bodies`` are further
    phrases.  Texts are collapsed in a step of their own, once, and all phrases are looked for in the result."""
    held = pages.withColumns({"_title": collapse(F.col(title)), "_body": collapse(F.col(body))})
    return held.withColumn("challenge", rules.challenge_page(F.col("_title"), F.col("_body"), titles, bodies)).drop("_title", "_body")


def missing_page(url: Column, title: Column, body: Column, domain: str) -> Column:
    return host_allowed(url, domain) & (title.contains("Error") | title.contains("404")) & (body.contains("404") | body.contains("Not Found") | body.contains("not found"))


def blocked_page(title: Column, has_error_element: Column) -> Column:
    out = has_error_element
    for t in BLOCKED:
        out = out | title.contains(t)
    return out


def logged_in(title: Column, has_menu: Column) -> Column:
    return ~F.lower(title).contains("error") & has_menu


def quarantine(requests: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Complete requests, and the others with the first ``reason`` that speaks against them."""
    reason = F.coalesce(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"{c} is missing") for c in required))
    judged = requests.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
