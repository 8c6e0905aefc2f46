"""Limits of live crawling and of lanes are off unless asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import lists
from sheaf.plans import enrichment
from sheaf.sources import dom


def test_items_of_all_pages(spark):
    html = "<html><body><h1 class='title'>T</h1><div class='item-icon'><a href='/item/{}'><img alt='n' src='/s'></a></div></body></html>"
    pages = dom.with_nodes(spark.createDataFrame([(1, n, html.format(n)) for n in (1, 100, 101, 250)], "list_id long, page_no long, html string"), inner={"description": lists.DESCRIPTION})
    assert lists.items(pages).count() == 4 and lists.detail(pages).first().item_count == 4
    assert lists.items(pages, lists.MAX_ITEM_PAGES).count() == 2 and lists.detail(pages, lists.MAX_ITEM_PAGES).first().item_count == 2


def test_a_lane_holds_all_requests(spark):
    queue = spark.range(2 * enrichment.LANE_CAPACITY + 2).selectExpr("id as item_id", "if(id % 2 = 0, 'HOT', 'COLD') as lane", "timestamp_seconds(id) as queued_at")
    assert enrichment.admitted(queue).count() == 2 * enrichment.LANE_CAPACITY + 2
    assert enrichment.admitted(queue, enrichment.LANE_CAPACITY).count() == 2 * enrichment.LANE_CAPACITY


def test_trim_runs_no_pattern_and_takes_every_white_space(spark):
    """two patterns over each text took longer than reading the page."""
    from sheaf.functions.text import SPACES, trim

    texts = spark.createDataFrame([(i, c + " \t" + c + "a" + c + "b" + c + "\n" + c) for i, c in enumerate([*SPACES, "​", "᠎"])], "i int, t string")
    assert "regexp" not in str(trim(F.col("t")))
    old = F.regexp_replace(F.regexp_replace("t", r"(?U)^[\s﻿]+", ""), r"(?U)[\s﻿]+\z", "")
    assert texts.where(~trim("t").eqNullSafe(old)).count() == 0


def _shown(label: str, date: str) -> str:
    head = f'<div class="data-label">{label}</div>' if label else ""
    return f'<div class="data-field">{head}<div class="data-value">' + (f'<a class="time">{date}</a>' if date else "x") + "</div></div>"


def test_releases_end_at_any_field_between_and_few_fields_are_sorted(spark):
    """F8, F9, F19: all fields were shuffled and sorted, four times in all, to find the few with a date."""
    from sheaf.operators import fields as C
    from sheaf.sources import catalog

    one, two, gap = _shown("Releases", "1/2/2020"), _shown("", "3/2021"), _shown("", "")
    pages = [
        (1, one + two + two), (2, one + gap + two), (3, one + _shown("Title", "") + two), (4, two + one + two), (5, gap + two), (6, one + "<p></p>" + two), (7, _shown("Releases", "") + two),
        (8, one + _shown("Release", "5/2022") + _shown("Title", "6/2022") + two), (9, gap + _shown("Releases", "7/2022") + _shown("", "no date") + two), (10, one + two + gap + one + two), (11, "<div>" + one + "</div>" + two),
    ]
    frame = spark.createDataFrame(pages, "page_id int, html string")
    found = C.releases(C.field_table(catalog.with_fields(frame, parts=C.RELEASE_PARTS, related=False)))
    got: dict = {}
    for r in found.orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((str(r.date), r.is_rerelease))
    a, b = ("2020-01-02", False), ("2021-03-01", True)
    assert got == {1: [a, b, b], 2: [a], 3: [a], 4: [a, b], 6: [a], 7: [b], 8: [a, ("2022-05-01", True)], 9: [("2022-07-01", False), b], 10: [a, b], 11: [a]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    count = lambda node: sum(line.lstrip(" +-:").startswith(node) for line in plan.splitlines())
    assert (count("Sort ["), count("Exchange")) == (2, 1)  # possible releases, then those with a date
