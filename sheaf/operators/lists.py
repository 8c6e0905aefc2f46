"""List overviews, list details and collection grids, from parsed pages that carry ``page_no``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import list_time
from ..functions.text import filled, group, image_upgrade, path_id, privacy, trim
from ..plans.order import numbered
from ..session import written
from ..sources import dom as D
from .generic import select

N = "nodes"
#: Pages that are looked at, at most, and the status codes of collections.
MAX_LIST_PAGES, MAX_ITEM_PAGES, MAX_GRID_PAGES = 50, 100, 200
STATUS_CODES = {"owned": 2, "ordered": 1, "wished": 0}
#: The link to the next page, and where a list's description is.
NEXT, DESCRIPTION = 'a[rel="next"], .pagination .next a', ".object-description"
ITEM = D.both(D.tag("a"), lambda n: D.attr(n, "href").contains("/item/"))


def _cut(found: Column) -> Column:
    """Of each found node the node (``box``) and, as ``nodes``, itself and what is below it: a row for each needs no more of
    its page.  A node's id is its place in the page."""
    return F.explode(F.transform(found, lambda b: F.struct(b.alias("box"), F.slice(N, b["id"] + 1, b["stop"] - b["id"]).alias("nodes"))))


def _image(box: Column) -> dict[str, Column]:
    img = D.first(D.find(N, D.tag("img"), box))
    return {"name": filled(D.attr(img, "alt")), "image_url": image_upgrade(F.coalesce(filled(D.attr(img, "src")), filled(D.attr(img, "data-src"))))}


def pages_read(pages: DataFrame, key: str | None = None, max_pages: int | None = None) -> DataFrame:
    """Pages up to the first that has no link to a next one (of each ``key``, if given), ``max_pages`` at most."""
    keys = [key] if key else []
    last = pages.where(F.size(select(N, NEXT)) == 0).groupBy(*keys).agg(F.min("page_no").alias("_last"))
    rows = pages.join(last, keys, "left") if keys else pages.crossJoin(last)  # one row
    rows = rows.where("_last is null or page_no <= _last").drop("_last")
    return rows if max_pages is None else rows.where(F.col("page_no") <= max_pages)


def overview(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """page_no, pos, list_id, name, item_count, privacy, url, teaser, created_at, icon_url; one row per list on the pages.

    ``max_pages`` is for live crawling (``MAX_LIST_PAGES``); without it all pages count."""
    rows = (pages if max_pages is None else pages.where(F.col("page_no") <= max_pages)).select("page_no", _cut(D.find(N, D.cls("dgst-wrapper"))).alias("cut")).select("page_no", "cut.*")
    box = F.col("box")
    meta = D.below(N, D.cls("dgst-meta"), D.cls("meta"), box)
    rows = rows.withColumn("link", D.first(D.find(N, D.both(D.tag("a"), lambda n: D.attr(n, "href").contains("/list/")), box))).withColumn("meta", meta)
    href, link = D.attr(F.col("link"), "href"), F.col("link")
    list_id = group(href, "/list/([0-9]+)")
    counts = F.filter(F.transform(F.filter("meta", D.tag("span")), lambda m: group(D.text(N, m), r"([0-9]+)\s*item")), lambda c: c.isNotNull())
    teaser = D.first(F.filter("meta", D.tag("div")))
    shown = D.text(N, D.first(F.filter("meta", D.cls("category"))))
    dated = D.first(F.filter(D.find(N, D.both(D.tag("span"), D.has("title")), box), lambda n: F.exists("meta", lambda m: D.inside(n, m))))
    icon = D.attr(D.first(D.below(N, D.cls("dgst-icon"), D.tag("img"), box)), "src")
    return rows.where(list_id.isNotNull()).select(
        "page_no", F.row_number().over(Window.partitionBy("page_no").orderBy("box.id")).alias("pos"), list_id.cast("bigint").alias("list_id"),
        F.coalesce(filled(D.attr(link, "title")), filled(D.text(N, link)), F.concat(F.lit("List "), list_id)).alias("name"), F.coalesce(F.try_element_at(counts, F.lit(-1)).cast("int"), F.lit(0)).alias("item_count"),
        privacy(F.coalesce(filled(shown), F.lit("Public"))).alias("privacy"), href.alias("url"), filled(F.coalesce(filled(D.attr(teaser, "title")), D.text(N, teaser))).alias("teaser"),
        list_time(D.attr(dated, "title")).alias("created_at"), filled(icon).alias("icon_url"),
    )


def items(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """list_id, page_no, pos, item_id, name, image_url: every link to an item inside an icon, in page order.

    ``max_pages`` is for live crawling (``MAX_ITEM_PAGES``); without it all pages count."""
    rows = (pages if max_pages is None else pages.where(F.col("page_no") <= max_pages)).select("list_id", "page_no", _cut(D.below(N, D.cls("item-icon"), ITEM)).alias("cut")).select("list_id", "page_no", "cut.nodes", F.col("cut.box").alias("a"))
    rows = rows.select("list_id", "page_no", F.col("a.id").alias("at"), path_id(D.attr(F.col("a"), "href"), "item").alias("item_id"), *(c.alias(k) for k, c in _image(F.col("a")).items()))
    pos = F.row_number().over(Window.partitionBy("list_id").orderBy("page_no", "at"))
    return rows.where("item_id is not null").select("list_id", "page_no", pos.alias("pos"), "item_id", "name", "image_url")


def detail(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """list_id, title, total, description, item_count: the header of the first page, and all pages' items counted.

    Pages are parsed with ``inner={"description": DESCRIPTION}``: the description is markup."""
    stats = D.text(N, D.first(D.find(N, D.cls("object-stats"))))
    head = F.struct(
        filled(D.text(N, D.first(D.find(N, D.both(D.tag("h1"), D.cls("title")))))).alias("title"), group(stats, r"([0-9]+)\s*item").cast("bigint").alias("total"),
        filled(trim("description")).alias("description"),
    )
    first = F.col("page_no") == 1
    counted = F.size(F.filter(D.below(N, D.cls("item-icon"), ITEM), lambda a: path_id(D.attr(a, "href"), "item").isNotNull()))
    counted = counted if max_pages is None else F.when(F.col("page_no") <= max_pages, counted).otherwise(0)
    rows = pages.select("list_id", F.when(first, head).alias("head"), counted.cast("bigint").alias("found"))
    out = rows.groupBy("list_id").agg(F.first("head", ignorenulls=True).alias("head"), F.sum("found").alias("item_count")).where("head is not null").select("list_id", "head.*", "item_count")
    return out.withColumn("total", F.coalesce(F.nullif("total", F.lit(0)), "item_count"))


def collection(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """category, item_id, name, image_url, status_code, activity_order: pages up to the first empty one, numbered from 0.

    ``max_pages`` is for live crawling (``MAX_GRID_PAGES``); without it all pages count."""
    rows = (pages if max_pages is None else pages.where(F.col("page_no") <= max_pages)).select("category", "page_no", "nodes", F.explode_outer(D.find(N, D.cls("item-icon"))).alias("box"))
    link = D.first(D.find(N, ITEM, F.col("box")))
    rows = rows.select("category", "page_no", F.col("box.id").alias("at"), path_id(D.attr(link, "href"), "item").alias("item_id"), *(c.alias(k) for k, c in _image(F.col("box")).items()))
    rows = written(rows, "grid")
    ends = rows.groupBy("category", "page_no").agg(F.count("item_id").alias("here")).where("here = 0").groupBy("category").agg(F.min("page_no").alias("stop"))
    rows = rows.join(F.broadcast(ends), "category", "left").where("item_id is not null and (stop is null or page_no < stop)")  # a row for each category
    rows = numbered(rows.drop("stop"), ["category"], [F.col("page_no"), F.col("at")], "activity_order")
    code = F.element_at(F.create_map(*(F.lit(x) for p in STATUS_CODES.items() for x in p)), F.col("category"))
    return rows.select("category", "item_id", "name", "image_url", code.alias("status_code"), "activity_order")


def with_details(overview_: DataFrame, details: DataFrame, items_: DataFrame) -> DataFrame:
    """``overview`` rows with description, item_ids and item_details (item_id, name, image_url) of the lists whose pages
    were read; the others keep their header only, with nulls."""
    entry = F.struct("pos", F.struct("item_id", "name", "image_url").alias("x"))
    found = items_.where("item_id is not null").groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda r: r["x"]).alias("item_details"))
    out = overview_.join(details.select("list_id", "description", F.lit(True).alias("_read")), "list_id", "left").join(found, "list_id", "left")
    empty = F.array().cast("array<struct<item_id: bigint, name: string, image_url: string>>")
    out = out.withColumn("item_details", F.when(F.col("_read"), F.coalesce("item_details", empty))).drop("_read")
    return out.withColumn("item_ids", F.transform("item_details", lambda x: x["item_id"]))


def username(nodes: Column) -> Column:
    link = D.first(D.find(nodes, D.both(D.tag("a"), lambda n: D.attr(n, "href").contains("/profile/"))))
    return group(D.attr(link, "href"), "/profile/([^/?#]+)")
