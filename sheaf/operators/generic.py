"""Extraction by selectors that the caller configures, and the assembled record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled, group, image_upgrade, trim
from ..session import written
from ..sources import catalog
from ..sources import dom as D

N = "nodes"
CONFIG = ("image", "manufacturer", "name", "scale")
SITES_SCHEMA = "site string, image string, manufacturer string, name string, scale string, wait_ms string"
#: Selectors with :contains( are a flag: the field's label is looked up instead.
SITES = {
    "catalog": {"image": ".item-picture .main img", "manufacturer": ":contains(Company)", "name": ":contains(Title)", "scale": ".item-scale", "wait_ms": "1000"},
    "article": {"image": "img", "manufacturer": "footer", "name": "article h1", "scale": ".item-scale", "wait_ms": "1000"},
}


def site_configs(spark: SparkSession) -> DataFrame:
    """The known sites' configurations as rows; a caller's own can be unioned in."""
    return spark.createDataFrame([(k, *(c.get(x) for x in (*CONFIG, "wait_ms"))) for k, c in SITES.items()], SITES_SCHEMA)


def config_of(configs: DataFrame, site: str) -> dict[str, str]:
    """One site's configuration from such rows; of rows for one site any counts."""
    row = configs.where(F.col("site") == site).first()
    if row is None:
        raise ValueError(f"no configuration for {site!r}")
    return {k: v for k, v in row.asDict().items() if k != "site" and v is not None}


def _test(tag_name: str, bits: list[tuple[str, str, str]]) -> D.Test:
    how = {"=": lambda a, v: a == v, "*=": lambda a, v: a.contains(v), "^=": lambda a, v: a.startswith(v)}
    tests: list[D.Test] = [D.tag(tag_name)] if tag_name != "*" else [lambda n: n["tag"] != "#text"]
    for name, op, value in bits:
        if op == "word":
            tests.append(D.cls(value))
        elif op == "has":
            tests.append(D.has(name))
        else:
            tests.append(lambda n, name=name, op=op, value=value: how[op](D.attr(n, name), value))
    return D.both(*tests)


def _under(nodes: Column, found: Column, test: D.Test) -> Column:
    return D.let(found, lambda above: F.filter(nodes, lambda n: test(n) & F.exists(above, lambda o: D.inside(n, o))))


def select(nodes: Column, selector: str) -> Column:
    """Nodes that match tags, classes, ids, attributes, :checked, descendants and comma lists; anything else is an error."""
    out = None
    for steps in D.selector_parts(selector):
        found = D.find(nodes, _test(*steps[0]))
        for step in steps[1:]:
            found = _under(nodes, found, _test(*step))
        out = found if out is None else F.concat(out, found)
    return out


def diagnostics(pages: DataFrame, wanted: list[str], samples: int = 3, length: int = 80) -> DataFrame:
    """Of parsed pages page_id, selector, how many nodes match, the first ``samples`` texts, and which of those look like dates."""
    one = lambda css: D.let(select(N, css), lambda found: F.struct(F.lit(css).alias("selector"), F.size(found).alias("n"), F.transform(F.slice(found, 1, samples), lambda b: F.substring(D.text(N, b), 1, length)).alias("samples")))
    rows = pages.select("page_id", F.explode(F.array(*map(one, wanted))).alias("d")).select("page_id", "d.*")
    return rows.withColumn("dates", F.filter("samples", lambda t: t.rlike(r"[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}")))


def selectors(config: dict[str, str]) -> dict[str, tuple[str, str | None]]:
    """What a parse looks up for ``extract``: a selector and the attribute asked for, or none for the text."""
    asked = {k: (config[k], "src" if k == "image" else None) for k in CONFIG if config.get(k) and ":contains(" not in config[k]}
    return asked | {"heading": ("h1", None), "score": ('input[name="score"]:checked', "value"), "wish": ('input[name="wishability"]:checked', "value")}


#: The parts of fields that ``extract`` and ``available_fields`` read.
EXTRACT_PARTS, AVAILABLE_PARTS = ("first_label", "entry_text"), ("ord", "first_label", "first_value")


def records(pages: DataFrame, config: dict[str, str], parts: tuple[str, ...] | None = None, related: bool = True, strict: bool = False) -> DataFrame:
    """Pages (page_id, html) parsed once, for ``extract`` and the operators of ``fields``; see ``catalog.with_fields``."""
    return catalog.with_fields(pages.select("page_id", "html"), selectors(config), parts, related, strict)


def labelled(label: str) -> Column:
    """Text of the first entry of the first field with exactly this label that has one."""
    named = F.filter("fields", lambda f: (trim(f["first_label"]) == label) & (trim(f["entry_text"]) != ""))
    return trim(F.get(named, F.lit(0))["entry_text"])


def extract(records_: DataFrame, config: dict[str, str], keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``records`` of pages to ``keys``, image_url, manufacturer, name, scale, user_score, user_wish_rating."""
    one = lambda key: filled(trim(F.col(f"found.{key}"))) if config.get(key) else F.lit(None).cast("string")
    contains = lambda key: ":contains(" in config.get(key, "")
    image = filled(F.col("found.image")) if config.get("image") else F.lit(None).cast("string")
    maker = labelled("Company") if contains("manufacturer") else one("manufacturer")
    return _basic(records_, list(keys), image, maker, _heading() if contains("name") else one("name"), one("scale"))


def _heading() -> Column:
    return F.coalesce(labelled("Character"), labelled("Title"), filled(trim("found.heading")))


def _basic(records_: DataFrame, keys: list[str], image: Column, maker: Column, name: Column, scale: Column) -> DataFrame:
    out = records_.select(
        *keys, image_upgrade(image).alias("image_url"), maker.alias("manufacturer"), name.alias("name"), scale.alias("scale"),
        F.col("found.score").try_cast("int").alias("points"), F.col("found.wish").try_cast("int").alias("wish"),
    )
    scale, points, wish = F.col("scale"), F.col("points"), F.col("wish")
    return out.select(
        *keys, "image_url", "manufacturer", "name", F.coalesce(group(scale, "(1/[0-9]+)"), scale).alias("scale"),
        F.when(points.between(1, 10), points).alias("user_score"), F.when(wish.between(1, 5), wish).alias("user_wish_rating"),
    )


#: Sites' configurations that are broadcast to the pages.
SITES_AT_ONCE = 100_000


def with_sites(configs: DataFrame, own: DataFrame) -> DataFrame:
    """``configs`` with a caller's own rows, which replace those of the same site."""
    return configs.join(own.select("site"), "site", "left_anti").unionByName(own)


def records_by_site(pages: DataFrame, configs: DataFrame, strict: bool = False) -> DataFrame:
    """Pages (page_id, site, html) parsed once, each with its site's own selectors, for ``extract_by_site``.

    ``configs`` has a row for each site; of several rows for one the least, column by column, counts.  Pages of a site
    without a row keep what needs no selector.  ``strict``: see ``dom.closed``.
    """
    whole = configs.groupBy("site").agg(F.min(F.struct(*CONFIG)).alias("config"))
    asked = lambda k: F.when(~F.col(f"config.{k}").contains(":contains("), F.col(f"config.{k}")).alias(k)
    whole = written(whole.select("site", "config", F.struct(*map(asked, CONFIG)).alias("programs")), "sites")
    few = whole.limit(SITES_AT_ONCE + 1).count() <= SITES_AT_ONCE
    rows = pages.select("page_id", "site", "html").join(F.broadcast(whole) if few else whole, "site", "left").select("page_id", "site", "config", "programs", "html")
    fixed = {k: v for k, v in selectors({}).items() if k not in CONFIG}
    attributes = {k: "src" if k == "image" else None for k in CONFIG}
    return D.with_records(rows, catalog.record, catalog.FIELDS, fixed, programs="programs", attributes=attributes, strict=strict)


def extract_by_site(records_: DataFrame) -> DataFrame:
    """``records_by_site`` to page_id, site and the columns of ``extract``."""
    one = lambda key: filled(trim(F.col(f"found.{key}")))
    contains = lambda key: F.coalesce(F.col(f"config.{key}").contains(":contains("), F.lit(False))
    maker = F.when(contains("manufacturer"), labelled("Company")).otherwise(one("manufacturer"))
    name = F.when(contains("name"), _heading()).otherwise(one("name"))
    return _basic(records_, ["page_id", "site"], filled(F.col("found.image")), maker, name, one("scale"))


def available_fields(records_: DataFrame) -> DataFrame:
    """page_id, ord, label and the first 50 characters of the value, for fields that have both."""
    rows = records_.select("page_id", F.explode("fields").alias("f")).where("f.first_label is not null and f.first_value is not null")
    return rows.select("page_id", F.col("f.ord").alias("ord"), trim("f.first_label").alias("label"), F.substring(trim("f.first_value"), 1, 50).alias("value_preview"))


def assemble(records_: DataFrame, config: dict[str, str]) -> DataFrame:
    """One record per page, put together within its row: no page meets another.  The manufacturer falls back on the first
    company in that role, the name on the title; lists without entries and statistics without a figure are null."""
    from . import fields as C

    rows = records_.withColumn("table", C.ruled(F.col("fields")))
    table, listed = F.col("table"), lambda found: D.let(found, lambda x: F.when(F.size(x) > 0, x))
    lists = {
        "companies": C.entries_of(table, "company", "Manufacturer"), "artists": C.entries_of(table, "artist", "Unknown"), "releases": C.releases_of(table), "related_items": C.related_items_of(F.col("related")),
    }
    rows = rows.select("page_id", "found", "fields", C.catalog_fields_of(table).alias("meta"), *(listed(found).alias(name) for name, found in lists.items()))
    out = extract(rows, config, ("page_id", "meta", *lists)).select("*", "meta.*").drop("meta")
    maker = F.get(F.filter("companies", lambda c: c["role"] == "Manufacturer"), F.lit(0))["name"]
    stats = ["owned", "ordered", "wished", "listed", "average_score"]
    out = out.withColumn("manufacturer", F.coalesce("manufacturer", maker)).withColumn("name", F.coalesce("name", "title"))
    out = out.withColumn("community_stats", F.when(F.coalesce(*(F.col(c).cast("double") for c in stats)).isNotNull(), F.struct(*stats))).drop(*stats)
    return out.select(*(c for c in out.columns if c not in lists and c != "community_stats"), *lists, "community_stats")


def extract_catalog(pages: DataFrame) -> DataFrame:
    """The whole record of catalog pages (page_id, html).

    Each page is parsed once and its record put together in its row; records, without markup, are written to the shared
    folder, from where a reader takes the columns it needs.
    """
    from . import fields as C

    parts = tuple(dict.fromkeys((*EXTRACT_PARTS, *C.RECORD_PARTS)))
    return written(assemble(records(pages, SITES["catalog"], parts), SITES["catalog"]), "catalog")


def completeness(record: DataFrame) -> DataFrame:
    """page_id and six flags: which parts of a record are there.  Empty texts and a price of 0 count as missing."""
    there = lambda c: F.coalesce(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.lit(False))
    first = record.withColumn("release", F.get("releases", F.lit(0)))
    return first.select(
        "page_id", there("image_url").alias("has_image"), there("name").alias("has_name"), there("manufacturer").alias("has_manufacturer"), there("origin").alias("has_origin"),
        there("release.date").alias("has_release_date"), F.coalesce(F.col("release.price") != 0, F.lit(False)).alias("has_price"),
    )
