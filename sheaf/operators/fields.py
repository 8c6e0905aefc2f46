"""Records of catalog pages: labelled fields, the values behind them, companies, artists, releases, related items.

Pages come with the raw text of their fields (``sources.catalog.with_fields``); what the text means is decided here, in
column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import catalog_date
from ..functions.text import filled, first_count, group, numeric_prefix, trailing_id, trim
from ..sources.dom import let

PREVIEW = 100
#: What each operator reads of a field, for ``catalog.with_fields``.
ENTRY_PARTS, AUDIT_PARTS = ("label", "grouped", "single"), ("ord", "label", "value", "boxes", "roles")
VALUE_PARTS = ("ord", "label", "value", "own", "spans", "kind", "scale", "height", "direct", "link", "tags")
RELEASE_PARTS = ("ord", "after", "previous", "label", "date", "variant", "plain", "smalls", "product", "buy_title", "buy_text", "boxed_text")
RECORD_PARTS = tuple(dict.fromkeys((*ENTRY_PARTS, *VALUE_PARTS, *RELEASE_PARTS)))
#: A field's parts by name: columns of a row, or what ``ruled`` gives in an array.
Parts = Callable[[str], Column]


def field_table(pages: DataFrame) -> DataFrame:
    """One row per field of a page: page_id, label, rule and the field's raw text.

    A narrow transformation: the fields of a page stay where the page was.
    """
    rows = pages.select("page_id", F.explode("fields").alias("f")).select("page_id", "f.*").withColumn("label", trim(F.col("label")))
    return rows.select("*", F.explode(F.array(rules.label_rule(F.col("label")))).alias("rule"))  # generated, so that filters on it don't repeat it


def ruled(fields: Column) -> Column:
    """``field_table`` within the row: an array of label, rule and f, the field's raw text."""
    rule = lambda label: F.when(label != "", rules.label_rule(label))
    return F.transform(fields, lambda f: let(trim(f["label"]), lambda label: F.struct(label.alias("label"), rule(label).alias("rule"), f.alias("f"))))


def _parts(x: Column) -> Parts:
    return lambda name: x[name] if name == "label" else x["rule"][name[5:]] if name.startswith("rule.") else x["f"][name]


def _trimmed(texts: Column | str) -> Column:
    return F.transform(texts, trim)


def _not_empty(texts: Column) -> Column:
    return F.filter(texts, lambda t: t != "")


def text_value(f: Parts = F.col) -> Column:
    """The value of a text-like field: what its strategy asks for, else the first of the usual places that exists.

    A place that exists and is empty ends the search.
    """
    strategy = f("rule.strategy")
    materials = F.array_join(_not_empty(_trimmed(f("spans"))), ", ")
    size = F.array_join(F.array_compact(F.array(trim(f("scale")), F.concat(F.lit("H="), trim(f("height")), F.lit("mm")))), ", ")
    return (
        F.when((strategy == "materials") & (materials != ""), materials)
        .when((strategy == "category") & f("kind").isNotNull(), trim(f("kind")))
        .when((strategy == "dimensions") & (size != ""), size)
        .when(f("direct").isNotNull(), trim(f("direct")))
        .when(F.size(f("spans")) > 0, trim(F.get(f("spans"), F.lit(0))))
        .when(f("link").isNotNull(), trim(f("link")))
        .otherwise(F.array_join(_trimmed(f("own")), ""))
    )


def _value_parts(f: Parts) -> list[Column]:
    """ord, label, strategy, key, value (text), tags, lower_label, count, score of a field; tags may be empty, scores beyond their range."""
    raw, strategy, lower = trim(f("value")), f("rule.strategy"), F.lower(f("label"))
    text_key = F.regexp_replace(lower, "s$", "")
    key = F.when(strategy == "text", F.when(text_key.isin("title", "origin", "version", "classification"), text_key)).when(strategy.isin("category", "materials", "dimensions"), strategy)
    counted = F.when((strategy == "count") & lower.isin("owned by", "ordered by", "wished by", "listed in"), first_count(raw))
    points = F.when(strategy == "score", numeric_prefix(raw))
    return [
        f("ord").alias("ord"), f("label").alias("label"), strategy.alias("strategy"), key.alias("key"), F.when(key.isNotNull(), filled(text_value(f))).alias("value"),
        F.when(strategy == "tags", _not_empty(_trimmed(f("tags")))).alias("tags"), lower.alias("lower_label"), counted.alias("count"), points.alias("score"),
    ]


def field_values(fields: DataFrame) -> DataFrame:
    """page_id, ord, label, strategy, key, value (text), tags, count, score of the metadata fields."""
    rows = fields.select("page_id", *_value_parts(F.col))
    return rows.withColumn("tags", F.when(F.size("tags") > 0, F.col("tags"))).withColumn("score", F.when(F.col("score").between(0, 10), F.col("score")))


KEYS = ("title", "origin", "version", "classification", "category", "materials", "dimensions")
COUNTS = {"owned by": "owned", "ordered by": "ordered", "wished by": "wished", "listed in": "listed"}


def catalog_fields(fields: DataFrame) -> DataFrame:
    """One row per page.  Of fields with one label the last non-empty one counts; unknown labels are listed, repeats included."""
    rows = field_values(fields.where("label <> ''"))

    def last(value: Column, test: Column) -> Column:
        return F.max_by(value, F.when(test & value.isNotNull(), F.col("ord")))

    unknown = F.array_sort(F.collect_list(F.when(F.col("strategy").isNull(), F.struct("ord", "label"))))
    return rows.groupBy("page_id").agg(
        *(last(F.col("value"), F.col("key") == k).alias(k) for k in KEYS),
        last(F.col("tags"), F.lit(True)).alias("tags"),
        *(last(F.col("count"), F.col("lower_label") == k).alias(v) for k, v in COUNTS.items()),
        last(F.col("score"), F.lit(True)).alias("average_score"),
        F.transform(unknown, lambda u: u["label"]).alias("unknown_labels"),
    )


def catalog_fields_of(table: Column) -> Column:
    """``catalog_fields`` of a page whose fields are ``ruled``, as a struct."""

    def last(values: Column, name: str, test: Callable[[Column], Column] = lambda v: F.lit(True)) -> Column:
        return F.try_element_at(F.filter(values, test), F.lit(-1))[name]

    def whole(values: Column) -> Column:
        there = lambda name: F.filter(values, lambda v: v[name].isNotNull())
        called = lambda name, text: lambda v: v[name] == text
        sets = F.struct(there("value").alias("value"), there("count").alias("count"), F.filter(values, lambda v: v["strategy"].isNull()).alias("unknown"))
        return let(sets, lambda x: F.struct(
            *(last(x["value"], "value", called("key", k)).alias(k) for k in KEYS),
            last(values, "tags", lambda v: F.size(v["tags"]) > 0).alias("tags"),
            *(last(x["count"], "count", called("lower_label", k)).alias(c) for k, c in COUNTS.items()),
            last(values, "score", lambda v: v["score"].between(0, 10)).alias("average_score"),
            F.when(F.size(values) > 0, F.transform(x["unknown"], lambda v: v["label"])).alias("unknown_labels"),
        ))

    return let(F.transform(F.filter(table, lambda x: x["label"] != ""), lambda x: F.struct(*_value_parts(_parts(x)))), whole)


def entries(fields: DataFrame, category: str, default_role: str) -> DataFrame:
    """Companies or artists: page_id, pos, name, role, entity_id.

    Entries with a role of their own come first, then those whose label is the role; a name and role that came before,
    in any case, is dropped.
    """
    mine = fields.where((F.col("rule.category") == category) & (F.col("label") != ""))
    name = F.coalesce(filled(trim("e.name")), trim("e.link_text"))
    entity = trailing_id(F.col("e.href"))
    grouped, single = F.col("rule.strategy") == "grouped", (F.col("rule.strategy") == "individual") & F.col("rule.role").isNotNull()
    every = mine.select("page_id", "rule", F.explode(F.when(grouped, F.col("grouped")).when(single, F.col("single"))).alias("e"))
    role = F.when(grouped, F.coalesce(filled(trim("e.role")), F.lit(default_role))).otherwise(F.col("rule.role"))
    every = every.select("page_id", F.when(grouped, 0).otherwise(1).alias("rank"), F.col("e.at").alias("at"), role.alias("role"), name.alias("name"), entity.alias("entity_id")).where("name <> ''")
    every = every.withColumn("role", F.when(F.col("rank") == 0, rules.role_name(F.col("role"))).otherwise(F.col("role")))
    first = F.min(F.struct("rank", "at", "name", "role", "entity_id")).alias("e")
    kept = every.groupBy("page_id", F.lower("name").alias("_name"), F.lower("role").alias("_role")).agg(first).select("page_id", "e.*")
    return kept.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "at")).alias("pos"), "name", "role", "entity_id")


def entries_of(table: Column, category: str, default_role: str) -> Column:
    """``entries`` of a page whose fields are ``ruled``, as an array of name, role and entity_id."""

    def one(x: Column, e: Column) -> Column:
        grouped = x["rule"]["strategy"] == "grouped"
        own = let(F.coalesce(filled(trim(e["role"])), F.lit(default_role)), rules.role_name)
        name, role = F.coalesce(filled(trim(e["name"])), trim(e["link_text"])), F.when(grouped, own).otherwise(x["rule"]["role"])
        made = F.struct(F.when(grouped, 0).otherwise(1).alias("rank"), e["at"].alias("at"), name.alias("name"), role.alias("role"), trailing_id(e["href"]).alias("entity_id"))
        return let(made, lambda m: F.struct(F.lower(m["name"]).alias("name"), F.lower(m["role"]).alias("role"), m.alias("e")))

    grouped, single = (lambda x: x["rule"]["strategy"] == "grouped"), (lambda x: (x["rule"]["strategy"] == "individual") & x["rule"]["role"].isNotNull())
    mine = F.filter(table, lambda x: (x["rule"]["category"] == category) & (grouped(x) | single(x)))
    every = F.flatten(F.transform(mine, lambda x: F.transform(F.when(grouped(x), x["f"]["grouped"]).otherwise(x["f"]["single"]), lambda e: one(x, e))))
    same = lambda x, y: x["name"].eqNullSafe(y["name"]) & x["role"].eqNullSafe(y["role"])
    first = lambda rows: F.filter(rows, lambda x, i: (i == 0) | ~same(x, F.get(rows, i - 1)))
    kept = let(F.sort_array(F.filter(every, lambda x: x["e"]["name"] != "")), first)  # sorted by name and role, so that equal ones are neighbours
    return F.transform(F.sort_array(F.transform(kept, lambda x: x["e"])), lambda e: F.struct(e["name"].alias("name"), e["role"].alias("role"), e["entity_id"].alias("entity_id")))


def release_price(plain: Column) -> Column:
    return F.regexp_replace(group(plain, r"([0-9,]+\.?[0-9]*)"), ",", "").try_cast("double")


def release_currency(plain: Column, smalls: Column) -> Column:
    small = F.get(F.filter(F.transform(smalls, lambda t: F.upper(trim(t))), lambda t: t.rlike(f"^({rules.CODES})")), F.lit(0))
    return F.coalesce(F.regexp_extract(small, f"^({rules.CODES})", 1), rules.symbol_currency(plain))


def barcode(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.char_length(digits).between(8, 14), digits)


def release_barcode(f: Parts = F.col) -> Column:
    """The first source that is there decides, even when its code is invalid."""
    coded, titled = group(f("product"), "jan:([0-9]+)"), group(f("buy_title"), r"Buy\s*\(([0-9]+)\)")
    return F.when(coded.isNotNull(), barcode(coded)).when(titled.isNotNull(), barcode(titled)).when(f("buy_text").isNotNull(), barcode(trim(f("buy_text")))).when(f("boxed_text").isNotNull(), barcode(trim(f("boxed_text"))))


def releases(fields: DataFrame) -> DataFrame:
    """page_id, pos, date, price, currency, is_rerelease, jan, variant.

    The labelled field is the original; unlabelled ones that follow it without a gap and show a date are rereleases.
    """
    by = Window.partitionBy("page_id").orderBy("ord")
    is_release = F.coalesce(F.col("rule.strategy") == "releases", F.lit(False))
    shown = (F.when(F.col("date").isNotNull(), F.col(c)).alias(c) for c in ("plain", "smalls", "product", "buy_title", "buy_text", "boxed_text", "variant"))
    rows = fields.select("page_id", "ord", "after", "previous", "label", "date", *shown, is_release.alias("labelled"))
    rows = rows.where("labelled or date is not null")  # no other field can be a release; one between two of them is a gap, as ``previous`` tells
    rows = rows.withColumn("main", F.min(F.when(F.col("labelled"), F.col("ord"))).over(by)).withColumn("before", F.lag("ord").over(by)).where("main is not null")
    near = (F.col("after") == F.col("previous")) & (F.col("previous") == F.col("before")) & ((F.col("label") == "") | F.col("labelled")) & F.col("date").isNotNull() & (F.col("ord") != F.col("main"))
    rows = rows.withColumn("goes_on", F.coalesce(near, F.lit(False)))
    gaps = F.sum(F.when(F.col("goes_on") | (F.col("ord") == F.col("main")), 0).otherwise(1)).over(by)
    rows = rows.withColumn("gaps", gaps).where("gaps = 0 and date is not null")
    rows = rows.withColumn("date", trim("date")).withColumn("date", F.explode(F.array(catalog_date(F.col("date"))))).where("date is not null")  # generated, so that the filter doesn't repeat it
    out = rows.withColumn("plain", trim("plain")).select(
        "page_id", "ord", "date", release_price(F.col("plain")).alias("price"), release_currency(F.col("plain"), F.col("smalls")).alias("currency"),
        F.col("goes_on").alias("is_rerelease"), release_barcode().alias("jan"), filled(trim("variant")).alias("variant"),
    )
    return out.select("page_id", F.row_number().over(by).alias("pos"), "date", "price", "currency", "is_rerelease", "jan", "variant")


def releases_of(table: Column) -> Column:
    """``releases`` of a page whose fields are ``ruled``, as an array of date, price, currency, is_rerelease, jan and variant."""
    labelled = lambda x: F.coalesce(x["rule"]["strategy"] == "releases", F.lit(False))
    shown = F.filter(table, lambda x: labelled(x) | x["f"]["date"].isNotNull())
    main = lambda rows: F.array_position(F.transform(rows, labelled), F.lit(True)).cast("int")
    since = let(shown, lambda rows: F.filter(rows, lambda x, i: (main(rows) > 0) & (i >= main(rows) - 1)))

    def near(x: Column, before: Column) -> Column:
        own = x["f"]
        follows = (own["after"] == own["previous"]) & (own["previous"] == before["f"]["ord"]) & ((x["label"] == "") | labelled(x)) & own["date"].isNotNull()
        return F.coalesce(follows, F.lit(False))

    def run(rows: Column) -> Column:
        gap = F.array_position(F.transform(rows, lambda x, i: (i > 0) & ~near(x, F.get(rows, i - 1))), F.lit(True)).cast("int")
        return let(F.when(gap > 0, gap - 1).otherwise(F.size(rows)), lambda n: F.transform(F.slice(rows, 1, n), lambda x, i: F.struct(x.alias("x"), (i > 0).alias("later"), catalog_date(trim(x["f"]["date"])).alias("date"))))

    def one(r: Column) -> Column:
        f = _parts(r["x"])
        plain = lambda p: F.struct(
            r["date"].alias("date"), release_price(p).alias("price"), release_currency(p, f("smalls")).alias("currency"), r["later"].alias("is_rerelease"), release_barcode(f).alias("jan"), filled(trim(f("variant"))).alias("variant"),
        )
        return let(trim(f("plain")), plain)

    return F.transform(F.filter(let(since, run), lambda r: r["date"].isNotNull()), one)


def field_audit(fields: DataFrame) -> DataFrame:
    """page_id, ord, label, has_entries, has_roles, entry_count, value_preview, role_texts, known."""
    return fields.where("label <> ''").select(
        "page_id", "ord", "label", (F.col("boxes") > 0).alias("has_entries"), (F.size("roles") > 0).alias("has_roles"), F.col("boxes").alias("entry_count"),
        F.substring(trim("value"), 1, PREVIEW).alias("value_preview"), _not_empty(_trimmed("roles")).alias("role_texts"), F.col("rule").isNotNull().alias("known"),
    )


def label_frequency(audit: DataFrame, pages: int) -> DataFrame:
    """label, n (fields, so repeats on a page count), its share of pages in whole percent, and its place: most frequent
    first, then by name.  Labels are few; the order is over them, not over fields."""
    counted = audit.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", F.floor(100 * F.col("n") / pages + 0.5).cast("int"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).orderBy("place")


def role_variations(audit: DataFrame) -> DataFrame:
    return audit.select("label", F.explode("role_texts").alias("role")).groupBy("label").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def role_frequency(audit: DataFrame) -> DataFrame:
    """label, role and n, the fields that have the role."""
    return audit.select("label", F.explode("role_texts").alias("role")).groupBy("label", "role").agg(F.count(F.lit(1)).alias("n"))


def related_items(pages: DataFrame) -> DataFrame:
    """page_id, pos, item_id, name, image_url, relation_type; items without an id (or id 0) are left out."""
    rows = pages.select("page_id", F.explode("related").alias("r")).select("page_id", "r.*").withColumn("item_id", F.nullif(trailing_id(F.col("href")), F.lit(0)))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("at"))
    return rows.where("item_id is not null").select("page_id", pos.alias("pos"), "item_id", F.coalesce(filled(F.col("title")), filled(trim("text"))).alias("name"), filled(F.col("image")).alias("image_url"), filled(trim("relation")).alias("relation_type"))


def related_items_of(related: Column) -> Column:
    """``related_items`` of a page, as an array of item_id, name, image_url and relation_type."""
    body = lambda r: F.struct(
        F.nullif(trailing_id(r["href"]), F.lit(0)).alias("item_id"), F.coalesce(filled(r["title"]), filled(trim(r["text"]))).alias("name"), filled(r["image"]).alias("image_url"), filled(trim(r["relation"])).alias("relation_type"),
    )
    every = F.sort_array(F.transform(related, lambda r: F.struct(r["at"].alias("at"), body(r).alias("x"))))
    return F.transform(F.filter(every, lambda r: r["x"]["item_id"].isNotNull()), lambda r: r["x"])
