"""Inventory files: comma-separated lines whose header tells what the columns mean."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled, trim
from ..session import written

MAX_LINE = 100_000
#: Places of columns that the header doesn't name.
PLACES = {"id": 0, "name": 1, "category": 2, "status": 3, "release_date": 4, "price": 5}
#: What a header contains, letters and digits only, for each field.
HEADERS = {"id": ("id",), "name": ("name", "title"), "category": ("category", "type"), "status": ("status", "owned"), "release_date": ("release", "date"), "price": ("price", "cost"), "nsfw": ("nsfw", "adult")}


def split_fields(line: Column) -> Column:
    """Fields of a line.  A quote switches quoting anywhere, two within quotes are one, commas within quotes don't split."""
    line = F.substring(line, 1, MAX_LINE)
    quotes = F.char_length(line) - F.char_length(F.replace(line, F.lit('"')))
    even = F.when(quotes % 2 == 1, F.concat(line, F.lit('"'))).otherwise(line)
    plain = F.transform(F.split(line, ",", -1), trim)
    cut = F.regexp_extract_all(F.concat(even, F.lit(",")), F.lit(r'((?:[^",]++|"[^"]*+")*+),'), 1)
    quoted = F.transform(cut, lambda f: trim(F.replace(F.regexp_replace(f, r'"((?:[^"]|"")*+)"', "$1"), F.lit('""'), F.lit('"'))))
    return F.when(quotes == 0, plain).otherwise(quoted)


def header_fields(header: list[str]) -> dict[str, int]:
    """Field to column number; of several headers that fit the last one counts."""
    out: dict[str, int] = {}
    for i, h in enumerate(header):
        h = re.sub("[^a-z0-9]", "", h.lower())
        out |= {k: i for k, parts in HEADERS.items() if any(p in h for p in parts) or (k == "id" and h == "item")}
    return out


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files with their place: value, and at (file, start of the split, number in it)."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select("value", place.alias("at"))


def first_line(lines: DataFrame) -> str:
    """The first line that isn't blank, of lines that carry their place; empty if there is none."""
    if "at" not in lines.columns:
        raise ValueError("lines without a place have no first one: give the header")
    return lines.where(trim("value") != "").agg(F.min_by("value", "at").alias("value")).first().value or ""


def parse_inventory(lines: DataFrame, header: str | None = None) -> DataFrame:
    """Lines (column ``value``) to item_id, name, category, status, release_date, price, is_nsfw.

    ``header`` is the first line that isn't blank, found if not given (``read_lines``); lines equal to it are no items.
    Rows whose id isn't all digits are dropped; a column that is absent, or a line too short, gives null.
    """
    header = first_line(lines) if header is None else header
    rows = lines.select(trim("value").alias("value")).where("value <> ''")
    names = [r for r in lines.sparkSession.createDataFrame([(header,)], "value string").select(split_fields(F.col("value"))).first()[0]]
    at = header_fields(names)
    rows = rows.where(F.col("value") != trim(F.lit(header)))
    rows = rows.select(F.explode(F.array(split_fields(F.col("value")))).alias("f"))  # a step of its own: else the test of the id would split each line once more
    field = lambda k: F.get(F.col("f"), F.lit(at.get(k, PLACES.get(k))))
    nsfw = F.coalesce(F.lower(field("nsfw")).isin("true", "1", "yes"), F.lit(False)) if "nsfw" in at else F.lit(None).cast("boolean")
    return _items(rows, field, nsfw)


def _items(rows: DataFrame, field, nsfw: Column) -> DataFrame:
    status = F.lower(F.coalesce(field("status"), F.lit("")))
    out = rows.select(
        field("id").alias("item_id"), filled(field("name")).alias("name"), filled(field("category")).alias("category"),
        F.when(status.contains("owned"), "owned").when(status.contains("order"), "ordered").otherwise("wished").alias("status"),
        filled(field("release_date")).alias("release_date"), filled(field("price")).alias("price"), nsfw.alias("is_nsfw"),
    )
    return out.where(F.col("item_id").rlike(r"^[0-9]+\z"))


#: Files whose headers are broadcast.
FILES_AT_ONCE = 1_000_000


def file_headers(lines: DataFrame) -> DataFrame:
    """Per file of ``read_lines``: file, header (its first line that isn't blank) and the number of each field's column."""
    first = lines.where(trim("value") != "").groupBy(F.col("at.file").alias("file")).agg(F.min_by("value", "at").alias("header"))
    first = first.withColumn("header", trim("header"))
    names = F.transform(split_fields(F.col("header")), lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]", ""))

    def place(field: str) -> Column:
        def fits(h: Column, i: Column) -> Column:
            test = (h == "item") if field == "id" else F.lit(False)
            for part in HEADERS[field]:
                test = test | h.contains(part)
            return F.when(test, i)

        return F.array_max(F.transform("names", fits))

    placed = first.select("file", "header", F.explode(F.array(names)).alias("names"))
    return placed.select("file", "header", *(F.coalesce(place(k), F.lit(PLACES.get(k))).cast("int").alias(f"_{k}") for k in HEADERS))


def parse_inventory_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``parse_inventory`` over many files, each read by its own header: columns may come in any order and number.

    A file's lines that equal its header are no items; a field that the header doesn't name is looked for in its usual
    place, the adult flag is null then.  Empty files give no rows.
    """
    lines = read_lines(spark, path)
    headers = written(file_headers(lines), "headers")
    few = headers.limit(FILES_AT_ONCE + 1).count() <= FILES_AT_ONCE
    rows = lines.select(trim("value").alias("value"), F.col("at.file").alias("file")).where("value <> ''")
    rows = rows.join(F.broadcast(headers) if few else headers, "file").where("value <> header")
    rows = rows.select(*(f"_{k}" for k in HEADERS), F.explode(F.array(split_fields(F.col("value")))).alias("f"))
    field = lambda k: F.get(F.col("f"), F.col(f"_{k}"))
    nsfw = F.when(F.col("_nsfw").isNotNull(), F.coalesce(F.lower(field("nsfw")).isin("true", "1", "yes"), F.lit(False)))
    return _items(rows, field, nsfw)


def literal_ids(spark: SparkSession, ids: str) -> DataFrame:
    """Ids of a comma list; parts that don't start with a number are left out."""
    parts = spark.createDataFrame([(ids,)], "ids string").select(F.explode(F.split("ids", ",")).alias("value"))
    return leading_ids(parts)


def listed_ids(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``id``, one row for each id of the comma list in ``column``, under the same rule; rows without one go."""
    parts = rows.withColumn("_part", F.explode(F.split(F.col(column), ",")))
    return parts.withColumn("id", leading_id("_part")).where("id is not null").drop("_part")


def file_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of text files, one a line, under the same rule."""
    return leading_ids(spark.read.text(path))


def leading_ids(lines: DataFrame) -> DataFrame:
    return lines.select(leading_id("value").alias("id")).where("id is not null")


def leading_id(column: str) -> Column:
    return F.regexp_extract(trim(column), r"^([+-]?[0-9]+)", 1).try_cast("bigint")


def id_page(ids: DataFrame, skip: int = 0, most: int | None = None) -> DataFrame:
    """Ids in ascending order, from the ``skip``th on, ``most`` of them."""
    rows = ids.where("id is not null").orderBy("id").offset(skip)
    return rows if most is None else rows.limit(most)


def item_count(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank, less the header."""
    return lines.agg(F.greatest(F.count_if(trim(F.col("value")) != "") - 1, F.lit(0)).alias("items"))
