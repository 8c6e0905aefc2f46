"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, materialize

#: The filter has a 64-bit word for each so many rows, whatever their number; a row sets two bits of one word.
ROWS_PER_WORD = 4
#: Words of the filter that are broadcast at once (some 40 MB); a larger one is probed slice by slice.
SLICE_WORDS = 1_000_000


def normalised(text: Column) -> Column:
    """Null as empty, each run of blanks as one space; texts without such a run skip the rewrite."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, BLANK, " ")).otherwise(text)


def placed(digests: DataFrame, words: int) -> DataFrame:
    """``digests`` with the filter's word of each row and the mask of its two bits there."""
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("_h", shift).bitwiseAND(63).cast("int"))
    rows = digests.withColumn("_h", F.xxhash64("text_sha256", F.lit(29)))
    return rows.withColumns({"word": F.pmod(F.xxhash64("text_sha256"), F.lit(words)), "mask": bit(0).bitwiseOR(bit(6))}).drop("_h")


def repeated_filter(digests: DataFrame, words: int) -> DataFrame:
    """First pass: the Bloom filter of the bit patterns that two or more rows set: word, mask.

    What moves is one small pattern for each distinct row of a task, combined before it is sent, and no row.
    """
    twice = placed(digests, words).groupBy("word", "mask").count().where("count > 1")
    return twice.groupBy("word").agg(F.bit_or("mask").alias("twice"))


def probe(digests: DataFrame, filter_: DataFrame, words: int) -> DataFrame:
    """Second pass: ``digests`` with ``maybe``: all bits of the row are in the filter.  Rows stay where they are."""
    slices = max(1, -(-filter_.count() // SLICE_WORDS))
    of = lambda frame, k: frame if slices == 1 else frame.where(F.pmod("word", F.lit(slices)) == k)
    out = None
    for k in range(slices):
        part = of(placed(digests, words), k).join(F.broadcast(of(filter_, k)), "word", "left")
        part = part.select(*digests.columns, F.coalesce(F.col("twice").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)).alias("maybe"))
        part = materialize(part, f"probed{k}")
        out = part if out is None else out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal when they agree as a whole, however long, after each run of blanks became one space; null counts
    as empty, so null and empty texts form one group.  The smallest id of a group stays.  Rows that repeat an id and its
    text count as rows of the group and share one decision; a row without an id stays only in a group without ids.  An
    empty table gives no rows.

    A first pass over the digests fills a Bloom filter, sized by the rows, with what was set twice; in the second pass
    only rows that are in it shuffle by digest, all others are alone and pass straight through.
    """
    digests = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    digests = materialize(digests, "digests")
    words = digests.count() // ROWS_PER_WORD + 1
    probed = probe(digests, materialize(repeated_filter(digests, words), "filter"), words)
    again = probed.where("maybe").select("doc_id", "text_sha256")
    groups = again.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialize(groups, "groups")  # read back, both join sides are plain shuffles, which adaptive execution can split
    alone = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    shared = again.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "text_sha256",
    )
    return alone.unionByName(shared).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
