"""From raw documents to a sharded training mix, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import decontaminate, mixing, near_dedup, quality, sharding
from sheaf.llm.common import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels at hand, doesn't reject.

    Null, empty and very long texts are scored like any other; each row counts by itself, repeated or null ids too.
    Without labels of both kinds all rows have one score.  Empty tables give no rows; columns stay as they are.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8 and more, ties included).

    The smallest id of a group stays, rows without an id come last; rows equal in every column are one; null and wordless
    texts are no copies and stay.  Empty tables give no rows; columns stay as they are.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in 13-word windows of the benchmark.

    Rows are judged by their own text, repeated or null ids too; null and wordless texts stay.  An empty benchmark drops
    nothing; empty tables give no rows; columns stay as they are.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target asks for, from never to twice.

    A null source is a source; null and wordless texts have no words to take and go; rows with repeated or null ids draw
    for themselves.  Empty tables give no rows; columns stay as they are.
    """
    return mixing.mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard (of 8, near equal in bytes, equal texts together) and its slot there, without gaps.

    Null texts count as empty, rows with repeated or null ids have slots of their own; columns named shard or slot give
    way.  Empty tables give no rows.
    """
    return sharding.shard_corpus(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]
#: Fitted models and random draws have no SQL; the tests hold run() against the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
