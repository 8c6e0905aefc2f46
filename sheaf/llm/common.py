"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_path
from ..session import written as materialize

__all__ = ["attach", "lower_ascii", "materialize", "new_path", "row_key"]

#: The contract's whitespace: space and \t \n \v \f \r, nothing else.
BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that where every character is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def _hashable(c: Column, kind: T.DataType) -> Column:
    """``c`` with every map in it, however deep, as its sorted entries; a hash takes no maps."""
    if not _has_map(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_hashable(c.getField(f.name), f.dataType).alias(f"f{k}") for k, f in enumerate(kind))))
    entries = F.map_entries(c)
    if _has_map(kind.valueType):
        entries = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _hashable(e["value"], kind.valueType).alias("value")))
    return F.array_sort(entries)


def row_key(rows: DataFrame) -> list[Column]:
    """128 bits over all columns as two longs, ``k1`` and ``k2``: what a decision about a row is joined back by, whatever
    its id.  Rows with equal keys are equal in every column."""
    every = [_hashable(rows[quoted(f.name)], f.dataType) for f in rows.schema]
    marked = [F.struct(c.isNull(), c) for c in every]  # else a null would leave no trace in the hash
    return [F.xxhash64(F.lit(1), *marked).alias("k1"), F.xxhash64(F.lit(2), *marked).alias("k2")]


def table_bytes(facts: DataFrame) -> int:
    """Bytes of a narrow table's values, from one pass over it; ``facts`` is a written table."""
    wide = [F.col(f.name) for f in facts.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    lists = [F.col(f.name) for f in facts.schema if isinstance(f.dataType, T.ArrayType)]
    fixed = 16 * len(facts.columns) + 32
    total = F.count(F.lit(1)) * fixed
    for c in wide:
        total = total + F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    for c in lists:
        total = total + F.coalesce(F.sum(64 * F.greatest(F.size(c), F.lit(0))), F.lit(0))
    return facts.agg(total.alias("bytes")).first().bytes


#: Facts of at most so many bytes are broadcast.
BROADCAST_BYTES = 64 << 20


def attach(rows: DataFrame, facts: DataFrame, on, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join narrow per-key facts, a written table, to wide rows.

    Facts of at most ``most`` bytes, measured, are broadcast and the wide rows stay where they are; beyond that both sides
    shuffle and adaptive execution splits skewed partitions.
    """
    on = list(on) if isinstance(on, tuple) else on
    if table_bytes(facts) <= most:
        return rows.join(F.broadcast(facts), on, how)
    return rows.hint("merge").join(facts, on, how)
