"""Sharding by minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted

FIRST_BITS, STEP_BITS, KEY_BITS = 12, 6, 64
#: Rows of a shard are numbered in hash blocks of about so many, so that no task sorts a whole shard; blocks of a shard at
#: most, whose starts are broadcast.
BLOCK_ROWS, MOST_BLOCKS = 10_000, 50_000


def cuts_for(ends: list[int], capacity: int, most: int) -> list[int]:
    """Greedy check: the furthest cut positions for ``capacity``; at most ``most`` of them."""
    cuts, at = [], 0
    while at < len(ends) and len(cuts) < most:
        base = ends[at - 1] if at else 0
        to = bisect_right(ends, base + capacity)
        if to == at:
            break
        cuts.append(to)
        at = to
    return cuts


def _ahead(ends: list[int], capacity: int, most: int) -> list[int]:
    """As ``cuts_for``, but each cut is rounded up to a cell's end: no cut inside a cell can lie further."""
    cuts, at = [], 0
    while at < len(ends) and len(cuts) < most:
        base = ends[at - 1] if at else 0
        at = min(len(ends), bisect_right(ends, base + capacity) + 1)
        cuts.append(at)
    return cuts


def _smallest(low: int, high: int, feasible) -> int:
    while low < high:
        mid = (low + high) // 2
        if feasible(mid):
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First keys of shards 1.. under the smallest feasible capacity.

    ``groups`` has ``key`` (long), ``bytes`` and no key twice.  The driver holds sums over key ranges only: 2**12 ranges
    at first, and then those in which a cut may lie are split by 6 more bits until they hold one group each.
    """

    def cells(bits: int, where) -> list[tuple[int, int, int, int]]:
        width = KEY_BITS - bits
        rows = where.groupBy(F.shiftright("key", width).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("largest"), F.min("key").alias("first")).collect()
        return [(r.first, r.bytes, r.n, r.largest, bits) for r in rows]

    held = sorted(cells(FIRST_BITS, groups))
    while held:
        ends, firsts = list(accumulate(c[1] for c in held)), [c[0] for c in held]
        total, largest = ends[-1], max(c[3] for c in held)
        high = _smallest(largest, total, lambda c: (cut := cuts_for(ends, c, shards)) and cut[-1] == len(held))
        low = _smallest(largest, high, lambda c: _ahead(ends, c, shards)[-1] == len(held))
        near, far = cuts_for(ends, low, shards), _ahead(ends, high, shards)
        unsure = set()
        for k, to in enumerate(far):
            at = near[k] if k < len(near) else (near[-1] if near else 0)
            unsure |= {i for i in range(max(0, at - 1), min(len(held), to + 1)) if held[i][2] > 1}
        if not unsure:
            return [firsts[i] for i in cuts_for(ends, high, shards) if i < len(held)]
        for bits in {held[i][4] for i in unsure}:
            mine = [i for i in unsure if held[i][4] == bits]
            names = [held[i][0] >> (KEY_BITS - bits) for i in mine]
            held += cells(min(KEY_BITS, bits + STEP_BITS), groups.where(F.shiftright("key", KEY_BITS - bits).isin(names)))
        held = sorted(c for i, c in enumerate(held) if i not in unsure)
    return []


def plan_shards(groups: DataFrame, shards: int):
    """Keys of groups that fill a shard of their own, and the cuts of the rest over the shards that are left."""
    own, left, total = [], shards, groups.agg(F.sum("bytes")).first()[0] or 0
    for r in groups.orderBy(F.desc("bytes"), "key").limit(max(0, shards - 1)).collect():
        if r.bytes * left <= total:
            break
        own.append(r.key)
        left, total = left - 1, total - r.bytes
    rest = groups.where(~F.col("key").isin(own)) if own else groups
    return own, minimax_cuts(rest, left)


def with_shards(rows: DataFrame, shards: int = 8, narrow: DataFrame | None = None) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that have ``key``, ``size`` and ``doc_id`` (law ``bytes``).

    ``narrow``: the same rows without further columns, where ``rows`` is wide.
    """
    narrow = rows if narrow is None else narrow
    groups = materialize(narrow.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    own, cuts = plan_shards(groups, shards)
    shard = F.lit(len(own))
    for c in cuts:
        shard = shard + (F.col("key") >= F.lit(c)).cast("int")
    for i, k in enumerate(own):
        shard = F.when(F.col("key") == F.lit(k), F.lit(i)).otherwise(shard)
    blocks = min(narrow.count() // (shards * BLOCK_ROWS), MOST_BLOCKS) + 1
    place = {"shard": shard.cast("int"), "block": F.pmod(F.xxhash64("doc_id", "key"), F.lit(blocks))}
    counts = narrow.withColumns(place).groupBy("shard", "block").count()  # at most shards * (MOST_BLOCKS + 1) rows of three numbers
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "key")
    numbered = rows.withColumns(place).withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "block"]).withColumn("slot", F.col("start") + F.col("rank")).drop("block", "rank", "start")


def sized(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"), *more)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the whole text's UTF-8 bytes plus 1; null counts as empty.  Rows of equal text stay in one shard.  Groups are
    ordered by the 64-bit hash of their text (texts that share a hash count as one group) and cut where the smallest
    feasible capacity allows; a group larger than an even share gets a shard to itself first.  Rows that repeat an id
    get slots of their own.  An empty table gives no rows; with fewer groups than shards some shards stay empty.
    """
    rows = materialize(sized(docs, id_col, text_col), "sizes")
    return with_shards(rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_corpus(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``slot`` (which replace columns of those names, in any case), dealt by shard.

    Every row stays, those that repeat an id or have none too; equal texts share a shard, null counts as empty and a text
    counts with all its bytes.  An empty table gives no rows.
    """
    wide = sized(docs, id_col, text_col, F.struct(*(docs[quoted(c)] for c in docs.columns if c.lower() not in ("shard", "slot"))).alias("row"))
    narrow = materialize(sized(docs, id_col, text_col), "sizes")
    return with_shards(wide, shards, narrow).select("row.*", "shard", F.col("slot").cast("long").alias("slot"))
