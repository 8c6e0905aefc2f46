"""URL filtering by cascades of Bloom filters, in DataFrame functions only."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BITS_PER_KEY, PROBES = 64, 4
#: Listed keys of one cascade, whose levels are literals of some 128 KB; longer lists have several cascades, each for the
#: keys that one slice of the hash holds.
SLICE_KEYS = 1 << 14
#: Keys of the universe that may share a cascade: about one in 65,000 passes a level of the other side.
SLICE_UNIVERSE = SLICE_KEYS << 15
#: Cascades in one plan; after so many the answers so far are written.
PASS = 8


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key that a rule fitting this url could have: a suffix of whole labels, and a path prefix of a rule's length."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def _slots(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * PROBES + i)), F.lit(bits)) for i in range(PROBES)]


class Level:
    """One Bloom filter of a cascade; its words are a literal array, so a test is an expression on the key alone."""

    def __init__(self, keys: DataFrame, n: int, level: int):
        self.level, self.bits = level, 64
        while self.bits < BITS_PER_KEY * n:
            self.bits *= 2
        slots = keys.select(F.explode(F.array(*_slots(F.col("key"), level, self.bits))).alias("slot"))
        masks = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask"))
        found = {r.word: r.mask for r in masks.collect()}  # a slice's level, so about SLICE_KEYS rows
        self.words = ",".join(str(found.get(w, 0)) for w in range(self.bits // 64))

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded to a literal when the query is planned
        tests = [F.get(words, F.shiftright(s, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(63).cast("int"))) != 0 for s in _slots(key, self.level, self.bits)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that decide membership in ``listed`` exactly for every key of ``universe``.

    Level 0 holds the listed keys, level 1 the universe's other keys that level 0 lets through, level 2 the listed keys
    that level 1 lets through, and so on until a level lets nothing of the other side through.
    """
    levels: list[Level] = []
    inside, outside = listed, universe
    while True:
        level = Level(inside, inside.count(), len(levels))
        levels.append(level)
        through = outside.where(level.has(F.col("key")))
        if len(levels) == 1:
            through = through.join(listed, "key", "left_anti")
        through = materialize(through, "through")
        if through.isEmpty():
            return levels
        inside, outside = through, inside


def slice_of(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(slices))


def decide(levels: list[Level], key: Column) -> Column:
    """Listed or not: the first level that lacks the key tells; a key that all hold belongs to the last level's side."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict (allow or block).  A rule fits its host and the host's subdomains where the
    url's path starts with the rule's path; of those that fit the longest (host and path together) wins, of equally long
    ones an allowing rule, and of those the last by code point.  A url that no rule fits, a null url and one without
    ``://`` get no rule and the verdict ``default``: the method's own answer, as no key of it is listed.  Urls count
    whole, however long; rows are judged one by one, so repeated ids and urls agree; an empty table gives no rows.

    Lists of any length go through cascades: slices of the keys' hash have a cascade each, and a url keeps the longest
    key found so far.
    """
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    listed = rules.where("host is not null and path is not null").select(F.concat(lower_ascii(F.col("host")), "path").alias("key"), "verdict", F.char_length("path").alias("n"))
    listed = materialize(listed.distinct(), "rules")
    lengths = [r.n for r in listed.select("n").distinct().orderBy("n").collect()]
    if not lengths:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = keys_of(F.col("host"), F.col("path"), lengths)
    universe = judged.select("host", "path").distinct().select(F.explode(keys).alias("key")).distinct()
    universe = materialize(universe, "universe")
    most = max(r["count"] for r in listed.groupBy("verdict").count().collect())
    slices = max(1, -(-most // SLICE_KEYS), -(-universe.count() // SLICE_UNIVERSE))
    of = lambda frame, k: frame if slices == 1 else frame.where(slice_of(F.col("key"), slices) == k)
    best = judged.withColumns({v: F.lit(None).cast("struct<n: int, key: string>") for v in ("allow", "block")})
    for k in range(slices):
        mine = keys if slices == 1 else F.filter(keys, lambda key: slice_of(key, slices) == k)  # noqa: B023
        for v in ("allow", "block"):
            levels = cascade(of(listed.where(F.col("verdict") == v), k).select("key"), of(universe, k))
            found = F.transform(F.filter(mine, partial(decide, levels)), lambda key: F.struct(F.char_length(key).alias("n"), key.alias("key")))
            best = best.withColumn(v, F.array_max(F.concat(F.array_compact(F.array(v)), found)))
        if k % PASS == PASS - 1 and k < slices - 1:
            best = materialize(best, "best")
    blocks = F.coalesce(F.col("block.n"), F.lit(-1)) > F.coalesce(F.col("allow.n"), F.lit(-1))
    rule = F.when(blocks, F.col("block.key")).otherwise(F.col("allow.key"))
    verdict = F.when(rule.isNull(), F.lit(default)).when(blocks, F.lit("block")).otherwise(F.lit("allow"))
    return best.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")
