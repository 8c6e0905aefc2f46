"""Phrase collocation mining: weighted n-grams of distinct pieces, counted in duckdb a hash bucket at a time."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, lower_ascii, materialize
from .tokens import STEP, mix

#: Words of a phrase at most, its least frequency, phrases a language reports.
LONGEST, LEAST, TOP = 5, 100, 2000
#: The score of a cut; its products have up to 38 digits, its quotient is that of whole numbers.
EXACT = (
    "cast((cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div "
    "(cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"
)
#: Words that a task counts together before it sends them on; memory that duckdb counts a bucket in before it spills.
WORDS_AT_ONCE, DUCKDB_MEMORY = 1_000_000, "256MB"
#: A filter has 16 bits for each gram, and no more than so many altogether (16 MB).
MOST_BITS = 1 << 27


def pieces_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Distinct pieces with how often they occur: lang, piece (words joined by a space), times, words."""
    text = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    cut = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]+")).alias("piece"))
    cut = cut.withColumn("piece", F.when(F.col("piece").contains("\t"), F.translate("piece", "\t", " ")).otherwise(F.col("piece")))
    cut = cut.withColumn("piece", F.trim(F.when(F.col("piece").contains("  "), F.regexp_replace("piece", "  +", " ")).otherwise(F.col("piece")))).where("piece <> ''")
    words = F.char_length("piece") - F.char_length(F.replace("piece", F.lit(" "))) + 1
    return cut.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times")).withColumn("words", words.cast("long"))


def joined_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of word pairs from those of their words."""
    return mix(first * STEP + last)


class Filter:
    """Bits of grams that are frequent: false positives only cost rows."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(64 * len(bits) - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in (h & self.mask, h >> np.uint64(32) & self.mask):
            out &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def gram_hashes(langs: list[str], grams: list[str]) -> np.ndarray:
    """Hashes of words and of word pairs, as chunks have them."""
    out = np.empty(len(grams), np.uint64)
    for k, (lang, gram) in enumerate(zip(langs, grams, strict=True)):
        h = np.array([xxhash.xxh3_64_intdigest(w, seed=seed_of(lang)) for w in gram.encode().split(b" ")], np.uint64)
        out[k] = h[0] if len(h) == 1 else joined_hash(h[:1], h[1:])[0]
    return out


def filter_of(grams: DataFrame) -> Filter:
    """Filter over a written table of words or pairs; words of bits are combined by Spark, the driver holds 16 MB at most."""
    bits = 1 << 10
    while bits < min(MOST_BITS, 16 * grams.count()):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(gram_hashes(b.column(0).to_pylist(), b.column(1).to_pylist()).view(np.int64))], names=["h"])

    hashes = grams.select("lang", "gram").mapInArrow(run, "h long")
    places = F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1)))
    word = hashes.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    held = word.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[held.column("w").to_numpy()] = held.column("b").to_numpy().view(np.uint64)
    return Filter(out)


def seed_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


class Numbers(dict):
    """Words of a chunk by number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Chunk:
    """Words of some pieces of one language, in a row."""

    def __init__(self, lang: str, pieces: list[str], times: list[int], sizes: list[int]):
        known, length = Numbers(), np.array(sizes, np.int64)
        words = " ".join(pieces).encode().split(b" ")
        self.ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.weight, self.left = np.repeat(np.array(times, np.int64), length), np.repeat(np.cumsum(length), length) - np.arange(len(words))
        self.names, seed = list(known), seed_of(lang)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seed) for w in self.names), np.uint64, len(self.names))

    def sums(self, number: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Weights at the places ``at`` by their number."""
        total = np.zeros(n, np.int64)
        np.add.at(total, number, self.weight[at])
        return total

    def grams(self, sizes: tuple[int, ...], words: Filter | None, pairs: Filter | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Phrases of ``sizes`` words with their weight.

        A gram counts only while its words and word pairs may be frequent: whatever holds a rarer one is rarer itself.
        """
        vocabulary = names = pa.array(self.names, pa.binary()).cast(pa.string())
        if 1 in sizes:
            yield names, self.sums(self.ids, np.arange(len(self.ids)), len(names))
        if max(sizes) == 1:
            return
        good = np.ones(len(self.ids), bool) if words is None else words.holds(self.hashes)[self.ids]
        at = np.flatnonzero(good[:-1] & good[1:] & (self.left[:-1] > 1))
        if pairs is not None:
            at = at[pairs.holds(joined_hash(self.hashes[self.ids[at]], self.hashes[self.ids[at + 1]]))]
        follows = np.zeros(len(self.ids), bool)
        follows[at] = True
        number = self.ids.copy()
        for n in range(2, max(sizes) + 1):
            if n > 2:
                at = at[self.left[at] >= n]
                at = at[follows[at + n - 2]]
            if not len(at):
                return
            key, found = np.unique(number[at] * len(vocabulary) + self.ids[at + n - 1], return_inverse=True)
            names = pc.binary_join_element_wise(names.take(pa.array(key // len(vocabulary))), vocabulary.take(pa.array(key % len(vocabulary))), " ")
            number[at] = found
            if n in sizes:
                yield names, self.sums(found, at, len(names))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Chunk]]:
    """Pieces (lang, piece, times, words) by language, about a million words together."""
    held: dict[str, tuple[list, list, list]] = {}
    size = 0
    for b in batches:
        for lang, piece, times, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = held.setdefault(lang, ([], [], []))
            own[0].append(piece)
            own[1].append(times)
            own[2].append(n)
            size += n
            if size >= WORDS_AT_ONCE:
                yield from ((k, Chunk(k, *v)) for k, v in held.items())
                held.clear()
                size = 0
    yield from ((k, Chunk(k, *v)) for k, v in held.items())


def scratch() -> str:
    """A folder for duckdb's spill in the space that Spark gives its tasks, emptied by the task itself."""
    spark = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.mkdtemp(prefix="grams-", dir=spark if spark and os.path.isdir(spark) else None)


def counted(sent: DataFrame, key: str, least: int) -> DataFrame:
    """``sent`` (key columns and f), dealt by key and summed by duckdb, a hash bucket at a time and spilling where one is
    large: keys that reach ``least``, as a written table."""
    names = [x.strip() for x in key.split(",")]
    kind = ", ".join(f"{c} {sent.schema[c].dataType.simpleString()}" for c in (*names, "f"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        folder = scratch()
        try:
            with duckdb.connect(config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False}) as db:
                db.register("bucket", pa.RecordBatchReader.from_batches(first.schema, chain([first], batches)))
                yield from db.sql(f"select {key}, cast(sum(f) as bigint) as f from bucket group by {key} having sum(f) >= {least}").to_arrow_reader(50_000)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return materialize(sent.repartition(*names).mapInArrow(count, kind), "counted")


def count_grams(pieces: DataFrame, sizes: tuple[int, ...], words: Filter | None = None, pairs: Filter | None = None, least: int = LEAST) -> DataFrame:
    """Phrases of ``sizes`` words that occur ``least`` times or more: lang, gram, f; a task sends a phrase once for every
    million words."""
    shared = pieces.sparkSession.sparkContext.broadcast((words, pairs))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, c in chunks(batches):
            for names, f in c.grams(sizes, *shared.value):
                for k in range(0, len(names), 100_000):
                    gram = names.slice(k, 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), gram, pa.array(f[k : k + 100_000])], names=["lang", "gram", "f"])

    return counted(pieces.mapInArrow(emit, "lang string, gram string, f long"), "lang, gram", least)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's best phrases of two to five words: lang, rank, phrase, a, l, r, n, score.

    ``a`` is how often the phrase occurs within pieces, overlaps included; cut after its first k words, ``l`` and ``r`` are
    the same of its parts, ``n`` the language's words, and the score floor(1000 * a * n / (l * r)) of the lowest cut (the
    first of equal ones), exact whatever the size of the products.  Phrases as frequent as a longer candidate that holds
    them are dropped.  Ranks go by score, then a, then the phrase's bytes.

    Null texts count as empty, null languages as ``und``; texts are taken whole, however long; repeated rows and ids each
    count.  Phrases below ``least`` occurrences are no candidates; an empty table gives no rows.

    Equal pieces are counted once with their number.  A part of a candidate is at least as frequent as it, so only
    frequent grams are kept, and only phrases of frequent words and pairs are counted.  Candidates ask for their parts by a
    shuffled request each.
    """
    pieces = materialize(pieces_of(docs, text_col, lang_col), "pieces")
    one = count_grams(pieces, (1,), least=least)
    words = filter_of(one)
    two = count_grams(pieces, (2,), words, least=least)
    more = count_grams(pieces, tuple(range(3, LONGEST + 1)), words, filter_of(two), least)
    grams = one.unionByName(two).unionByName(more)
    w = F.split("gram", " ")
    candidates = grams.select("lang", "gram", F.col("f").alias("a"), w.alias("w")).where(F.size("w") > 1)
    joined = lambda x: F.array_join(x, " ")
    cuts = candidates.select("lang", "gram", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit("l").alias("side"), joined(F.slice("w", F.lit(1), F.col("k"))).alias("part")),
        F.struct(F.lit("r").alias("side"), joined(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("part")),
    )
    requests = cuts.select("lang", "gram", "a", "k", F.size("w").alias("size"), F.inline(sides))
    held = grams.select("lang", F.col("gram").alias("part"), "f")
    replies = materialize(requests.hint("merge").join(held, ["lang", "part"]), "replies")
    longest = (F.col("side") == "l") & (F.col("k") == F.col("size") - 1) | (F.col("side") == "r") & (F.col("k") == 1)
    covered = replies.where(longest & (F.col("size") > 2) & (F.col("f") <= F.col("a"))).select("lang", F.col("part").alias("gram")).distinct()
    totals = materialize(pieces.groupBy("lang").agg(F.sum(F.col("times") * F.col("words")).alias("n")), "totals")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    scored = replies.groupBy("lang", "gram", "a", "k").agg(side("l"), side("r"))
    scored = attach(scored, totals, "lang")
    scored = scored.withColumn("score", F.expr(EXACT))
    best = scored.groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = best.hint("merge").join(covered, ["lang", "gram"], "left_anti").select("lang", F.col("gram").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
