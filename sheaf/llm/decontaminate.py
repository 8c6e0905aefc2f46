"""Benchmark decontamination with a broadcast hash set of normalised n-grams, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, lower_ascii, materialize, row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that still has capitals, each with what follows it up to the next word.
RAW_WORD, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
WINDOW, ANCHOR = 13, 4
#: N-grams of one broadcast set (some 200 bytes each) and so ten times as many anchors (some 40 bytes each): 120 MB
#: together; longer benchmarks are scanned for in several such slices.
MAX_GRAMS = 200_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text.cast("string")), F.lit(WORD), 0), F.array().cast("array<string>"))


def gram(words: Column, start: Column, n) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def anchor(words: Column, start: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), F.slice(words, start, min(n, ANCHOR)))


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the benchmark: n, gram, words, items."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    starts = items.select("item", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("start"))
    grams = starts.select("item", "n", F.slice("words", F.col("start"), F.col("n")).alias("words"))
    return grams.groupBy("n", "words").agg(F.collect_set("item").alias("items")).select("n", "words", F.array_join("words", " ").alias("gram"), "items")


def _candidates(rows: DataFrame, part: DataFrame, lengths: list[int]) -> DataFrame:
    """k1, k2, doc_id, n, at: stretches of ``rows`` (k1, k2, doc_id, words, marks) that the hash set of ``part``'s anchors holds, and the marks."""
    steps = {n: n - min(n, ANCHOR) + 1 for n in lengths}

    def stretches(n: int) -> Column:
        last = F.size("words") - min(n, ANCHOR)
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(steps[n])))
        return F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), anchor(F.col("words"), i + 1, n).alias("hash")))

    hashes = None
    for n in lengths:
        mine = part.where(F.col("n") == n).select(F.explode(F.array(*(anchor(F.col("words"), F.lit(i), n) for i in range(1, steps[n] + 1)))).alias("hash"))
        hashes = mine if hashes is None else hashes.union(mine)
    hashes = hashes.distinct().withColumn("held", F.lit(True))
    # only keys and positions leave the row; the words stay behind
    near = rows.select("k1", "k2", "doc_id", F.explode(F.concat("marks", *map(stretches, lengths))).alias("a")).select("k1", "k2", "doc_id", "a.*")
    return near.join(F.broadcast(hashes), "hash", "left").where("n = 0 or held").select("k1", "k2", "doc_id", "n", "at")


def find_hits(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: k1, k2, doc_id, n_words of every row, and k1, k2, start (from 1), n, items of every occurrence of a benchmark window.

    ``grams`` is a written table.  A window of n words holds exactly one stretch of min(n, 4) words that starts at a
    multiple of its step n - min(n, 4) + 1.  Those stretches alone are looked up first, in a broadcast set of hashes;
    rows that have some are read once more, and around each stretch the windows that hold it are looked up whole, as
    strings, in the broadcast set of n-grams.  A row's words are never copied, so the cost follows the text's length.
    """
    slices = max(1, -(-grams.count() // MAX_GRAMS))
    lengths = sorted(r.n for r in grams.select("n").distinct().collect()) or [1]
    keyed = docs.select(*row_key(docs), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    mark = F.array(F.struct(F.lit(0).alias("n"), F.size("words").alias("at"), F.lit(None).cast("long").alias("hash")))
    words, hits = None, None
    for k in range(slices):
        part = grams.where(F.pmod(F.xxhash64("gram"), F.lit(slices)) == k)
        marked = keyed.withColumn("marks", mark if k == 0 else F.filter(mark, lambda m: F.lit(False)))
        found = materialize(_candidates(marked, part, lengths), "candidates")
        words = found.where("n = 0").select("k1", "k2", "doc_id", F.col("at").cast("long").alias("n_words")) if k == 0 else words
        tried = materialize(found.where("n > 0").groupBy("k1", "k2").agg(F.collect_set(F.struct("n", "at")).alias("near")), "tried")
        again = attach(docs.select(*row_key(docs), F.col(text_col).alias("text")), tried, ("k1", "k2")).withColumn("words", words_of(F.col("text")))

        def windows(x: Column) -> Column:
            first = F.greatest(F.lit(0), x["at"] - (x["n"] - F.least(x["n"], F.lit(ANCHOR))))
            last = F.least(x["at"], F.size("words") - x["n"])
            starts = F.when(last >= first, F.sequence(first, F.greatest(first, last)))
            return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.struct(x["n"].alias("n"), (i + 1).alias("start"), gram(F.col("words"), i + 1, x["n"]).alias("gram")))

        tests = again.select("k1", "k2", F.explode(F.flatten(F.transform("near", windows))).alias("w")).select("k1", "k2", "w.*")
        some = tests.join(F.broadcast(part.select("n", "gram", "items")), ["n", "gram"]).select("k1", "k2", "start", "n", "items")
        hits = some if hits is None else hits.unionByName(some)
    return words, hits


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items (sorted as strings), spans (1-based word ranges), contaminated, and
    the row's key k1, k2.

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased.  A document word inside
    any occurrence of a benchmark window is hit, once.  Null and wordless texts have no words and are not contaminated;
    wordless items have no window; items without an id count for hits but not as items.  Texts count whole, however
    long.  Rows are judged by their own text, whether their id repeats or is null.  Empty tables: no rows, or no hits.
    """
    grams = materialize(benchmark_grams(benchmark, window), "grams")
    words, hits = find_hits(docs, grams, id_col, text_col)
    by_row = hits.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))).alias("found"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda i: i.cast("string"))).alias("items"),
    )
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["start"], x["stop"] - 1)))))
    spans = F.expr("""
        zip_with(filter(hit, (p, i) -> i = 0 or get(hit, i - 1) < p - 1), filter(hit, (p, i) -> i = size(hit) - 1 or get(hit, i + 1) > p + 1),
                 (a, b) -> named_struct('start', a, 'stop', b + 1))
    """)
    by_row = materialize(by_row.select("k1", "k2", "items", places.alias("hit")).select("k1", "k2", "items", spans.alias("spans"), F.size("hit").cast("long").alias("hit")), "hits")
    out = attach(words, by_row, ("k1", "k2"), "left").withColumn("n_hit", F.coalesce("hit", F.lit(0)).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), items.alias("items"), "spans", contaminated.alias("contaminated"), "k1", "k2")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document") -> DataFrame:
    """``docs`` without its contaminated documents; ``mode='span'`` keeps them, without the words that were hit.

    Each row is judged by its own text, so rows without an id or with a repeated one go or stay like all others; rows
    equal in every column go together.  Null, blank and very long texts: as in ``judge``.
    """
    flagged = judge(docs, benchmark).where("contaminated").select("k1", "k2", F.col("spans").alias("_spans")).dropDuplicates(["k1", "k2"])
    flagged = materialize(flagged, "contaminated")
    keyed = docs.select(F.struct("*").alias("row"), *row_key(docs))
    if mode == "document":
        return attach(keyed, flagged.select("k1", "k2"), ("k1", "k2"), "left_anti").select("row.*")
    joined = attach(keyed, flagged, ("k1", "k2"), "left").withColumn("_text", F.col("row.text"))
    pieces = F.when(F.col("_spans").isNotNull(), F.regexp_extract_all("_text", F.lit(f"{RAW_WORD}{GAP}"), 0))
    kept = F.expr("""
        flatten(transform(sequence(0, size(_spans)), i -> slice(_pieces, if(i = 0, 1, _spans[i - 1].stop), if(i = size(_spans), size(_pieces) + 1, _spans[i].start) - if(i = 0, 1, _spans[i - 1].stop))))
    """)
    cut = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(F.concat(F.regexp_extract("_text", f"^{GAP}", 0), F.array_join(kept, "")))
    return joined.withColumn("_pieces", pieces).withColumn("row", F.col("row").withField("text", cut)).select("row.*")
