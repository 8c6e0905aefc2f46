"""Removal of repeated 200-byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

The corpus is cut into pieces that can be compared apart from each other.  Every 200-byte window has one minimizer: of
the hashes of its 64-byte grams the smallest, the leftmost of equal ones.  Equal windows have equal minimizers, so
consecutive windows that share a minimizer form a piece, and only pieces of one minimizer can have equal windows.
Minimizers that occur once are done, and equal pieces (128 bits of their bytes) are one piece with several places.  The
distinct pieces of a minimizer go into buckets of bounded size, and each bucket finds its equal windows on a
Burrows-Wheeler transform of its text.  Where a minimizer has very many distinct pieces they are cut once more, by other
minimizers, and so on until they fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize
from .tokens import mix, texts_of

LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1
#: Window starts of one stretch of text that a task looks at together; longer documents are taken in several.
STRETCH, PLACE_BITS = 1 << 21, 24
#: Text of one bucket's transform.
BUCKET_BYTES = 2 << 20
#: A minimizer with more distinct pieces than this (some 1.4 MB) has them cut by the minimizers of another hash; after so
#: many hashes what is left goes into one bucket.
HOT_PIECES, LEVELS = 4096, 12
_rng = np.random.default_rng(5)
#: Between the pieces of a bucket: a byte that UTF-8 never has, so no window with it is asked for.
GAP = b"\xff"
BYTE_HASH = _rng.integers(1, 1 << 63, (LEVELS, 256), dtype=np.uint64)
JOIN = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


PIECE = ("piece", "piece2")


def _gram_hashes(data: np.ndarray, level: int) -> np.ndarray:
    h, n, i = BYTE_HASH[level][data], 1, 0
    while n < GRAM:
        h = h[: len(h) - n] * JOIN[i] + h[n:]
        n, i = n * 2, i + 1
    return mix(h)


def pieces_of(data: np.ndarray, valid: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and minimizer hashes of the pieces of ``data``; ``valid``: starts of whole windows, ascending."""
    h = _gram_hashes(data, level)
    low = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :])
    at = (low[valid] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(valid, prepend=-2) != 1))
    return valid[first], np.diff(first, append=len(valid)), h[at[first]].view(np.int64)


def _stretches(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Texts in groups of about ``STRETCH`` bytes, each with its number and offset; long ones overlap by a window less one."""
    names, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - LENGTH + 1), STRETCH):
            part = t[at : at + STRETCH + LENGTH - 1]
            names.append((i, at)), parts.append(part)
            size += len(part)
            if size >= STRETCH:
                yield names, parts
                names, parts, size = [], [], 0
    if parts:
        yield names, parts


def occurrences(docs: DataFrame, level: int = 0) -> DataFrame:
    """Every piece of every text: k, start, n (windows), mini (hash of its minimizer), piece, piece2 (of its bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for names, parts in _stretches(texts_of(b.column(1))):
                buffer = b"".join(parts)
                lengths = np.array([len(p) for p in parts])
                begin = np.cumsum(lengths) - lengths
                owner = np.repeat(np.arange(len(parts)), lengths - LENGTH + 1)
                count = lengths - LENGTH + 1
                valid = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
                start, n, mini = pieces_of(np.frombuffer(buffer, np.uint8), valid, level)
                own = owner[np.searchsorted(valid, start)]
                view, digest = memoryview(buffer), xxhash.xxh3_128_digest
                piece = np.frombuffer(b"".join([digest(view[s:e]) for s, e in zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                number, offset = np.array(names).T
                columns = [keys[number[own]], start - begin[own] + offset[own], n.astype(np.int32), mini, np.ascontiguousarray(piece[:, 0]), np.ascontiguousarray(piece[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "start", "n", "mini", *PIECE])

    return docs.where(F.octet_length("text") >= LENGTH).mapInArrow(run, "k long, start long, n int, mini long, piece long, piece2 long")


def bounded_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first 256 characters (at least ``LENGTH``), by prefix doubling; ends wrap round."""
    key = text.astype(np.uint64)
    for n in (1, 2, 4):  # characters are below 2**8 here, so eight of them fill a key
        key = (key << np.uint64(8 * n)) | np.roll(key, -n)
    n = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.cumsum(np.diff(ranked, prepend=ranked[:1]) != 0)
        if n >= LENGTH or rank[-1] == len(text) - 1:
            return order
        place = np.empty(len(text), np.uint64)
        place[order] = rank.astype(np.uint64)
        key = (place << np.uint64(32)) | np.roll(place, -n)
        n *= 2


def repeated_starts(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Positions of ``text`` whose first ``length`` characters also start elsewhere.

    Breadth-first backward extension: a boundary between neighbouring suffixes with a common prefix of v characters
    gives, for each character before the suffixes of the interval to its right, a boundary of v + 1, unless a smaller
    one is known there.  Boundaries come by increasing value, each once; at ``length`` the expansion stops, and suffixes
    without a boundary between them agree that far.
    """
    n = len(text)
    order = bounded_order(text)
    before = text[order - 1]  # the Burrows-Wheeler transform
    back = np.argsort(before, kind="stable")  # row of the suffix one character shorter
    forward = np.empty(n, np.int64)
    forward[back] = np.arange(n)
    head = before[back]
    known = np.zeros(n + 1, bool)
    known[n] = True
    new = np.flatnonzero(np.diff(head.astype(np.int16), prepend=-1))
    known[new] = True
    for _ in range(length - 1):
        if not len(new):
            break
        ends = np.flatnonzero(known)
        size = ends[np.searchsorted(ends, new, side="right")] - new
        left = np.repeat(new, size)
        rows = np.arange(size.sum()) + np.repeat(new - (np.cumsum(size) - size), size)
        to = forward[rows]
        open_ = ~known[to]
        to, left = to[open_], left[open_]
        new = np.unique(to[back[to - 1] < left])
        known[new] = True
    same = ~known
    out = np.zeros(n, bool)
    out[order] = same[:n] | same[1:]
    return out


def bucket_spans(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's distinct pieces the runs of windows that are repeated: mini, piece, piece2, first, windows.

    A piece with several places is repeated as a whole; its text takes part for the others' sake."""
    pdf = pdf.sort_values(["mini", *PIECE], kind="stable").drop_duplicates(["mini", *PIECE])
    bodies = pdf["body"].tolist()
    text = np.frombuffer(GAP.join(bodies) + GAP, np.uint8)
    flag = repeated_starts(text)
    rows, at = [], 0
    for mini, piece, piece2, n, copies, body in zip(pdf["mini"], pdf["piece"], pdf["piece2"], pdf["n"], pdf["copies"], bodies, strict=True):
        if copies > 1:
            rows.append((mini, piece, piece2, 0, n))
        else:
            edge = np.flatnonzero(np.diff(flag[at : at + n].astype(np.int8), prepend=0, append=0))
            rows += [(mini, piece, piece2, int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2], strict=True)]
        at += len(body) + 1
    return pd.DataFrame(rows, columns=["mini", *PIECE, "first", "windows"])


def cut_pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of wanted pieces (k, start, n, mini, piece, piece2, copies) with their bucket's number."""
    by_text = materialize(wanted.groupBy("k").agg(F.collect_list(F.struct("start", "n", "mini", *PIECE, "copies", "bucket")).alias("w")), "wanted")
    rows = attach(docs.select("k", "text"), by_text, "k").select("text", "w")
    names = ("bucket", "mini", *PIECE, "n", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, w in zip(texts_of(b.column(0)), b.column(1), strict=True):
                v = w.values
                start, n = v.field("start").to_pylist(), v.field("n").to_pylist()
                body = [text[s : s + k + LENGTH - 1] for s, k in zip(start, n, strict=True)]
                yield pa.RecordBatch.from_arrays([v.field(c) for c in names] + [pa.array(body, pa.binary())], names=[*names, "body"])

    return rows.mapInArrow(run, "bucket long, mini long, piece long, piece2 long, n int, copies long, body binary")


def repeated_windows(docs: DataFrame, level: int = 0) -> DataFrame:
    """Runs of repeated windows of every text: k, start, windows.  ``docs`` has k (a hash of the whole row) and text."""
    key = ("mini", *PIECE)
    every = materialize(occurrences(docs, level), "pieces")
    ends = [f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in PIECE]
    minis = every.groupBy("mini").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1")
    alike = (F.col("min_piece") == F.col("max_piece")) & (F.col("min_piece2") == F.col("max_piece2"))
    minis = materialize(minis.select("mini", alike.alias("alike")), "minis")
    some = materialize(attach(every, minis, "mini"), "shared")
    whole = some.where("alike").select("k", "start", F.col("n").alias("windows"))  # one piece throughout: whole copies of it
    other = some.where("not alike").drop("alike")
    kinds = other.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k", "start", "n")).alias("one"))
    kinds = materialize(kinds.select(*key, "copies", "one.k", "one.start", "one.n"), "kinds")
    most = HOT_PIECES if level + 1 < LEVELS else 1 << 62
    hot = materialize(kinds.groupBy("mini").count().where(F.col("count") > most).select("mini"), "hot")
    cool = attach(kinds, hot, "mini", "left_anti")
    size = cool.agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    bodies = cut_pieces(docs, materialize(cool.withColumn("bucket", F.pmod(F.xxhash64("mini"), F.lit(buckets))), "cool"))
    found = materialize(bodies.groupBy("bucket").applyInPandas(bucket_spans, "mini long, piece long, piece2 long, first int, windows int"), "found")
    if not hot.isEmpty():
        found = found.unionByName(materialize(_cut_again(docs, attach(kinds, hot, "mini", "left_semi"), level + 1), "found"))
        found = materialize(found, "found")
    spans = attach(other.select("k", "start", *key), found, key).select("k", (F.col("start") + F.col("first")).alias("start"), "windows")
    return whole.unionByName(spans)


def _cut_again(docs: DataFrame, kinds: DataFrame, level: int) -> DataFrame:
    """The same as ``bucket_spans`` for pieces of minimizers that have too many: each piece is a text of its own, cut by
    the minimizers of another hash."""
    key = ("mini", *PIECE)
    bodies = cut_pieces(docs, materialize(kinds.withColumn("bucket", F.lit(0).cast("long")), "hot_kinds"))
    texts = materialize(bodies.select(F.xxhash64(*key).alias("k"), *key, "n", "copies", F.col("body").alias("text")).dropDuplicates(["k"]), "hot_texts")
    runs = materialize(repeated_windows(texts.select("k", "text"), level), "hot_runs")
    again = runs.join(texts.where("copies = 1").select("k", *key), "k").select(*key, F.col("start").cast("int").alias("first"), F.col("windows").cast("int").alias("windows"))
    return again.unionByName(texts.where("copies > 1").select(*key, F.lit(0).alias("first"), F.col("n").alias("windows")))


def merged_spans(windows: DataFrame) -> DataFrame:
    """Maximal removed byte ranges of each text: k, starts, stops."""
    listed = windows.groupBy("k").agg(F.collect_list(F.struct("start", "windows")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, stops = [], []
            for w in b.column(1):
                v = w.values
                start = v.field("start").to_numpy()
                stop = start + v.field("windows").to_numpy() + LENGTH - 1
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(stop[order])
                new = np.concatenate([[True], start[1:] > stop[:-1]])
                starts.append(start[new]), stops.append(stop[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(stop) - 1]])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))], names=["k", "starts", "stops"])

    return listed.mapInArrow(run, "k long, starts array<long>, stops array<long>")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Texts are UTF-8 bytes, whole, however long; null is empty.  A byte goes if a 200-byte string over it also starts anywhere else, in the
    same text (overlaps count) or another one; strings never cross texts and are judged on the input.  Texts of fewer
    than 200 bytes stay whole.  Repeated rows repeat each other's strings, so they lose every byte from 200 bytes on.
    The 64-bit hash of id and text stands for a row, which needs no id.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", "text"))
    spans = materialize(merged_spans(repeated_windows(rows.select("k", "text"))), "spans")
    joined = attach(rows, spans, "k", "left")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, runs, sha, kept = [], [], [], [], []
            for text, starts, stops in zip(texts_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                cut = text
                if starts:
                    edges = [0, *(x for pair in zip(starts, stops, strict=True) for x in pair), len(text)]
                    cut = b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                n.append(len(text)), gone.append(len(text) - len(cut)), runs.append(len(starts or ())), sha.append(hashlib.sha256(cut).hexdigest()), kept.append(cut)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.select("doc_id", "text", "starts", "stops").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
