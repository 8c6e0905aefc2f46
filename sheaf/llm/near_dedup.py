"""MinHash near-deduplication: banding, signature verification, confirmation on full sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize, row_key
from .components import components
from .tokens import STEP, WordHashes, mix, shingle_set, texts_of

HASHES = 256
#: Rows that are compared with one pivot in one task.
PER_TASK = 500
#: Rows of a bucket, and outsiders of it, that one task compares with each other.
PER_PART, OUTSIDERS = 2000, 1000
#: Bands of the first round, in which every set meets one pivot.
FIRST_BANDS = 8
CHUNK = 1024
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class Search:
    """Bands, rows a band and least agreeing places of signatures for pairs of ``percent`` similarity or more.

    Bands have as many rows as let a pair just at the threshold share none at most once in 10,000 times; the signature
    cut loses such a pair 100 times more rarely than banding does.  85: 32 bands of 8; 80: 42 bands of 6.
    """

    def __init__(self, percent: int):
        s = percent / 100
        self.percent = percent
        self.rows = max(r for r in range(1, 17) if r == 1 or (1 - s**r) ** (HASHES // r) <= 1e-4)
        self.bands = HASHES // self.rows
        self.missed = (1 - s**self.rows) ** self.bands
        self.least, self.cut = 0, 0.0
        while (lost := self.cut + comb(HASHES, self.least) * s**self.least * (1 - s) ** (HASHES - self.least)) <= self.missed / 100:
            self.least, self.cut = self.least + 1, lost


def minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each universal hash a * x + b (mod 2**64) over the set."""
    out = np.full(HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), CHUNK):
        v = np.multiply.outer(shingles[i : i + CHUNK], FACTORS)
        v += OFFSETS
        np.minimum(out, v.min(axis=0), out=out)
    return out


def bands_of(least: np.ndarray, search: Search) -> np.ndarray:
    h = np.arange(search.bands, dtype=np.uint64) * STEP
    of = least[: search.bands * search.rows].reshape(search.bands, search.rows)
    for i in range(search.rows):
        h = mix(h * STEP + of[:, i])
    return h.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, search: Search) -> DataFrame:
    """k1, k2 (the row's key), doc_id, n (set size), set_key (128 bits of the set), sig (a byte of each minimum), bands; for an empty set the last three are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            n, keys, sigs, bands = [], [], [], []
            for t in texts_of(b.column(3)):
                s = shingle_set(t, known)
                n.append(len(s))
                if len(s):
                    least = minima(s)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append((mix(least) >> np.uint64(56)).astype(np.uint8).tobytes())
                    bands.append(bands_of(least, search))
                else:
                    keys.append(None), sigs.append(None), bands.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["k1", "k2", "doc_id", "n", "set_key", "sig", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(*row_key(docs), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"k1 long, k2 long, doc_id {kind}, n long, set_key binary, sig binary, bands array<long>")


def _agreement(pairs: DataFrame, reps: DataFrame, search: Search) -> DataFrame:
    """Signature verification of given pairs: those (a, b) that agree in ``search.least`` places or more."""
    sig = reps.select("node", "sig", "n")
    both = pairs.join(sig.toDF("a", "sa", "na"), "a").join(sig.toDF("b", "sb", "nb"), "b")
    both = both.where(100 * F.least("na", "nb") >= search.percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            one, other = (_matrix(x.column(i)) for i in (2, 3))
            yield x.select([0, 1]).filter(pa.array((one == other).sum(1) >= search.least))

    return both.mapInArrow(run, "a long, b long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def sets_of(texts: DataFrame, nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """node and set (its sorted shingle hashes) of ``nodes``."""
    needed = materialize(nodes.join(reps.select("node", "k1", "k2"), "node"), "needed")
    rows = attach(texts, needed, ("k1", "k2")).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, known).tobytes() for t in texts_of(b.column(1))], pa.binary())], names=["node", "set"])

    return rows.mapInArrow(run, "node long, set binary")


def linked_inside(rows: DataFrame, search: Search) -> DataFrame:
    """Links (a, b) between different components inside buckets, one for each outsider, component and task.

    ``rows`` has band, band_no, node, component, main (the component that holds most of the bucket), parts, outside_parts,
    n, sig, bands and set.  Outsiders, the rows of other components than the main one, meet all rows of their bucket, in
    blocks of about ``OUTSIDERS`` by ``PER_PART``.  Pairs whose signatures agree are confirmed on their full sets right
    there, in the first band they share, and of an outsider's links to a component one is enough: so what leaves a task
    is links only, and no pair that merely looks alike.
    """
    rows = rows.withColumn("outside", F.col("component") != F.col("main"))
    split = lambda of, other: {of: F.pmod(F.xxhash64("node", F.lit(of)), F.col(f"{of}s")), other: F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))}
    columns = ("band", "part", "outside_part", "role", "node", "component", "outside", "n", "band_no", "sig", "bands", "set")
    held = rows.where("outside").withColumn("role", F.lit(0)).withColumns(split("outside_part", "part"))
    passing = rows.withColumn("role", F.lit(1)).withColumns(split("part", "outside_part"))
    dealt = held.select(*columns).union(passing.select(*columns)).repartition("band", "part", "outside_part").sortWithinPartitions("band", "part", "outside_part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done = None, [], set()
        for x in batches:
            group = np.stack([x.column(k).to_numpy() for k in range(3)])
            edges = [0, *(np.flatnonzero((np.diff(group) != 0).any(0)) + 1).tolist(), x.num_rows]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                if (here := tuple(group[:, s])) != at:
                    at, held, done = here, [], set()
                some = x.slice(s, e - s)
                split = int((some.column(3).to_numpy() == 0).sum())
                if split:
                    held.append(_Rows(some.slice(0, split)))
                if split < e - s:
                    rows = _Rows(some.slice(split))
                    found = [link for block in held for link in _links(rows, block, search, done)]
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


class _Rows:
    """Columns of one bucket's rows."""

    def __init__(self, x: pa.RecordBatch):
        self.node, self.component, self.outside, self.n = (x.column(k).to_numpy(zero_copy_only=False) for k in range(4, 8))
        self.band_no, self.sig = x.column(8)[0].as_py(), _matrix(x.column(9))
        self.bands = np.array(x.column(10).to_pylist(), np.int64)
        self.sets = x.column(11)

    def set(self, k: int) -> np.ndarray:
        return np.frombuffer(self.sets[k].as_py(), np.uint64)


def _links(rows: _Rows, held: _Rows, search: Search, done: set) -> Iterator[tuple[int, int]]:
    for k, (i, c, m) in enumerate(zip(held.node.tolist(), held.component.tolist(), held.n.tolist(), strict=True)):
        near = np.flatnonzero((rows.component != c) & (100 * np.minimum(rows.n, m) >= search.percent * np.maximum(rows.n, m)) & ~(rows.outside & (rows.node < i)))
        near = near[(rows.sig[near] == held.sig[k]).sum(1) >= search.least]
        if not len(near):
            continue
        near = near[(rows.bands[near] == held.bands[k]).argmax(1) == rows.band_no]
        mine = held.set(k)
        for j in near.tolist():
            if (i, other := int(rows.component[j])) in done:
                continue
            theirs = rows.set(j)
            same = len(np.intersect1d(mine, theirs, assume_unique=True))
            if 100 * same >= search.percent * (len(mine) + len(theirs) - same):
                done.add((i, other))
                yield int(rows.node[j]), i


def confirmed(pairs: DataFrame, texts: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Rows stream past their pivot b: a task holds one set at a time, and a pivot with many rows has several tasks.
    """
    count = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).alias("parts")), "parts")
    salted = materialize(pairs.join(count, "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("salt")), "salted")
    members = salted.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "salt", F.lit(1).alias("role"))
    pivots = salted.select(F.col("b").alias("node"), F.col("b").alias("pivot"), "salt", F.lit(0).alias("role")).distinct()
    needed = materialize(members.union(pivots).join(reps.select("node", "k1", "k2"), "node"), "needed")
    held = attach(texts, needed, ("k1", "k2")).select("pivot", "salt", "role", "node", "text")
    dealt = held.repartition(F.col("pivot"), F.col("salt")).sortWithinPartitions("pivot", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, pivot = WordHashes(), None, None
        for x in batches:
            a, b = [], []
            for p, salt, role, i, t in zip(*(x.column(k).to_pylist() for k in range(4)), texts_of(x.column(4)), strict=True):
                s = shingle_set(t, known)
                if (p, salt) != at or role == 0:
                    at, pivot = (p, salt), s
                    continue
                same = len(np.intersect1d(pivot, s, assume_unique=True))
                if 100 * same >= percent * (len(pivot) + len(s) - same):
                    a.append(i), b.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pivots(reps: DataFrame, search: Search) -> DataFrame:
    """First round: of each bucket of the first bands the set whose buckets hold most is the pivot, and each set meets the
    pivot that most of its buckets share, so it is in one pair at most.  The text that others are near copies of is in
    all their large buckets, so this links most of a large group."""
    entries = reps.select("node", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("band"))
    sizes = materialize(entries.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = materialize(entries.join(sizes, "band"), "bucket_rows")
    weight = materialize(shared.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    pivot = shared.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("top"))
    pivot = materialize(pivot.select("band", F.col("top.node").alias("pivot")), "pivots")
    met = shared.join(pivot, "band").where("node <> pivot").groupBy("node", "pivot").count()
    one = met.groupBy("node").agg(F.max(F.struct("count", "pivot")).alias("top")).select(F.col("node").alias("a"), F.col("top.pivot").alias("b"))
    return _agreement(materialize(one, "met"), reps, search)


def _rest(texts: DataFrame, reps: DataFrame, labels: DataFrame | None, search: Search) -> DataFrame | None:
    """Second round: in every bucket that still holds several components, the links between them."""
    nodes = reps.select("node", F.posexplode("bands").alias("band_no", "band"))
    if labels is None:
        entries = nodes.withColumn("component", F.col("node"))
    else:
        entries = attach(nodes, labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = entries.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    rows = materialize(entries.join(materialize(open_, "open"), "band"), "bucket_rows")
    if rows.isEmpty():
        return None
    sizes = rows.groupBy("band", "component").count().groupBy("band").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("size"))
    parts = {"main": F.col("top.component"), "parts": F.ceil(F.col("size") / PER_PART), "outside_parts": F.ceil((F.col("size") - F.col("top.count")) / OUTSIDERS)}
    sizes = materialize(sizes.select("band", *(c.alias(k) for k, c in parts.items())), "sizes")
    sets = materialize(sets_of(texts, rows.select("node").distinct(), reps), "sets")
    of = reps.select("node", "n", "sig", "bands").join(sets, "node")
    return linked_inside(rows.join(sizes, "band").join(materialize(of, "rows"), "node"), search)


def link(texts: DataFrame, reps: DataFrame, search: Search) -> DataFrame | None:
    """Component of every set that is linked (node, component); its closure is that of all links inside buckets.

    A first round of a pair a set at most gathers what is alike; then every pair of a bucket that is still in different
    components is verified.  So what is sent on follows the number of sets, not the square of a group's size, and no
    link inside a bucket is missed.
    """
    links = materialize(confirmed(materialize(_pivots(reps, search), "pairs"), texts, reps, search.percent), "links")
    labels = None if links.isEmpty() else materialize(components(links.toDF("u", "v")).toDF("node", "component"), "labels")
    more = _rest(texts, reps, labels, search)
    more = None if more is None else materialize(more, "links")
    if more is None or more.isEmpty():
        return labels
    return materialize(components(links.union(more).toDF("u", "v")).toDF("node", "component"), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, and the row's key k1, k2.

    A document's set holds its distinct 5-word shingles (A-Z lower-cased, ASCII blanks split words) of the whole text,
    however long; shorter texts are one shingle, null and wordless texts are empty and linked with nothing.  Documents
    are linked when 100 * intersection >= percent * union, ties included.  component_id is the smallest id reachable,
    null if no row of the component has an id.  kept marks the first row of each component by id (rows without one come
    last) and then by key; rows equal in every column share its answer.  Ids may be of any type that sorts.  Equal sets
    meet in an aggregation and one row of each takes part in the search.  An empty table gives no rows.
    """
    search = Search(percent)
    table = materialize(signatures(docs, id_col, text_col, search), "signatures")
    known = table.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2"))
    sets = materialize(known.groupBy("set_key").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")), "sets")
    rep = sets.select("set_key", "first.k1", "first.k2")
    reps = known.join(rep, ["set_key", "k1", "k2"], "left_semi").dropDuplicates(["set_key"])
    reps = materialize(reps.select("set_key", "k1", "k2", "n", "sig", "bands", F.monotonically_increasing_id().alias("node")), "reps")
    texts = docs.select(*row_key(docs), F.col(text_col).cast("string").alias("text"))
    labels = link(texts, reps, search)
    found = sets.where("copies > 1")
    if labels is not None:
        linked = materialize(attach(reps.select("set_key", "node"), labels, "node").join(sets, "set_key").select("set_key", "component", "first"), "linked")
        least = materialize(linked.groupBy("component").agg(F.min("first").alias("first")), "least")
        linked = attach(linked.select("set_key", "component"), least, "component").select("set_key", "first")
        found = linked.unionByName(found.join(linked.select("set_key"), "set_key", "left_anti").select("set_key", "first"))
    found = materialize(found.select("set_key", F.col("first.doc_id").alias("component_id"), F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2")), "found")
    out = attach(table.select("doc_id", F.col("n").alias("n_shingles"), "set_key", "k1", "k2"), found, "set_key", "left")
    kept = F.col("f1").isNull() | ((F.col("f1") == F.col("k1")) & (F.col("f2") == F.col("k2")))
    return out.select("doc_id", "n_shingles", F.when(F.col("f1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept"), "k1", "k2")


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all others keep every column.

    Decisions belong to rows: of rows that repeat an id only those whose text is a copy go, rows without an id take
    part, and of rows equal in every column one stays.  Null and wordless texts are no copies of anything and stay, as
    often as they are there.  Texts count whole, however long; a pair just at ``percent`` is a copy; of a group the
    smallest id stays.  An empty table gives no rows.
    """
    judged = near_duplicates(docs, percent=percent)
    facts = judged.where("n_shingles > 0").groupBy("k1", "k2").agg(F.first("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")).where("not _kept or _rows > 1")
    facts = materialize(facts, "dropped")
    keyed = docs.select(F.struct("*").alias("row"), *row_key(docs))
    joined = attach(keyed, facts, ("k1", "k2"), "left").where("_kept is null or _kept")
    again = joined.where("_kept").dropDuplicates(["k1", "k2"])  # repeats of a row that stays: only these shuffle
    return joined.where("_kept is null").unionByName(again).select("row.*")
