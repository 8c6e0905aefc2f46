"""Ranked lexical search by Block-Max WAND over an index of document segments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, lower_ascii, materialize

#: A term is a maximal run of these: ASCII letters and digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings in a block, bytes of text in a segment, queries that search a segment at once.
BLOCK, SEGMENT_BYTES, QUERIES_AT_ONCE = 128, 16 << 20, 256
#: Scale of the score's parts, all of them integers.
ONE, STEP = 1_000_000_000, 8

#: Bytes as terms see them: A-Z lower-cased, what no term has as a space.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in (ord(chr(c).lower()) if c < 128 else c for c in range(256)))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def lengths_factor(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The contract's m of documents of ``n`` terms: 25 plus 75 hundredths of the length against the mean, rounded down."""
    if int(n.max(initial=0)) * 75 * docs < 1 << 63:
        return 25 + 75 * n * docs // total
    return np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in seven bits a byte, the last byte of each below 128; and where each begins (one more at the end)."""
    size = 1 + sum((values >= 1 << (7 * j)).astype(np.int64) for j in range(1, 5))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for j in range(int(size.max(initial=0))):
        some = size > j
        out[at[:-1][some] + j] = (values[some] >> (7 * j) & 127) | np.where(size[some] > j + 1, 128, 0)
    return out, at


def unpack(data: np.ndarray) -> np.ndarray:
    """Inverse of ``pack``."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


class Segment:
    """Documents under way to a segment of the index."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.terms, self.counts, self.bytes = [], [], [], 0

    def add(self, doc_id, text: bytes) -> None:
        known = self.vocabulary
        words = np.array([known.setdefault(w, len(known)) for w in terms_of(text)], np.int64)
        terms, counts = np.unique(words, return_counts=True)
        self.ids.append(doc_id)
        self.terms.append(terms)
        self.counts.append(counts)
        self.bytes += len(text)

    def rows(self, seg: int, docs: int, total: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each term with its blocks, and one for the documents, numbered by their ids."""
        order = pa.compute.sort_indices(pa.array(self.ids, schema.field("ids").type.value_type), null_placement="at_end").to_numpy()
        m = lengths_factor(np.array([self.counts[d].sum() for d in order], np.int64), docs, total)
        doc = np.repeat(np.arange(len(order)), [len(self.terms[d]) for d in order])
        term = np.concatenate([self.terms[d] for d in order])
        by = np.argsort(term, kind="stable")
        term, doc, tf = term[by], doc[by], np.concatenate([self.counts[d] for d in order])[by]
        begins = np.flatnonzero(np.diff(term, prepend=-1))  # where a term's list begins
        df = np.diff(begins, append=len(term))
        inside = np.arange(len(term)) - np.repeat(begins, df)
        starts = np.flatnonzero(inside % BLOCK == 0)  # where a block begins
        size = np.diff(starts, append=len(term))
        impact = np.maximum.reduceat(ONE * tf // (1000 * tf + STEP * m[doc]), starts)
        gap = np.where(inside % BLOCK == 0, doc, np.diff(doc, prepend=0))
        base = np.repeat(2 * starts - starts, size) + np.arange(len(term))  # a block holds its gaps, then its counts
        values = np.empty(2 * len(term), np.int64)
        values[base], values[base + np.repeat(size, size)] = gap, tf
        data, at = pack(values)
        block_at = at[2 * starts]
        blocks = -(-df // BLOCK)
        of = np.concatenate([[0], np.cumsum(blocks)])
        blob_at = np.append(block_at, len(data))[of]
        names = sorted(self.vocabulary, key=self.vocabulary.get)
        blob = pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(blob_at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        lists = {
            "seg": pa.array(np.full(len(df), seg), pa.int64()), "term": pa.array(names, pa.binary()).cast(pa.string()), "df": pa.array(df, pa.int32()),
            "last": _lists(doc[starts + size - 1], of), "top": _lists(impact, of), "at": _lists(block_at - np.repeat(blob_at[:-1], blocks), of), "blob": blob,
            "ids": pa.nulls(len(df), schema.field("ids").type), "m": pa.nulls(len(df), pa.list_(pa.int64())),
        }
        own = {"seg": [seg], "ids": [[self.ids[d] for d in order]], "m": [m.tolist()]}
        head = {n: pa.array(own[n], schema.field(n).type) if n in own else pa.nulls(1, schema.field(n).type) for n in schema.names}
        both = [pa.concat_arrays([head[n].cast(schema.field(n).type), lists[n].cast(schema.field(n).type)]) for n in schema.names]
        return pa.RecordBatch.from_arrays(both, schema=schema)


@dataclass
class Index:
    """A written table of segments, and what the whole corpus has: documents with terms, and terms with repeats."""

    table: DataFrame
    docs: int
    total: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index whole texts, in segments of some 16 MB that one task builds; no posting is shuffled.

    A segment has a row for each of its terms: postings in blocks of 128, each block compressed by itself, and for each
    block its last document, its place and the highest impact in it (a score's part before the term's weight).  Null and
    termless texts aren't in the index.  Rows that repeat an id are documents of their own.
    """
    from pyspark import TaskContext

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n = F.regexp_count("text", F.lit(TERM))
    facts = rows.agg(F.count_if(n > 0).alias("docs"), F.coalesce(F.sum(n), F.lit(0)).alias("total")).first()
    kind = rows.schema["id"].dataType
    schema = T.StructType.fromDDL(f"seg long, term string, df int, last array<int>, top array<int>, at array<int>, blob binary, ids array<{kind.simpleString()}>, m array<long>")
    count, total, most = facts.docs, facts.total, SEGMENT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, seg = to_arrow_schema(schema), Segment(), TaskContext.get().partitionId() << 32
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                if text.is_valid and terms_of(text.as_py()):
                    held.add(doc_id, text.as_py())
                if held.bytes >= most:
                    yield held.rows(seg, count, total, arrow)
                    held, seg = Segment(), seg + 1
        if held.ids:
            yield held.rows(seg, count, total, arrow)

    return Index(materialize(rows.mapInArrow(run, schema), "index"), count, total)


class Lists:
    """The posting lists of one segment for the terms of some queries; blocks are decompressed once, when first needed."""

    def __init__(self, rows: list[dict], m: np.ndarray):
        self.m, self.rows, self.open = m, rows, {}
        for r in rows:
            r["last"], r["top"], r["data"] = np.array(r["last"]), np.array(r["top"], np.int64), np.frombuffer(r["blob"], np.uint8)

    def block(self, t: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block ``b`` of term ``t``."""
        if (t, b) not in self.open:
            r = self.rows[t]
            values = unpack(r["data"][r["at"][b] : r["at"][b + 1] if b + 1 < len(r["at"]) else None])
            docs, tf = np.cumsum(values[: len(values) // 2]), values[len(values) // 2 :]
            self.open[t, b] = docs, ONE * tf // (1000 * tf + STEP * self.m[docs])
        return self.open[t, b]

    def best(self, weights: dict[int, int], k: int) -> list[tuple[int, int]]:
        """The ``k`` best (document, score) of a query's terms; of equal scores the lower documents.

        The ends of the terms' blocks cut the segment into windows; in a window each term has one block, so the weighted
        block maxima bound every score there (shallow moves read no posting).  Windows are opened from the highest bound
        down, a few at first, and none whose bound is below the k-th score so far.
        """
        if not weights:
            return []
        ends = np.unique(np.concatenate([self.rows[t]["last"] for t in weights]))
        place = {t: np.searchsorted(self.rows[t]["last"], ends) for t in weights}
        bound = np.zeros(len(ends), np.int64)
        for t, w in weights.items():
            bound += w * np.append(self.rows[t]["top"], 0)[place[t]]
        order = np.argsort(-bound, kind="stable")
        starts = np.concatenate([[0], ends[:-1] + 1])
        score, least, found, taken, step = np.zeros(ends[-1] + 1, np.int64), 1, np.empty(0, np.int64), 0, 8
        while taken < len(order):
            some = order[taken : taken + step]
            some = some[bound[some] >= least]
            if not len(some):
                break
            taken, step = taken + step, 2 * step
            chosen = np.zeros(len(score) + 1, np.int8)
            chosen[starts[some]] += 1
            chosen[ends[some] + 1] -= 1
            chosen = np.cumsum(chosen[:-1]) > 0
            parts = [(self.block(t, b), w) for t, w in weights.items() for b in np.unique(place[t][some]) if b < len(self.rows[t]["last"])]
            docs, gain = np.concatenate([d for (d, _), _ in parts]), np.concatenate([w * v for (_, v), w in parts])
            now = chosen[docs]
            np.add.at(score, docs[now], gain[now])
            found = np.concatenate([found, np.flatnonzero(chosen & (score >= least))])
            found = found[np.lexsort((found, -score[found]))[:k]]
            least = max(1, score[found[-1]]) if len(found) == k else 1
        return [(int(d), int(score[d])) for d in found]


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per query its ``k`` best documents with a score above 0, fewer if there are fewer: item_id, rank, doc_id, score.

    Scores count repeats of a query's terms and are exact; of equal scores the smaller id comes first, ids that are null
    last.  Rows that repeat an item's id are one query with the terms of all; null, empty and unknown texts find nothing,
    and nothing is found in an empty index.  Queries of any number go to the segments in blocks of some 256; a segment
    gets only the lists of terms that a block's queries have.
    """
    words = F.regexp_extract_all(lower_ascii(F.col(text_col).cast("string")), F.lit(f"({TERM})"), F.lit(1))
    asked = items.select(F.col(id_col).alias("item_id"), F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = materialize(asked, "asked")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // QUERIES_AT_ONCE))
    named = index.table.where("term is not null")
    df = attach(named.select("term", "df"), materialize(asked.select("term").distinct(), "terms"), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    using = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).groupBy("block", "term").agg(F.collect_list(F.struct("item_id", "times")).alias("users"))
    using = materialize(using.join(df.select("term", weight.alias("weight")), "term"), "using")
    lists = attach(named.drop("ids", "m", "df"), using, "term").drop("term")
    owners = index.table.where("term is null").select("seg", "ids", "m", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    both = lists.unionByName(owners, allowMissingColumns=True)
    item, doc = asked.schema["item_id"].dataType, index.table.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item_id", item), T.StructField("doc_id", doc), T.StructField("score", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = table.to_pylist()
        owner = next(r for r in rows if r["ids"] is not None)
        rows = [r for r in rows if r["ids"] is None]
        lists, queries = Lists(rows, np.array(owner["m"], np.int64)), {}
        for t, r in enumerate(rows):
            for u in r["users"]:
                queries.setdefault(u["item_id"], {})[t] = r["weight"] * u["times"]
        found = [(i, owner["ids"][d], s) for i, weights in queries.items() for d, s in lists.best(weights, k)]
        return pa.Table.from_arrays([pa.array([f[j] for f in found], x.type) for j, x in enumerate(to_arrow_schema(schema))], schema=to_arrow_schema(schema))

    best = both.groupBy("seg", "block").applyInArrow(run, schema)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
