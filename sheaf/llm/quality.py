"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, materialize, quoted

THRESHOLD = 0.3
#: Labelled rows that the model is fitted on, taken in the order of a hash of their id; the driver holds their features only.
MAX_LABELLED = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 48, 12, 120, 60, 8, 0.12

_CLASS = np.zeros((256, 7))
for _i, _chars in enumerate((bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\v\f\r", b".,;:!?'\"()-", bytes(range(128, 256)))):
    _CLASS[list(_chars), _i] = 1
_CLASS[_CLASS.sum(1) == 0, 6] = 1
FEATURES = (
    "lower", "upper", "digit", "blank", "punctuation", "high", "symbol", "log_words", "word_length", "distinct_words", "top_word", "same_as_last",
    "short_words", "distinct_lines", "top_line", "line_length", "stops", "commas", "capitals", "distinct_starts",
)


def features(text: bytes) -> list[float]:
    """What the model sees of a text; an empty one has zeros throughout."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen, rows = Counter(words), Counter(lines)
    length = np.fromiter(map(len, words), np.int32, n)
    starts = {w[:2] for w in seen}
    return [
        *(chars @ _CLASS / len(text)), np.log1p(n), length.mean(), len(seen) / n, max(seen.values()) / n, sum(map(eq, words, words[1:])) / n,
        (length <= 3).mean(), len(rows) / len(lines), max(rows.values()) / len(lines), np.log1p(len(text) / len(lines)), chars[46] / n, chars[44] / n, sum(w[:1].isupper() for w in words) / n, len(starts) / len(seen),
    ]


@dataclass
class Model:
    """Lookup tables over bins: one for each feature and one for each chosen pair."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, k], side="right")]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Gain and place of the best split of bins low..high-1."""
    if high - low < 2:
        return 0.0, -1
    gl, hl = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    gt, ht = g[low:high].sum(), h[low:high].sum()
    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
    k = int(gain.argmax())
    return float(gain[k]), low + k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Steps of a tree over one feature's bins, as a table."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, k = max((*_cut(g, h, *p), k) for k, p in enumerate(parts))
        if at < 0 or gain <= 1e-6:
            break
        low, high = parts.pop(k)
        parts += [(low, at), (at, high)]
    out = np.zeros(len(g))
    for low, high in parts:
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that splits on one feature and then each side on the other, as a two-way table, and its gain."""
    best, out = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        gain, at = _cut(a.sum(1), b.sum(1), 0, len(a))
        sides = [(0, at), (at, len(a))] if at > 0 else [(0, len(a))]
        table = np.zeros_like(a)
        for low, high in sides:
            more, cut = _cut(a[low:high].sum(0), b[low:high].sum(0), 0, a.shape[1])
            gain += more
            for left, right in [(0, cut), (cut, a.shape[1])] if cut > 0 else [(0, a.shape[1])]:
                table[low:high, left:right] = a[low:high, left:right].sum() / (b[low:high, left:right].sum() + 1)
        if gain > best:
            best, out = gain, table.T if turn else table
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Rounds over all features in turn, then over the pairs that the residual speaks for most."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(base=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges, model.pair_edges = [_edges(c, BINS) for c in x.T], [_edges(c, PAIR_BINS) for c in x.T]
    at = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for k, b in enumerate(at):
            p = 1 / (1 + np.exp(-z))
            step = RATE * shallow_tree(np.bincount(b, y - p, len(model.tables[k])), np.bincount(b, p * (1 - p), len(model.tables[k])))
            model.tables[k] += step
            z += step[b]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    width = [len(e) + 1 for e in model.pair_edges]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, cell = 1 / (1 + np.exp(-z)), coarse[i] * width[j] + coarse[j]
        return tuple(np.bincount(cell, w, width[i] * width[j]).reshape(width[i], width[j]) for w in (y - p, p * (1 - p)))

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -pair_tree(*grids(*ij))[1])[:PAIRS]
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * pair_tree(*grids(i, j))[0]
            table += step
            z += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Fit on at most ``most`` labelled rows whose crc32(doc_id) mod 5 is not 0; rows without a label or a text's id don't count."""
    known = labels.where("quality in (0, 1) and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = attach(docs.select("doc_id", "text"), materialize(known, "labels"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t or b"") for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    held = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x array<double>").limit(most).collect()
    held.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([r.x for r in held], np.float64).reshape(len(held), len(FEATURES))
    return fit(x, np.array([r.quality for r in held], np.float64))


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns, whatever their names), score and predicted.  Null and empty texts are scored as texts without words."""
    rows = docs.select(F.struct(*map(quoted, keep)).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or b"") for t in b.column(1).cast(pa.large_binary()).to_pylist()], np.float64).reshape(b.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["row", "score", "predicted"])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0; held_out marks the others.  Of labels of one
    id that differ the larger counts, and rows that repeat an id are all learnt from.  Texts are scored whole, however
    long, null and wordless ones as texts without words; equal texts get equal scores; a score of just 0.3 is predicted 1.
    Without labels of both kinds every score is the smoothed share of label 1.  Null ids are never held out; an empty
    table gives no rows.
    """
    scored = score_documents(docs, train(docs, labels)).select("row.doc_id", "score", "predicted")
    return scored.select("doc_id", F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model rejects, each judged by its own text; other columns stay as they are.

    Null, empty and wordless texts are scored as texts without words, long ones whole; repeated rows and ids each count, and
    equal texts share their fate.  A score of just 0.3 stays.  An empty table gives no rows; columns may have any name.
    """
    scored = score_documents(docs, train(docs, labels), tuple(docs.columns))
    return scored.where("predicted = 1").select("row.*")
