"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, lower_ascii, materialize, quoted
from .ranked_search import TERM, terms_of

THRESHOLD = 0.3
#: Labelled rows that the model learns from, in the order of a hash of their id, and units of its lexicon, the surest first.
MAX_LABELLED, MAX_UNITS = 20_000, 100_000
#: Proper beginnings of a word, in characters, that count as units beside the word itself.
STEMS = range(3, 9)
#: Words or units that a task remembers.
AT_ONCE = 100_000
#: A unit's log-odds count as far as they are sure by so many standard errors, from so much on; a segment is significant
#: below this many by chance.
SURE, WORTH, BY_CHANCE = 3.0, 1.0, 0.05
#: A word without evidence takes off at least so much, and so many times what a clean word gains on average: chance loses.
DRIFT, AGAINST = 0.2, 3.0

Segment = tuple[int, int, float]


def units_of(word: str) -> list[str]:
    """The word and its proper beginnings, the latter marked."""
    return [word, *(word[:k] + "\t" for k in STEMS if k < len(word))]


def segments(s: np.ndarray) -> list[Segment]:
    """All maximal scoring segments (first, past last, score) of a sequence of token scores, in linear time.

    Only positive tokens open or lengthen a segment.  A stack holds candidates, each with the running sums before and at
    its end and a link to the last one before it whose sum before is smaller; a new candidate swallows what lies between
    it and that one where the whole scores more.
    """
    total = np.cumsum(s)
    stack: list[tuple[int, int, float, float, int]] = []
    for k in np.flatnonzero(s > 0).tolist():
        first, low, high = k, float(total[k] - s[k]), float(total[k])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, k + 1, low, high, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


@dataclass
class Model:
    """Scores of units, and how high segments score by chance: expected number K * n * exp(-lam * score) in n words."""

    units: dict[str, float] = field(default_factory=dict)
    drift: float = -DRIFT
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    base: float = 0.0

    def word_score(self, word: bytes) -> float:
        own = [self.units[u] for u in units_of(word.decode()) if u in self.units]
        return max(own) if own else self.drift

    def by_chance(self, score: float, n: int) -> float:
        return self.k * n * exp(-min(self.lam * score, 700.0))

    def evidence(self, found: list[Segment], n: int) -> float:
        """Minus log of the chance of the significant segments together (sum statistics of r normalised scores)."""
        sums = sorted((-log(self.by_chance(s, n)) for _, _, s in found if self.by_chance(s, n) <= BY_CHANCE), reverse=True)
        t, best = 0.0, 0.0
        for r, x in enumerate(sums, 1):
            t += x
            best = max(best, t - (r - 1) * log(t) + lgamma(r + 1) + lgamma(r))
        return best

    def probability(self, evidence: float) -> float:
        z = self.base + self.slope * float(np.log1p(evidence))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


class Scores(dict):
    """Scores of words as they are met; forgets all when it has grown large."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > AT_ONCE:
            self.clear()
        s = self[word] = self.model.word_score(word)
        return s


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Distinct texts of labelled rows to learn from, as a written table: text, toxic, fold (0 and 1 for counts, 2 for calibration)."""
    known = labels.where("toxic in (0, 1) and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = attach(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), materialize(known, "labels"), "doc_id")
    once = rows.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"))
    return materialize(once.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(3)).cast("int")), "sample")


def prior(docs: DataFrame) -> DataFrame:
    """How often each unit occurs in the corpus, once for each distinct word of a text: unit, n."""
    words = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("text").cast("string")), F.lit(f"({TERM})"), F.lit(1)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    stems = F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[-1])), lambda k: F.when(k < F.char_length("word"), F.concat(F.substring("word", F.lit(1), k), F.lit("\t"))))
    return counts.select("n", F.explode(F.array_compact(F.concat(F.array("word"), stems))).alias("unit")).groupBy("unit").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, learnt: DataFrame) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Units that tell toxic texts from others with their sure log-odds, and the shares of clean words that have each score.

    The log-odds of a unit compare the classes under a Dirichlet prior in proportion to the whole corpus, as strong as the
    smaller class; a text counts a unit once for each of its distinct words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def sent() -> pa.RecordBatch:
            both = list(seen[0] | seen[1])
            counts = [pa.array([c[u] for u in both], pa.int64()) for c in seen]
            return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *counts], names=["unit", "clean", "toxic"])

        for b in batches:
            for text, toxic in zip(b.column("text").cast(pa.large_binary()), b.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(u for w in set(terms_of(text.as_py())) for u in units_of(w.decode()))
                if len(seen[0]) + len(seen[1]) > AT_ONCE:
                    yield sent()
                    seen = (Counter(), Counter())
        yield sent()

    counted = learnt.where("fold < 2").select("text", "toxic").mapInArrow(run, "unit string, clean long, toxic long")
    counted = counted.groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = materialize(counted, "units")
    all_ = counted.where(~F.col("unit").endswith("\t")).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    if not all_.clean or not all_.toxic:
        return {}, np.zeros(0), np.zeros(0)
    units = materialize(prior(docs), "prior")
    total = units.where(~F.col("unit").endswith("\t")).agg(F.sum("n")).first()[0]
    strength = float(min(all_.clean, all_.toxic))
    a = F.lit(strength) * F.col("n") / F.lit(float(total))
    share = lambda c, n: F.log((F.col(c) + a) / (F.lit(n + strength) - F.col(c) - a))
    sure = counted.join(units, "unit").withColumn("d", share("toxic", all_.toxic) - share("clean", all_.clean))
    sure = sure.withColumn("sd", F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))).withColumn("score", F.col("d") - SURE * F.col("sd"))
    sure = sure.where(F.col("score") >= WORTH).select("unit", "score", ((F.col("clean") + a) / F.lit(all_.clean + strength)).alias("p")).orderBy(F.desc("score"), "unit").limit(MAX_UNITS).collect()
    return {r.unit: r.score for r in sure}, np.array([r.score for r in sure]), np.array([r.p for r in sure])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Lexicon from two thirds of the sample; what chance gives, and the final score, from the rest."""
    learnt = sample(docs, labels, most)
    shares = learnt.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    rate = (shares.toxic + 1) / (shares.n + 2)
    model = Model(base=log(rate / (1 - rate)))
    model.units, s, p = lexicon(docs, learnt)
    if not model.units:
        return model
    model.drift = -max(DRIFT, AGAINST * float((p * s).sum()))
    low, high = 1e-6, 1.0  # lam solves: mean of exp(lam * score) over clean words is 1
    mean = lambda x: float((p * np.exp(x * s)).sum() + max(0.0, 1 - p.sum()) * np.exp(x * model.drift))
    while mean(high) < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    model.lam = low
    seen = passages(learnt.where("fold = 2"), model, ("toxic",)).select("row.toxic", "n", F.transform("passages", lambda x: x["score"]).alias("s")).collect()
    clean = [(r.n, max(r.s, default=0.0)) for r in seen if not r.toxic and r.n]
    model.k = (len(clean) + 1) / (sum(n * exp(-model.lam * x) for n, x in clean) + 1)
    x = np.array([np.log1p(model.evidence([(0, 0, v) for v in r.s], r.n)) for r in seen])
    model.base, model.slope = logistic(x, np.array([r.toxic for r in seen], np.float64), model.base)
    return model


def logistic(x: np.ndarray, y: np.ndarray, base: float) -> tuple[float, float]:
    """Base and slope (not below 0) of a logistic curve, by short Newton steps, with a small penalty on both."""
    w = np.array([base, 0.0])
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        h = q * (1 - q)
        slope = np.array([(y - q).sum() - 0.05 * (w[0] - base), ((y - q) * x).sum() - 0.05 * w[1]])
        curve = np.array([[h.sum() + 0.05, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 0.05]])
        w = w + np.clip(np.linalg.solve(curve, slope), -0.5, 0.5)
    return float(w[0]), float(max(0.0, w[1]))


PASSAGE = "struct<first:int,past:int,score:double,by_chance:double>"


def passages(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), n (words), passages (every maximal scoring segment: words first to past,
    its score and how many as high chance would give), score, predicted.

    Texts are scanned whole, once; null, empty and wordless ones have no passages.  Equal texts get equal results.
    """
    rows = docs.select(F.struct(*map(quoted, keep)).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(f"n long, passages array<{PASSAGE}>, score double, predicted int")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        model, arrow = shared.value, to_arrow_schema(schema)
        known = Scores(model)
        for b in batches:
            out = []
            for text in b.column(1).cast(pa.large_binary()):
                words = terms_of(text.as_py() or b"")
                found = segments(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
                n = len(words)
                score = model.probability(model.evidence(found, n))
                named = [{"first": a, "past": z, "score": s, "by_chance": model.by_chance(s, n)} for a, z, s in found]
                out.append((n, named, score, int(score >= THRESHOLD)))
            columns = [pa.array([o[k] for o in out], arrow.field(k + 1).type) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=arrow.names)

    return rows.mapInArrow(run, schema)


def toxic_passages(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each significant passage: ``row``, first, past, score, by_chance and its words as ``text``."""
    words = F.regexp_extract_all(lower_ascii(F.col("text").cast("string")), F.lit(f"({TERM})"), F.lit(1))
    found = passages(docs.withColumn("_words", words), model, (*keep, "_words"))
    rows = found.select(F.struct(*(F.col(f"row.{quoted(c)}") for c in keep)).alias("row"), F.col("row._words").alias("words"), F.inline("passages"))
    return rows.where(F.col("by_chance") <= BY_CHANCE).select("row", "first", "past", "score", "by_chance", F.array_join(F.slice("words", F.col("first") + 1, F.col("past") - F.col("first")), " ").alias("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, n_passages (significant ones).

    Labels are learnt from rows whose crc32(doc_id as text) mod 4 is not 2; held_out marks those where it is.  Of labels of
    one id, or of one text, that differ the larger counts.  Texts are scanned whole, however long; null, empty and wordless
    ones have the score of no evidence; equal texts get equal scores; a score of just 0.3 is predicted 1.  Without labels of
    both kinds every score is the smoothed share of label 1.  Null ids are never held out; an empty table gives no rows.
    """
    found = passages(docs, fit(docs, labels))
    held = F.coalesce(F.expr("crc32(cast(cast(row.doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    many = F.size(F.filter("passages", lambda x: x["by_chance"] <= BY_CHANCE)).cast("long")
    return found.select("row.doc_id", held.alias("held_out"), "score", "predicted", many.alias("n_passages"))
