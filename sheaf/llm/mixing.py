"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize, row_key

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents of one leaf task's group, and groups that meet in one node of the reduction tree.
LEAF_ROWS, FAN_IN = 2_000, 64
#: Sources are a dimension, not data: their totals meet on the driver, and more than this is an error.
MAX_SOURCES = 100_000


def targets(totals: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source.  Code point order, null last, takes ``weights`` in turn; a target above ``most``
    times its source's size stops there and the excess is shared by weight until none is above."""
    names = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    weigh = {s: weights[i % len(weights)] for i, (s, _) in enumerate(names)}
    size = dict(names)
    pool, open_, out = share * sum(size.values()), list(weigh), {}
    while open_:
        whole = sum(weigh[s] for s in open_)
        above = [s for s in open_ if pool * weigh[s] / whole > most * size[s]]
        if not above:
            return out | {s: pool * weigh[s] / whole for s in open_}
        out |= {s: most * size[s] for s in above}
        pool -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def settle(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, last: bool) -> tuple[np.ndarray, int, float]:
    """One copy more or not for each document; the index of the one that stays open (-1: none) and its probability.

    Open documents meet in pairs, round by round; in each pair words move from one to the other, in a direction drawn so
    that each keeps its expected copies, until one of the two is integral.  The sum of words in the mix stays the same at
    every step, but for the draw that ends the last open document of all.
    """
    p = p.copy()
    took = (p >= 1).astype(np.int64)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    while len(open_) > 1:
        i, j = open_[: len(open_) // 2 * 2].reshape(-1, 2).T
        si, sj = size[i], size[j]
        up, down = np.minimum((1 - p[i]) * si, p[j] * sj), np.minimum((1 - p[j]) * sj, p[i] * si)
        move = np.where(rng.random(len(i)) * (up + down) < down, up, -down)
        p[i] += move / si
        p[j] -= move / sj
        both = np.concatenate([i, j])
        ended = (p[both] < 1e-9) | (p[both] > 1 - 1e-9)
        took[both[ended]] = p[both[ended]] > 0.5
        rest = np.sort(both[~ended])
        open_ = np.concatenate([rest, open_[len(open_) // 2 * 2 :]])
    if not len(open_):
        return took, -1, 0.0
    k = int(open_[0])
    if last:
        took[k] = rng.random() < p[k]
        return took, -1, 0.0
    return took, k, float(p[k])


def _level(open_rows: DataFrame, level: int, seed: int) -> DataFrame:
    schema = open_rows.schema

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2", "p"], kind="stable", na_position="last").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        took, rest, left = settle(pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64), rng, bool(pdf["blocks"].iloc[0] == 1))
        p = np.where(np.arange(len(pdf)) == rest, left, np.nan)
        return pdf.assign(copies=pdf["copies"] + took, p=p)

    return open_rows.groupBy("source_no", "block").applyInPandas(run, schema)


def draw_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies (0 to 2), and the row's key k1, k2.

    Size is the number of non-blank runs of the whole text, however long; null and blank texts count as 0 words and are
    never taken.  A source's expected copies are target / source size for each of its documents.  Whole copies are given
    outright; the fraction is settled by pivotal rounding within blocks of about ``LEAF_ROWS`` documents, and the one
    document that a block leaves open meets those of other blocks in a tree of fan-in ``FAN_IN``, so a source ends within
    one document of its target.  Sources are numbered by code point, blocks are dealt and sorted by the row's key and
    draws are seeded by source, level and block, so reruns agree whatever the order or partitioning of the rows.  Rows
    that repeat an id, and rows without one, are rows of their own; rows equal in every column draw one by one.  An
    empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *row_key(docs))
    rows = materialize(rows, "sizes")
    found = [(r.source, r.words, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()]
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda t: (t[0] is None, t[0] or ""))
    goal = targets([(s, w) for s, w, _ in found])
    facts = [(i, s, w, goal[s], (MOST if goal[s] >= MOST * w else goal[s] / w) if w else 0.0, max(1, -(-n // LEAF_ROWS))) for i, (s, w, n) in enumerate(found)]
    table = rows.sparkSession.createDataFrame(facts, "source_no long, name string, source_size long, target double, rate double, blocks long")
    rows = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["name"]))
    whole = F.when(F.col("size") > 0, F.floor("rate")).otherwise(F.lit(0)).cast("long")
    rows = rows.select(
        "doc_id", "k1", "k2", "size", "source_size", "target", "source_no", "blocks", F.pmod("k2", "blocks").alias("block"), whole.alias("copies"),
        F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0)).alias("p"),
    )
    most, level, done = max((f[-1] for f in facts), default=1), 0, []
    while True:
        out = materialize(_level(rows, level, seed), f"level{level}")
        done.append(out.where("p is null"))
        if most == 1:
            break
        most, level = -(-most // FAN_IN), level + 1
        up = {"block": F.floor(F.col("block") / FAN_IN), "blocks": F.ceil(F.col("blocks") / FAN_IN)}
        rows = out.where("p is not null").withColumns(up)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "size", "source_size", "target", "copies", "k1", "k2")


def mix_sources(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it was drawn, so from never to twice.

    Draws belong to rows, not ids: rows that repeat an id or have none are kept by their own draws.  Rows equal in every
    column count together: one of them stands for all their draws.  Null and blank texts are never drawn; sources may be
    null, very long texts count with all their words, ties don't arise.  An empty table gives no rows.
    """
    draws = draw_copies(docs, seed=seed).groupBy("k1", "k2").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0")
    draws = materialize(draws, "draws")
    keyed = docs.select(F.struct("*").alias("row"), *row_key(docs))
    joined = attach(keyed, draws, ("k1", "k2"))
    again = joined.where("_rows > 1").dropDuplicates(["k1", "k2"])  # only these rows shuffle
    taken = joined.where("_rows = 1").unionByName(again)
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).select("row.*")
