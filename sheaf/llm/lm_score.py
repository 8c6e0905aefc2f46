"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize
from .tokens import words_of

#: Tokens: the most frequent words by rank, then buckets that share all other words by hash; one more id pads.
CLASSES, RARE = 64, 256
VOCAB = CLASSES * CLASSES
PAD, SIDE, WIDTH = VOCAB, 2, 16
OFFSETS = (-2, -1, 1, 2)
#: Every position of every document trains the network once: each round takes one of ``ROUNDS`` disjoint shares of the documents.
BATCH, ROUNDS, RATE = 4096, 2, 0.08
#: Tokens that one copy of the network is trained on before copies are averaged.
BLOCK_TOKENS = 2_000_000
#: So many of the words in buckets, the most frequent, are looked up inside tasks; the others meet their counts in a join.
KNOWN = 1 << 16
#: Shares are summed as whole multiples of 1 / UNIT, so that the order of the sum doesn't matter.
UNIT = 1 << 30
#: Positions that are scored together, weights of one row of a network's copy, copies that are averaged in one place, and
#: documents whose words are held at once.
CHUNK, SLICE, FAN_IN, HELD = 1 << 14, 1 << 14, 16, 500
#: Exponents stop here, so that sums of exponentials stay finite in 32 bits.
STEEPEST = np.float32(60)
SHAPES = {"embed": (VOCAB + 1, WIDTH), "gate": (len(OFFSETS), WIDTH), "bias": (WIDTH,), "class_w": (WIDTH, CLASSES), "class_b": (CLASSES,), "word_w": (CLASSES, WIDTH, CLASSES), "word_b": (CLASSES, CLASSES)}


class Vocabulary:
    """Word, or hash of a word, to token id."""

    def __init__(self, ranked: list[int]):
        ranked = np.array(ranked, np.uint64)
        self.rank = np.argsort(ranked)
        self.known = ranked[self.rank]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        shared = VOCAB - RARE + hashes % np.uint64(RARE)
        return (np.where(self.known[at] == hashes, self.rank[at], shared) if len(self.known) else shared).astype(np.uint16)

    def __getitem__(self, word: bytes) -> int:
        return int(self.of(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))[0])


class Network:
    """Window of two tokens to each side -> gated sum -> tanh -> class of the token -> token within its class."""

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(7)
            flat = np.concatenate([np.ones(int(np.prod(s))) if k == "gate" else np.zeros(int(np.prod(s))) if k.endswith(("_b", "bias")) else rng.normal(0, 0.3, int(np.prod(s))) for k, s in SHAPES.items()])
        self.flat, at = flat.astype(np.float32), 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            setattr(self, k, self.flat[at : at + n].reshape(s))
            at += n

    @classmethod
    def start(cls, prior: np.ndarray) -> Network:
        """A network that knows the tokens' frequencies and nothing of their neighbours yet."""
        net = cls()
        n = (prior + 0.5).reshape(CLASSES, CLASSES)
        net.class_b[:] = np.log(n.sum(1) / n.sum())
        net.word_b[:] = np.log(n / n.sum(1, keepdims=True))
        net.class_w *= 0.1
        net.word_w *= 0.1
        return net

    def hidden(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of a padded sequence and the hidden layer of all but its two outer positions on each side."""
        near, n = self.embed[seq], len(seq) - 2 * SIDE
        z = np.tile(self.bias, (n, 1))
        for p, o in enumerate(OFFSETS):
            z += near[SIDE + o : SIDE + o + n] * self.gate[p]
        return near, np.tanh(z, out=z)

    def heads(self, h: np.ndarray, ids: np.ndarray, logs: bool = True) -> tuple:
        """Unnormalised probabilities of classes and of tokens within the class, for tokens in ascending order, and their log-probabilities, if asked for."""
        kind, inner = np.divmod(ids.astype(np.int64), CLASSES)
        rows = np.arange(len(ids))
        u = h @ self.class_w
        u += self.class_b
        ends = np.searchsorted(ids, np.arange(CLASSES + 1) * CLASSES)
        v = np.empty((len(ids), CLASSES), np.float32)
        for c in np.unique(kind):
            s, e = ends[c], ends[c + 1]
            np.matmul(h[s:e], self.word_w[c], out=v[s:e])
            v[s:e] += self.word_b[c]
        log_p, sums = np.zeros(len(ids), np.float32) if logs else None, []
        for z, at in ((u, kind), (v, inner)):
            np.minimum(z, STEEPEST, out=z)
            if logs:
                log_p += z[rows, at]
            sums.append(np.exp(z, out=z).sum(1))
            if logs:
                log_p -= np.log(sums[-1])
        return kind, inner, u, v, sums, ends, log_p

    def log_probs(self, seq: np.ndarray) -> np.ndarray:
        """Of a padded sequence, for all but the two outer positions on each side; 0 at padding."""
        order, n = in_order(seq[SIDE:-SIDE])
        out = np.zeros(len(seq) - 2 * SIDE, np.float32)
        if n:
            out[order[:n]] = self.heads(self.hidden(seq)[1][order[:n]], seq[SIDE:-SIDE][order[:n]])[-1]
        return out


def in_order(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Positions by ascending id, and how many of them are no padding, which comes last."""
    return np.argsort(ids, kind="stable"), int(np.count_nonzero(ids != PAD))


class Trainer:
    """Adagrad on one block's positions, from the network it was given."""

    def __init__(self, net: Network):
        self.net, self.squares, self.seen = net, Network(np.full(net.flat.shape, 1e-4)), 0
        self.texts: list[np.ndarray] = []
        self.held = 0

    def _move(self, name: str, grad: np.ndarray, at=...) -> None:
        square = getattr(self.squares, name)
        square[at] += grad * grad
        getattr(self.net, name)[at] -= RATE * grad / np.sqrt(square[at])

    def feed(self, ids: np.ndarray) -> None:
        """One document; whole documents are gathered until they fill a batch."""
        self.texts.append(ids)
        self.held += len(ids)
        if self.held >= BATCH:
            self.flush()

    def flush(self) -> None:
        if self.held:
            seq = padded(self.texts)
            for i in range(SIDE, len(seq) - SIDE, BATCH):
                self.step(seq[i - SIDE : min(i + BATCH, len(seq) - SIDE) + SIDE])
        self.texts, self.held = [], 0

    def step(self, seq: np.ndarray) -> None:
        net, inside = self.net, seq[SIDE:-SIDE]
        order, n = in_order(inside)
        if not n:
            return
        near, hidden = net.hidden(seq)
        h, ids = hidden[order[:n]], inside[order[:n]]
        kind, inner, u, v, sums, ends, _ = net.heads(h, ids, logs=False)
        rows = np.arange(n)
        for z, at, total in ((u, kind, sums[0]), (v, inner, sums[1])):
            z *= (1 / (n * total))[:, None]
            z[rows, at] -= np.float32(1 / n)
        back = u @ net.class_w.T
        word_w, word_b = np.zeros_like(net.word_w), np.zeros_like(net.word_b)
        for c in np.unique(kind):
            s, e = ends[c], ends[c + 1]
            back[s:e] += v[s:e] @ net.word_w[c].T
            word_w[c], word_b[c] = h[s:e].T @ v[s:e], v[s:e].sum(0)
        back *= 1 - h * h
        whole = np.zeros_like(hidden)
        whole[order[:n]] = back
        to, gate = np.zeros_like(near), np.empty_like(net.gate)
        for p, o in enumerate(OFFSETS):
            gate[p] = np.einsum("ij,ij->j", whole, near[SIDE + o : SIDE + o + len(inside)])
            to[SIDE + o : SIDE + o + len(inside)] += whole * net.gate[p]
        order = np.argsort(seq, kind="stable")
        first = np.flatnonzero(np.diff(seq[order].astype(np.int32), prepend=-1))
        self._move("embed", np.add.reduceat(to[order], first, axis=0), seq[order][first])
        self._move("gate", gate)
        self._move("bias", back.sum(0))
        self._move("class_w", h.T @ u)
        self._move("class_b", u.sum(0))
        self._move("word_w", word_w)
        self._move("word_b", word_b)
        self.seen += n


def padded(texts: list[np.ndarray]) -> np.ndarray:
    """Documents in one sequence, with padding before, between and after them."""
    pad = np.full(SIDE, PAD, np.uint16)
    return np.concatenate([*(y for x in texts for y in (pad, x)), pad])


def word_counts(docs: DataFrame) -> DataFrame:
    """Counts of all words of all documents by hash; tasks send one row for each word and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for i in range(0, b.num_rows, HELD):
                hashes, at, _ = words_of(b.column(0).slice(i, HELD))
                found.append(hashes)
                counts.append(np.bincount(at, minlength=len(hashes)))
            word, which = np.unique(np.concatenate(found), return_inverse=True)
            n = np.zeros(len(word), np.int64)
            np.add.at(n, which, np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Shares:
    """The vocabulary of a corpus from its ``word_counts``.

    ``ranked``: hashes of the words with a token of their own; ``prior``: counts of all tokens.  Every other word has a log
    share of the counts of its bucket: ``near`` for the most frequent ones (sorted hashes, shares in units), ``of`` for
    all as a column over ``word_counts``.
    """

    def __init__(self, counts: DataFrame):
        top = counts.orderBy(F.desc("n"), "word").limit(VOCAB - RARE).collect()
        self.ranked = [r.word & (2**64 - 1) for r in top]
        head, ranked_n = [r.word for r in top], [r.n for r in top]
        rare = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(h,) for h in head], "word long")), "word", "left_anti")
        bucket = F.pmod("word", F.lit(RARE))
        self.total = {r.bucket: r.n for r in rare.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect()}
        totals = F.array(*(F.lit(self.total.get(i, 1)) for i in range(RARE)))
        share = F.round((F.log(F.col("n")) - F.log(F.get(totals, bucket.cast("int")))) * UNIT).cast("long")
        self.of = rare.select("word", share.alias("share"))
        top = rare.orderBy(F.desc("n"), "word").limit(KNOWN).select("word", share.alias("share")).toPandas()
        word = top["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(word)
        self.near = word[order], top["share"].to_numpy(np.int64)[order]
        self.prior = np.zeros(VOCAB)
        self.prior[: len(head)] = ranked_n
        self.prior[VOCAB - RARE :] = [self.total.get(i, 0) for i in range(RARE)]


def encode(docs: DataFrame, shares: Shares) -> DataFrame:
    """Documents as token ids, so that texts are split once for training and scoring: doc_id, row (a number of the row),
    n_tokens, ids (16 bits each), gain (shares of the bucketed words in ``shares.near``), words (hashes of the other bucketed words), key.
    """
    kind, ranked, near = docs.schema["doc_id"].dataType.simpleString(), shares.ranked, shares.near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, row = Vocabulary(ranked), TaskContext.get().partitionId() << 33
        for b in (whole.slice(i, HELD) for whole in batches for i in range(0, whole.num_rows, HELD)):
            hashes, at, ends = words_of(b.column(1))
            id_of = vocabulary.of(hashes)
            rare = id_of >= VOCAB - RARE
            found = np.minimum(np.searchsorted(near[0], hashes), max(len(near[0]) - 1, 0))
            hit = rare & (near[0][found] == hashes) if len(near[0]) else np.zeros(len(hashes), bool)
            share_of, left_of = np.zeros(len(hashes), np.int64), rare & ~hit
            share_of[hit] = near[1][found[hit]]
            upto = lambda x: np.concatenate([[0], np.cumsum(x[at])])[ends]
            ids = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(id_of[at])])
            left = pa.ListArray.from_arrays(pa.array(upto(left_of).astype(np.int32)), pa.array(hashes[at[left_of[at]]].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.arange(row, row + b.num_rows)), pa.array(np.diff(ends)), ids, pa.array(np.diff(upto(share_of))), left],
                names=["doc_id", "row", "n_tokens", "ids", "gain", "words"],
            )
            row += b.num_rows

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, ids binary, gain long, words array<long>")
    return found.withColumn("key", F.xxhash64("doc_id", "ids"))


def train_round(rows: DataFrame, blocks: int, flat: np.ndarray) -> np.ndarray:
    """Each of ``blocks`` blocks of documents trains a copy of the network; copies are averaged by positions seen, in a tree.

    ``rows`` has ids and key.  A block takes documents by their key and in its order, so the result depends neither on
    the partitioning nor on the order of the rows, and copies of one text spread over all blocks.
    """
    dealt = rows.select(F.pmod(F.shiftrightunsigned("key", 8), F.lit(blocks)).alias("block"), "key", "ids").repartition("block").sortWithinPartitions("block", "key", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, trainer = None, None
        for b in batches:
            for at, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if at != block:
                    if trainer is not None:
                        yield _copy(trainer, block)
                    block, trainer = at, Trainer(Network(flat.copy()))
                trainer.feed(np.frombuffer(ids, np.uint16))
        if trainer is not None:
            yield _copy(trainer, block)

    schema = "slice int, part long, seen long, weights binary"
    copies = materialize(dealt.mapInArrow(run, schema), "copies")

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        seen = pdf["seen"].to_numpy(np.float64)
        mean = sum(np.frombuffer(w, np.float32) * s for w, s in zip(pdf["weights"], seen, strict=True)) / seen.sum()
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN_IN, "seen": [int(seen.sum())], "weights": [mean.astype(np.float32).tobytes()]})

    most = copies.agg(F.max("part")).first()[0]
    if most is None:
        return flat
    while most:
        copies = copies.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("to")).applyInPandas(average, schema)
        copies, most = materialize(copies, "copies"), most // FAN_IN
    return np.concatenate([np.frombuffer(r.weights, np.float32) for r in sorted(copies.collect(), key=lambda r: r.slice)])


def _copy(trainer: Trainer, block: int) -> pa.RecordBatch:
    trainer.flush()
    parts = np.array_split(trainer.net.flat, -(-len(trainer.net.flat) // SLICE))
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([block] * n, pa.int64()), pa.array([trainer.seen] * n, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "part", "seen", "weights"])


def train(encoded: DataFrame, prior: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after all positions of ``encoded`` (a written table) were seen once, from tokens' counts ``prior`` on."""
    rows, flat = encoded.where("n_tokens > 0"), Network.start(prior).flat
    tokens = rows.agg(F.sum("n_tokens")).first()[0] or 0
    blocks = max(1, -(-tokens // (rounds * BLOCK_TOKENS)))
    for k in range(rounds):
        flat = train_round(rows.where(F.pmod("key", F.lit(rounds)) == k), blocks, flat)
    return flat


def score_ids(encoded: DataFrame, flat: np.ndarray) -> DataFrame:
    """The rows of ``encoded`` with log_prob, the sum of conditional log-probabilities of their ids, in place of words, ids and key."""
    keep = ["doc_id", "row", "n_tokens", "gain"]
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(flat)
        for b in batches:
            ids = [np.frombuffer(x, np.uint16) for x in b.column(4).to_pylist()]
            seq = padded(ids)
            owner = np.repeat(np.arange(len(ids)), [len(x) + SIDE for x in ids])
            total = np.zeros(len(ids))
            for i in range(SIDE, len(seq) - SIDE, CHUNK):
                e = min(i + CHUNK, len(seq) - SIDE)
                total += np.bincount(owner[i - SIDE : e - SIDE], net.log_probs(seq[i - SIDE : e + SIDE]), len(ids))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(total)], names=[*keep, "log_prob"])

    return encoded.select(*keep, "ids").mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, gain long, log_prob double")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens, log_prob (sum over all tokens of log p(token | two tokens to each side)), mean_log_prob.

    Words (A-Z lower-cased, split at ASCII blanks) are tokens by frequency rank over all documents, ties by hash; a word
    beyond the ranks has the probability of its bucket times its share of the counts of all words in the bucket, counted
    over the whole corpus.  Every position of every document, however long, trains the network once: blocks of documents
    train copies, which are averaged after each round.  Null and wordless texts have no tokens, log_prob 0 and a null
    mean.  Rows that repeat an id or have none are rows of their own; repeated rows get equal scores up to the rounding
    of 32-bit sums.  An empty table gives no rows.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = materialize(word_counts(texts), "words")
    shares = Shares(counts)
    encoded = materialize(encode(texts, shares), "ids")
    flat = train(encoded, shares.prior)
    more = encoded.select("row", F.explode("words").alias("word")).join(shares.of, "word").groupBy("row").agg(F.sum("share").alias("more"))
    out = attach(score_ids(encoded, flat), materialize(more, "more"), "row", "left")
    total = F.col("log_prob") + (F.col("gain") + F.coalesce("more", F.lit(0))) / UNIT
    return out.select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))
