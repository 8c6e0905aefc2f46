"""Operators against plain Python on small inputs."""

from __future__ import annotations

import random
import re
import string
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheaf.llm import components, decontaminate, exact_dedup, lm_score, mixing, near_dedup, quality, sharding, substring_dedup, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", 0) for i, t in enumerate(texts)], DOCS)


def near_texts(rng):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(30)]
    for base in list(texts[:12]):
        for _ in range(4):
            w = base.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    return [*texts, "", None, texts[0], texts[0]]


def near_truth(texts, percent=85):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def test_near_duplicates(spark):
    texts = near_texts(random.Random(3))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == near_truth(texts)


def test_the_stage_drops_pairs_from_four_fifths_on(spark):
    words = lambda k, n, own: [*(f"k{k}w{i}" for i in range(n - own)), *(f"k{k}x{i}" for i in range(own))]
    # shingles: 54 each, 48 of 60 shared (0.80); 56 each, 50 of 62 (0.806); 50 each, 44 of 56 (0.786)
    texts = [" ".join(words(k, n, own)) for k, n in ((0, 58), (1, 60), (2, 54)) for own in (0, 6)]
    assert {r.doc_id for r in near_dedup.drop_near_duplicates(frame(spark, texts)).collect()} == {0, 2, 4, 5}
    assert all(r.kept for r in near_dedup.near_duplicates(frame(spark, texts)).collect())


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """2,000 texts around one, most of them further from each other than from it, and 300 just below the threshold."""
    monkeypatch.setattr(near_dedup, "PER_PART", 150)
    monkeypatch.setattr(near_dedup, "OUTSIDERS", 40)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(160)]
    texts = [" ".join(base)]
    for k in range(2300):
        w, edits = list(base), rng.randint(0, 2) if k < 2000 else 3
        for n in range(edits):
            w[10 + 50 * n + rng.randrange(10)] = f"x{k}y{n}"
        texts.append(" ".join(w))
    texts += [f"other {i} words of a text that is not like them" for i in range(200)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [i for i, s in enumerate(sets) if 100 * len(s & sets[0]) >= 85 * len(s | sets[0])]
    assert len(near) > 1900 and all(got[i] == (len(sets[i]), 0) for i in near)
    assert all(got[i][1] == 0 or i > 2000 for i in range(2301)) and all(got[i][1] == i for i in range(2301, len(texts)))


def test_rows_of_a_group_by_row_not_by_id(spark):
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "a b c d e f g h"
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a, "en", "s", 0), (3, c, "en", "s", 0), (3, c, "en", "s", 0), (None, b, "en", "s", 0), (None, "z y x w v u", "en", "s", 0), (4, None, "en", "s", 0), (4, None, "en", "s", 0)]
    kept = Counter(tuple(r) for r in near_dedup.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == Counter([rows[0], rows[1], rows[3], rows[6], rows[7], rows[8]])
    texts = spark.createDataFrame([("b", a), ("a", a), ("c", b)], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(texts).collect()} == {"a": "a", "b": "a", "c": "c"}


@pytest.mark.parametrize("percent, bands, rows", [(85, 32, 8), (80, 42, 6)])
def test_search_misses_few_pairs_at_its_threshold(percent, bands, rows):
    search = near_dedup.Search(percent)
    assert (search.bands, search.rows) == (bands, rows)
    assert search.missed < 1e-4 and search.missed / 1000 < search.cut <= search.missed / 100


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(50, 60), (60, 55)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 130)} == {100} and {got[i] for i in (50, 55, 60)} == {50}


def substring_truth(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), kept))
    return out


@pytest.mark.parametrize("hot, levels", [(4096, 12), (1, 3), (0, 2)])
def test_substring_dedup(spark, monkeypatch, hot, levels):
    """Also when minimizers with more than one piece, or all, are cut again, and when the levels end."""
    monkeypatch.setattr(substring_dedup, "HOT_PIECES", hot)
    monkeypatch.setattr(substring_dedup, "LEVELS", levels)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 3000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(1, 9)))
    body = lambda n: " ".join(word() for _ in range(n))
    shared = [body(60) for _ in range(4)]
    texts = [body(rng.randint(0, 80)) + (rng.choice(shared) + body(rng.randint(0, 30))) * rng.randint(0, 2) for _ in range(40)]
    texts += ["ab" * 150, "x" * 199, "x" * 200, "x" * 201, None, "", texts[0], "xyz" * 400]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.substring_dedup(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == substring_truth(texts)


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for size in (3, 40, 700):
        text = np.concatenate([rng.integers(97, 99, size).astype(np.uint8), np.array([255], np.uint8)])
        text = np.concatenate([text, text[: size // 2], np.array([254], np.uint8)])
        for length in (1, 2, 5, 9):
            seen = Counter(text[i : i + length].tobytes() for i in range(len(text) - length + 1))
            flag = substring_dedup.repeated_starts(text, length)
            assert all(flag[i] == (seen[text[i : i + length].tobytes()] > 1) for i in range(len(text) - length + 1))


def minimax_truth(sizes, shards):
    best = {0: 0}
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cost = {(0, 0): 0}
    for k in range(1, shards + 1):
        for e in range(len(sizes) + 1):
            cost[k, e] = min((max(cost[k - 1, s], int(ends[e] - ends[s])) for s in range(e + 1) if (k - 1, s) in cost), default=10**18)
    del best
    return cost[shards, len(sizes)]


def test_minimax_cuts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "STEP_BITS", 2)
    for n, shards in ((1, 4), (5, 4), (60, 5)):
        keys = np.sort(rng.integers(-(2**63), 2**63 - 1, n))
        sizes = rng.integers(1, 1000, n)
        table = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes, strict=True)], "key long, bytes long")
        cuts = sharding.minimax_cuts(table, shards)
        assert len(cuts) < shards
        loads = [int(sizes[(np.searchsorted(np.array(cuts, np.int64), keys, side="right")) == i].sum()) for i in range(shards)]
        assert max(loads) == minimax_truth(sizes, shards)


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard_documents(docs).toPandas()
    text = docs.toPandas().set_index("doc_id").text
    assert rows.groupby(rows.doc_id.map(text)).shard.nunique().max() == 1
    for _, s in rows.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    loads = rows.groupby("shard")["size"].sum()
    assert loads.max() <= rows["size"].sum() / 8 + rows["size"].max()


def test_a_large_group_has_its_own_shard(spark):
    docs = frame(spark, ["same text " * 30] * 40 + [f"text {i} " * 20 for i in range(60)])
    rows = sharding.shard_documents(docs).toPandas()
    assert rows[rows.doc_id < 40].shard.nunique() == 1
    others = rows[rows.doc_id >= 40].groupby("shard")["size"].sum()
    assert len(others) == 7 and others.max() < 2 * others.min()


@pytest.mark.parametrize("names", [["a", "b", "b", "b", "c", None], [f"s{i}" for i in range(11)] + [None]])
def test_mixing(spark, monkeypatch, names):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(1)
    sources = [rng.choice(names) for _ in range(900)]
    docs = frame(spark, [" ".join(["w"] * rng.randint(0, 40)) for _ in sources], sources)
    orders = (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(1))
    first, *others = (mixing.draw_copies(d).toPandas().sort_values("doc_id").reset_index(drop=True) for d in orders)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    others.append(mixing.draw_copies(docs.repartition(3)).toPandas().sort_values("doc_id").reset_index(drop=True))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(first.equals(x) for x in others)
    assert set(first.copies) <= {0, 1, 2}
    first["source"] = sources
    for _, s in first.groupby("source", dropna=False):
        assert abs((s.copies * s["size"]).sum() - s.target.iloc[0]) <= s["size"].max()
    assert first.drop_duplicates("source").target.sum() == pytest.approx(1.5 * first["size"].sum())


def test_the_mix_holds_each_row_as_often_as_it_was_drawn(spark):
    rows = [(None, "a b", "en", "s", i) for i in range(6)] + [(1, "a b c", "en", "s", 0)] * 5 + [(2, "x", "en", "t", 0), (2, "y z", "en", "t", 1), (3, None, "en", "t", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    drawn = mixing.draw_copies(docs).collect()
    assert len(drawn) == len(rows)
    got = Counter(tuple(r) for r in mixing.mix_sources(docs).collect())
    assert sum(got.values()) == sum(r.copies for r in drawn)
    assert sum(v for k, v in got.items() if k[0] is None) == sum(r.copies for r in drawn if r.doc_id is None) > 0
    assert got[(1, "a b c", "en", "s", 0)] == sum(r.copies for r in drawn if r.doc_id == 1)
    assert all(got[k] <= 2 * rows.count(k) for k in got)


def test_targets_stop_at_twice_the_size():
    got = mixing.targets([("b", 100), ("a", 10), (None, 50)])
    assert got["a"] == 20 and got["b"] == pytest.approx((240 - 20) * 2 / 3) and got[None] == pytest.approx((240 - 20) / 3)


def test_rounding_keeps_expected_copies():
    size, p = np.array([3.0, 5, 2, 8]), np.array([0.5, 0.2, 0.9, 0.4])
    runs = [mixing.settle(size, p, np.random.default_rng(i), True)[0] for i in range(4000)]
    assert np.abs(np.mean(runs, axis=0) - p).max() < 0.03


def plain_log_prob(net, left2, left, token, right, right2):
    """One conditional log-probability from the definition, in 64 bits."""
    full = lambda x: np.asarray(x, np.float64)
    h = np.tanh(sum(full(net.embed[t]) * full(g) for t, g in zip((left2, left, right, right2), net.gate, strict=True)) + net.bias)
    kind, inner = divmod(int(token), lm_score.CLASSES)
    out = 0.0
    for z, at in ((h @ full(net.class_w) + net.class_b, kind), (h @ full(net.word_w[kind]) + net.word_b[kind], inner)):
        out += z[at] - np.log(np.exp(z - z.max()).sum()) - z.max()
    return out


def test_network_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    net = lm_score.Network()
    a, b, c, d = rng.integers(0, lm_score.VOCAB, 4).astype(np.uint16)
    total = sum(np.exp(float(net.log_probs(np.array([a, b, t, c, d], np.uint16))[0])) for t in range(lm_score.VOCAB))
    assert total == pytest.approx(1, abs=1e-3)
    text = np.repeat(rng.integers(0, 50, 10_000), 2).astype(np.uint16)
    seq = lm_score.padded([text[:500]])
    before = net.log_probs(seq).mean()
    trainer = lm_score.Trainer(net)
    for _ in range(3):
        for i in range(0, len(text), 1000):
            trainer.feed(text[i : i + 1000])
    trainer.flush()
    assert trainer.seen == 3 * len(text)
    assert net.log_probs(seq).mean() > max(before, np.log(1 / 50)) + 0.5


def test_one_step_follows_the_gradient():
    """Squares that are large make Adagrad a plain gradient step; finite differences give the same direction."""
    rng = np.random.default_rng(3)
    seq = lm_score.padded([rng.integers(0, 300, 9).astype(np.uint16), rng.integers(0, 300, 4).astype(np.uint16)])
    net, n = lm_score.Network(), 13
    loss = lambda flat: -float(sum(plain_log_prob(lm_score.Network(flat), *seq[i - 2 : i + 3][[0, 1, 2, 3, 4]]) for i in range(2, len(seq) - 2) if seq[i] != lm_score.PAD)) / n
    trainer = lm_score.Trainer(lm_score.Network(net.flat.copy()))
    trainer.squares.flat[:] = 1e6
    trainer.step(seq)
    moved = (net.flat - trainer.net.flat).astype(np.float64) * 1e3 / lm_score.RATE
    big = np.argsort(-np.abs(moved))[[0, 5, 40, 200, 400]]
    for k in big:
        up, down = net.flat.copy(), net.flat.copy()
        up[k], down[k] = up[k] + 1e-2, down[k] - 1e-2
        assert moved[k] == pytest.approx((loss(up) - loss(down)) / float(up[k] - down[k]), rel=0.1, abs=2e-3)


def encoded(docs):
    shares = lm_score.Shares(lm_score.materialize(lm_score.word_counts(docs), "words"))
    return shares, lm_score.materialize(lm_score.encode(docs, shares), "ids")


def test_scores_are_sums_over_windows(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(20)
    shares, rows = encoded(docs)
    flat = lm_score.train(rows, shares.prior)
    net, words = lm_score.Network(flat), lm_score.Vocabulary(shares.ranked)
    got = {r.doc_id: r for r in lm_score.score_ids(rows, flat).collect()}
    for d in docs.collect():
        ids = [words[w] for w in d.text.encode().lower().split()]
        full = [lm_score.PAD] * 2 + ids + [lm_score.PAD] * 2
        one = sum(plain_log_prob(net, *full[i - 2 : i + 3]) for i in range(2, len(full) - 2))
        assert got[d.doc_id].n_tokens == len(ids) and got[d.doc_id].log_prob == pytest.approx(one, rel=1e-3)


def test_training_takes_every_position_once_and_no_partitioning_changes_it(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH", 7)
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 30)
    monkeypatch.setattr(lm_score, "FAN_IN", 2)
    asked = []
    keep = lm_score.materialize
    texts = ["one", "two words", *(" ".join(f"w{i * k % 50}" for i in range(40)) for k in range(1, 9)), "", None]
    docs = frame(spark, texts)
    shares, rows = encoded(docs)
    monkeypatch.setattr(lm_score, "materialize", lambda df, label: asked.append(kept := keep(df, label)) or kept)
    flat = lm_score.train(rows, shares.prior)
    first = [d.where("slice = 0").agg(F.sum("seen"), F.count("seen")).first() for d in asked]
    whole = [x for x, before in zip(first, [(0, 0), *first], strict=False) if x[1] >= before[1]]
    assert sum(x[0] for x in whole) == 323 and all(x[1] > 2 for x in whole)
    _, again = encoded(docs.orderBy(F.desc("doc_id")).repartition(3))
    assert np.array_equal(flat, lm_score.train(again, shares.prior))


def test_the_trained_network_beats_word_frequencies_on_other_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200").dropDuplicates(["text"])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    shares, rows = encoded(docs)
    flat = lm_score.train(rows.where(~held), shares.prior)
    scored = lm_score.score_ids(rows.where(held), flat).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
    ids = lambda where: np.concatenate([np.frombuffer(r.ids, np.uint16) for r in rows.where(where).select("ids").collect()])
    share = np.bincount(ids(~held), minlength=lm_score.VOCAB) + 1.0
    unigram = np.log(share / share.sum())[ids(held)].mean()
    assert scored[0] / scored[1] > unigram + 0.1


@pytest.mark.parametrize("known", [3, 0, 1 << 16])
def test_a_rare_word_has_its_share_of_its_bucket(spark, monkeypatch, known):
    monkeypatch.setattr(lm_score, "KNOWN", known)
    head = " ".join(f"h{i}" for i in range(lm_score.VOCAB - lm_score.RARE))
    tail = [f"t{i}" for i in range(600)]
    texts = [" ".join([head] * 20), " ".join(tail), " ".join(tail[:300]) + " t0 t0", "t0 h1 h2", "t1 h1 h2", "h3 h4", "", None, "t0 h1 h2"]
    docs = frame(spark, texts).repartition(3, "doc_id")
    counts = Counter(w for t in texts for w in (t or "").split())
    shares, rows = encoded(docs)
    flat = lm_score.train(rows, shares.prior)
    bucket, total = {w: lm_score.xxhash.xxh3_64_intdigest(w.encode()) % lm_score.RARE for w in tail}, Counter()
    for w in tail:
        total[bucket[w]] += counts[w]
    net = {r.doc_id: r for r in lm_score.score_ids(rows, flat).collect()}
    got = {r.doc_id: r for r in lm_score.pseudo_likelihood(docs).collect()}
    for i, t in enumerate(texts):
        more = sum(np.log(counts[w] / total[bucket[w]]) for w in (t or "").split() if w in bucket)
        assert got[i].log_prob == pytest.approx(net[i].log_prob + more, abs=1e-2)
        assert got[i].mean_log_prob == (pytest.approx(got[i].log_prob / got[i].n_tokens) if t else None)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95


@pytest.mark.parametrize("rows_per_word, slice_words", [(4, 1_000_000), (4, 7), (1000, 1)])
def test_filter_lets_no_repeated_row_pass(spark, monkeypatch, rows_per_word, slice_words):
    """Also when the filter is probed in slices, and when it is so small that single rows look repeated."""
    monkeypatch.setattr(exact_dedup, "ROWS_PER_WORD", rows_per_word)
    monkeypatch.setattr(exact_dedup, "SLICE_WORDS", slice_words)
    texts = [f"t{i % 70 if i < 200 else i}" for i in range(400)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame(spark, texts)).collect()}
    assert got == {i: (texts.index(t), texts.count(t)) for i, t in enumerate(texts)}


def test_only_repeated_rows_pass_the_filter(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.when(F.col("id") < 100, F.col("id") % 10).otherwise(F.col("id")).cast("string"), 256).alias("text_sha256"))
    words = 20_000 // exact_dedup.ROWS_PER_WORD + 1
    through = exact_dedup.probe(rows, exact_dedup.materialize(exact_dedup.repeated_filter(rows, words), "filter"), words).where("maybe").count()
    assert 100 <= through < 400


def test_cascade_is_exact_on_the_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)  # so that levels have false positives
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 600, 3)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(600)], "key string")
    levels = url_filter.cascade(listed, universe)
    got = {r.key for r in universe.where(url_filter.decide(levels, F.col("key"))).collect()}
    assert len(levels) > 2 and got == {f"k{i}" for i in range(0, 600, 3)}


def plain_rule(rules, host, path):
    labels = host.split(".")
    keys = {".".join(labels[i:]) for i in range(len(labels))}
    fit = [(len(h + p), v == "allow", h + p, v) for h, p, v in rules if h in keys and path.startswith(p)]
    return max(fit)[2:] if fit else (None, "allow")


@pytest.mark.parametrize("slice_keys, pass_", [(1 << 14, 8), (40, 2)])
def test_url_rules_against_a_loop_over_them(spark, monkeypatch, slice_keys, pass_):
    monkeypatch.setattr(url_filter, "SLICE_KEYS", slice_keys)
    monkeypatch.setattr(url_filter, "PASS", pass_)
    rng = random.Random(4)
    name = lambda: ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    place = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3)))
    rules = list({(name(), place()): rng.choice(["allow", "block"]) for _ in range(260)}.items())
    rules = [(h, p, v) for (h, p), v in rules] + [("b.org", "/", "allow"), ("org", "/x/", "block")]
    urls = [(name(), place()) for _ in range(500)] + [("b.org", "/x/1")]
    pages = spark.createDataFrame([(i, f"http://{h}{p}?q") for i, (h, p) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: plain_rule(rules, h, p) for i, (h, p) in enumerate(urls)}


def test_seventy_thousand_rules(spark):
    rules = spark.range(70_000).selectExpr("concat('h', id, '.net') as host", "'/' as path", "if(id % 2 = 0, 'block', 'allow') as verdict")
    pages = spark.range(0, 140_000, 7).selectExpr("id as page_id", "concat('http://w.h', id, '.net/a') as url")
    got = url_filter.filter_urls(pages, rules)
    wrong = got.where("not (rule <=> if(page_id < 70000, concat('h', page_id, '.net/'), null)) or verdict <> if(page_id < 70000 and page_id % 2 = 0, 'block', 'allow')")
    assert got.count() == 20_000 and wrong.isEmpty()


def hits_truth(text, items, window=13):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t or ""))
    words, hit, found = word(text), set(), set()
    for item, t in items:
        w = word(t)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        at = [i for i in range(len(words) - n + 1) if n and tuple(words[i : i + n]) in grams]
        hit |= {k for i in at for k in range(i, i + n)}
        found |= {str(item)} if at else set()
    return words, hit, sorted(found)


def test_decontamination_by_row(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_GRAMS", 3)  # several slices
    rng = random.Random(8)
    words = [*"abcdef", "É", "x1"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 6, 14, 16])))) for i in range(8)] + [(8, ""), (9, None)]
    texts = [", ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(["", f" {rng.choice(items[:8])[1]}"]) for _ in range(60)] + [None, ""]
    ids = [rng.choice([None, 1, 2, i]) for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    truth = [hits_truth(t, items) for t in texts]
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.judge(docs, bench).collect())
    assert got == Counter((i, len(w), len(h), tuple(f), bool(h) and 20 * len(h) >= len(w)) for i, (w, h, f) in zip(ids, truth, strict=True))
    kept = {r.n_chars: r.text for r in decontaminate.decontaminate(docs, bench, "span").collect()}
    left = lambda t: [w.lower() for w in re.findall(r"\w+", t or "")]
    for k, (w, h, _) in enumerate(truth):
        cut = bool(h) and 20 * len(h) >= len(w)
        assert left(kept[k]) == [x for j, x in enumerate(map(str.lower, w)) if not cut or j not in h]
    assert {r.n_chars for r in decontaminate.decontaminate(docs, bench).collect()} == {k for k, (w, h, _) in enumerate(truth) if not h or 20 * len(h) < len(w)}


def test_a_million_words_in_one_text(spark):
    """Linear in the text: minutes if each stretch carried the words along."""
    text = " ".join(f"w{i % 5003}" for i in range(1_000_000))
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100, 120)))], "item_id long, text string")
    began = time.perf_counter()
    row = decontaminate.judge(frame(spark, [text]), bench).first()
    assert (row.n_words, row.n_hit) == (1_000_000, 20 * 200) and time.perf_counter() - began < 90


def additive(model, x):
    """Score of one row from the definition: base, one table entry a feature, one a pair."""
    at = lambda edges, v: sum(v >= e for e in edges)
    z = model.base + sum(t[at(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
    z += sum(t[at(model.pair_edges[i], x[i]), at(model.pair_edges[j], x[j])] for i, j, t in model.pairs)
    return 1 / (1 + np.exp(-z))


def test_quality_against_a_plain_additive_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.orderBy("doc_id").toPandas()
    known = labels.toPandas().dropna().groupby("doc_id").quality.max()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id}
    x = np.array([quality.features((t or "").encode()) for t in rows.text])
    mine = [k for k, i in enumerate(rows.doc_id) if i in known.index and not held[i]]
    model = quality.fit(x[mine], known.loc[rows.doc_id.iloc[mine]].to_numpy(float))
    assert len(model.pairs) == quality.PAIRS
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for k, i in enumerate(rows.doc_id):
        assert got[i].held_out == held[i] and got[i].score == pytest.approx(additive(model, x[k]), abs=1e-9)
        assert got[i].predicted == (got[i].score >= 0.3)


def test_trees_find_the_best_split():
    rng = np.random.default_rng(6)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.uniform(0.1, 1, 9)
        best = max(range(1, 9), key=lambda k: gain(g[:k], h[:k]) + gain(g[k:], h[k:]))
        tree = quality.shallow_tree(g, h, leaves=2)
        parts = [slice(0, best), slice(best, 9)] if gain(g[:best], h[:best]) + gain(g[best:], h[best:]) - gain(g, h) > 1e-6 else [slice(0, 9)]
        assert all(np.allclose(tree[p], g[p].sum() / (h[p].sum() + 1)) for p in parts)
        g, h = rng.normal(size=(4, 5)), rng.uniform(0.1, 1, (4, 5))
        table, found = quality.pair_tree(g, h)
        assert len(np.unique(table.round(12))) <= 4 and found >= max(quality._cut(g.sum(1), h.sum(1), 0, 4)[0], quality._cut(g.sum(0), h.sum(0), 0, 5)[0]) - 1e-9


def test_shards_against_dynamic_programming(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["aa", "b", "ccc é"], k=rng.randint(0, 30))) for _ in range(150)] + ["big " * 900] * 3 + [None, ""]
    docs = frame(spark, texts)
    keys = dict(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    sizes, size = Counter(), [len((t or "").encode()) + 1 for t in texts]
    for i, n in enumerate(size):
        sizes[keys[i]] += n
    order, own, left, total = sorted(sizes), [], 8, sum(size)
    for k in sorted(sizes, key=lambda k: (-sizes[k], k)):
        if len(own) == 7 or sizes[k] * left <= total:
            break
        own.append(k)
        left, total = left - 1, total - sizes[k]
    rest = np.array([sizes[k] for k in order if k not in own])
    rows = sharding.shard_documents(docs).toPandas()
    load = rows.groupby("shard")["size"].sum()
    assert [load[i] for i in range(len(own))] == [sizes[k] for k in own] and max(load[len(own) :]) == minimax_truth(rest, left)
    assert sorted(rows["size"]) == sorted(size) and rows.groupby(rows.doc_id.map(keys)).shard.nunique().max() == 1
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in rows.groupby("shard"))
    assert {r.doc_id: r.text_crc32 for r in rows.itertuples()} == {i: zlib.crc32((t or "").encode()) for i, t in enumerate(texts)}


def test_pipeline_stages_against_plain_python(spark):
    """Each stage on what the one before kept, row by row."""
    docs, (labels, bench) = spark.read.parquet(f"{SF}/documents.parquet"), (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda rows: sorted(r.doc_id for r in rows)

    before = docs
    after = corpus_pipeline.materialize(stages["quality classifier"](spark, before, SF), "stage")
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.score >= 0.3}
    assert ids(after.collect()) == ids(r for r in before.collect() if r.doc_id in good)

    rows = sorted(after.collect(), key=lambda r: r.doc_id)
    before, after = after, corpus_pipeline.materialize(stages["near-duplicates"](spark, after, SF), "stage")
    truth = near_truth([r.text for r in rows], 80)
    assert ids(after.collect()) == [r.doc_id for k, (r, (_, top)) in enumerate(zip(rows, truth, strict=True)) if top == k]

    rows = after.collect()
    after = corpus_pipeline.materialize(stages["decontamination"](spark, after, SF), "stage")
    clean = [r for r in rows for w, h, _ in [hits_truth(r.text, items)] if not h or 20 * len(h) < len(w)]
    assert ids(after.collect()) == ids(clean)

    drawn = {r.doc_id: r.copies for r in mixing.draw_copies(after).collect()}
    before, after = after, corpus_pipeline.materialize(stages["mixing"](spark, after, SF), "stage")
    assert Counter(map(tuple, after.collect())) == Counter({tuple(r): drawn[r.doc_id] for r in before.collect() if drawn[r.doc_id]})

    rows = stages["sharding"](spark, after, SF).toPandas()
    assert Counter(rows.doc_id) == Counter(r.doc_id for r in after.collect())
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in rows.groupby("shard")) and rows.groupby("text").shard.nunique().max() == 1


def test_pipeline_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert set(rows.doc_id) <= set(docs.index) and rows.groupby("doc_id").size().max() <= 2
    assert (rows.text == rows.doc_id.map(docs.text)).all()
    truth = near_truth(list(docs.loc[sorted(set(rows.doc_id))].text))
    assert len({t for _, t in truth}) == len(truth)
