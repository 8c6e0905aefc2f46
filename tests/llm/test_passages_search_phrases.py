"""Toxic passages, ranked search and collocations against plain Python, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pytest

from sheaf.llm import collocations, ranked_search, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, langs=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, langs[k] if langs else "en", "s", 0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    clash = ["score", "term", "block", "seg", "rank", "piece", "unit", "row", "n"]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *(f"1 as {c}" for c in clash))


# ranked search


def ranked_truth(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = set()
    for item, text in items:
        asked = Counter(terms(text))
        found = []
        for i, c in rows:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            found += [(-s, i is None, i or 0)] if s > 0 else []
        out |= {(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize(("block", "segment"), [(128, 16 << 20), (2, 300), (1, 1)])
def test_ranked_search(spark, monkeypatch, block, segment):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(ranked_search, "QUERIES_AT_ONCE", 3)
    rng = random.Random(block)
    words = [f"w{i}" for i in range(40)] + ["É", "straße", "A1"]
    texts = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 30))) for _ in range(200)]
    texts += [None, "", "...", "w1 w1 w1", "w1 w1 w1", "w39-w39_É"]
    ids = [*range(205), None]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for k in range(12)] + [(20, None), (21, ""), (22, "unknown"), (23, "W1 w1 É")]
    index = ranked_search.build_index(frame(spark, texts, ids=ids).repartition(3))
    got = ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == ranked_truth(list(zip(ids, texts, strict=True)), items)


def test_ranked_search_skips_blocks(spark):
    """With the best documents found, windows that cannot reach them stay closed: their blocks aren't decompressed."""
    held = ranked_search.Segment()
    for i in range(20_000):
        held.add(i, b"common " * (9 if i % 4000 < 9 else 1) + b"other " * (1 + i % 50) + (b"rare" if i % 4000 == 7 else b""))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL("seg long, term string, df int, last array<int>, top array<int>, at array<int>, blob binary, ids array<bigint>, m array<long>"))
    rows = held.rows(0, 20_000, 600_000, schema).to_pylist()
    m, rows = np.array(rows[0]["m"]), [r for r in rows[1:] if r["term"] in ("common", "rare")]
    lists = ranked_search.Lists(rows, m)
    weights = {t: 9000 if r["term"] == "rare" else 1 for t, r in enumerate(rows)}
    best = lists.best(weights, 3)
    assert [d for d, _ in best] == [7, 4007, 8007]
    assert len(lists.open) < 0.2 * sum(len(r["last"]) for r in rows)


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**31 - 1] * 5, np.int64)
    data, at = ranked_search.pack(values)
    assert (ranked_search.unpack(data) == values).all() and at[-1] == len(data)


def test_search_of_nothing(spark):
    docs, items = frame(spark, ["a b"]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    empty = ranked_search.build_index(docs.limit(0))
    assert ranked_search.search(empty, items).collect() == []
    assert ranked_search.search(ranked_search.build_index(docs), items.limit(0)).collect() == []


# collocations


def collocation_truth(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for s in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[s : s + k])] += 1
    out = set()
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in some.items() for k in range(2, len(p)) for s in range(len(p) - k + 1) for q in [p[s : s + k]] if a >= some.get(q, 0)}
        scored = []
        for p, a in some.items():
            if p not in inside:
                cuts = [(math.floor(Fraction(1000 * a * n[lang], counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p))]
                s, k = min(cuts)
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)}
    return out


@pytest.mark.parametrize(("at_once", "bits"), [(1_000_000, 1 << 27), (50, 1 << 10)])
def test_collocations(spark, monkeypatch, at_once, bits):
    monkeypatch.setattr(collocations, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    rng = random.Random(3)
    words = ["of", "the", "New", "York", "ß", "é", "x y", "a-b"]
    texts = ["".join(rng.choices(words, k=1)[0] + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "?!"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " \t ", "in the long run. in the long run; IN the long run", *["same piece of words"] * 9]
    langs = [rng.choice(["en", "de", None, "und"]) for _ in texts]
    got = collocations.collocations(frame(spark, texts, langs).repartition(3), least=6, top=25)
    assert {tuple(r) for r in got.collect()} == collocation_truth(list(zip(langs, texts, strict=True)), 6, 25)
    assert collocations.collocations(frame(spark, ["a b"]).limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    """A phrase of a word said 30,000 times in one piece: the products pass 2^63 in the sum, the quotient is exact."""
    texts = ["lo " * 30_000, "lo hi " * 3_000]
    got = collocations.collocations(frame(spark, texts), top=5)
    assert {tuple(r) for r in got.collect()} == collocation_truth([("en", t) for t in texts], 100, 5)
    row = spark.createDataFrame([(10**13, 3 * 10**13, 10**13 + 1, 10**13 + 7)], "a long, n long, l long, r long")
    a, n, left, right = row.first()
    assert row.selectExpr(collocations.EXACT).first()[0] == 1000 * a * n // (left * right)


# toxicity


def segments_truth(s):
    """Maximal scoring segments from their definition: the best one, then what lies on its two sides."""
    def inside(low, high):
        best = None
        for a in range(low, high):
            if s[a] > 0:
                for b, total in enumerate(accumulate(s[a:high]), a + 1):
                    if best is None or (total, -(b - a)) > (best[0], -(best[2] - best[1])):
                        best = (total, a, b)
        if best is None or best[0] <= 0:
            return []
        return [*inside(low, best[1]), (best[1], best[2], best[0]), *inside(best[2], high)]

    return inside(0, len(s))


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-3.0, -1.5, -0.25, 0.0, 1.0, 2.75, 4.125]) + rng.random() / 64 for _ in range(rng.randint(0, 25))]
        got = toxicity.segments(np.array(s))
        want = segments_truth(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for _, _, x in got], [x for _, _, x in want])


def test_segments_take_linear_time():
    s = np.tile([1.0, -0.5, 0.25, -0.5], 250_000)
    assert len(toxicity.segments(s)) > 0
    assert len(toxicity.segments(np.tile([1.0, -1.5], 500_000))) == 500_000


def toxic_corpus(rng, n):
    plain, bad = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi") for b in ("lo", "ma", "ne", "pi", "ru", "sta")], ["slurry", "vilexa", "vilexo", "vilexi"]
    texts, toxic = [], []
    for i in range(n):
        w = rng.choices(plain, k=rng.randint(20, 120))
        if i % 6 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        toxic.append(int(i % 6 == 0))
    return texts, toxic


def test_toxicity_on_held_out_rows(spark):
    texts, toxic = toxic_corpus(random.Random(4), 1200)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*texts, None, "", "...", "vilexu vilexe slurry slurry balo coma"])
    rows = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [i for i in range(1200) if rows[i].held_out]
    assert 200 < len(held) < 400
    assert sum(rows[i].predicted == toxic[i] for i in held) >= 0.98 * len(held)
    assert rows[1200].score == rows[1201].score == rows[1202].score < 0.3 and rows[1203].predicted == 1  # other words of the same stem
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_toxic_passages_have_their_words(spark):
    texts, toxic = toxic_corpus(random.Random(4), 1200)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark, texts), labels)
    text = " ".join(["balo"] * 100 + ["slurry", "Vilexa", "slurry"] + ["coma"] * 100)
    got = toxicity.toxic_passages(frame(spark, [text, "balo coma"]), model).collect()
    assert [(r.row.doc_id, r.first, r.past, r.text) for r in got] == [(0, 100, 103, "slurry vilexa slurry")]


@pytest.mark.parametrize("rows", [[], [(0, 0, 0), (1, 1, 0)], [(0, 1, None), (None, 1, 1)]])
def test_toxicity_without_labels_of_both_kinds(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = toxicity.classify(frame(spark, ["a b", None, "c"], ids=[0, 1, None]), labels).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
    assert toxicity.classify(frame(spark, ["a"]).limit(0), labels).collect() == []
