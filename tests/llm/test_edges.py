"""Every operator and stage on empty tables, nulls, repeated rows and columns whose names clash with its own."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from sheaf.llm import common, decontaminate, exact_dedup, lm_score, mixing, near_dedup, quality, sharding, substring_dedup, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "size long, key long, shard int, slot long, n long, band long, words string, start long, k long, score double, predicted int, copies long, spans string, row string, component string, label string"
NAMES = [c.split()[0] for c in CLASH.split(", ")]
LONG = " ".join(f"w{i % 977}" for i in range(20_000))


def messy(spark):
    body = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(0, None, "en", None, 0), (1, "", None, "a", 0), (2, body, "en", "a", 3), (2, body, "en", "a", 3), (3, body + " ", "en", "b", 3), (4, LONG, "en", "b", 9), (5, " \n\t ", "en", None, 1), (6, "é ß", "fr", "c", 2), (7, "a" * 300, "en", "c", 2)]
    table = spark.createDataFrame(rows, DOCS)
    for c in CLASH.split(", "):
        name, kind = c.split()
        table = table.selectExpr("*", f"cast('1' as {kind}) as {name}")
    return table


def benchmark(spark, rows=((1, "Five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (2, None), (None, "é, ß!"), (4, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, rows=((2, 1, 0), (4, 0, 0), (4, None, 0), (None, 1, 0), (6, 1, 0), (7, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "lm_score": lambda s, d: lm_score.pseudo_likelihood(d),
    "near_dedup": lambda s, d: near_dedup.near_duplicates(d),
    "decontaminate": lambda s, d: decontaminate.judge(d, benchmark(s)),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d),
    "substring_dedup": lambda s, d: substring_dedup.substring_dedup(d),
    "quality": lambda s, d: quality.classify(d, labels(s)),
    "sharding": lambda s, d: sharding.shard_documents(d),
    "mixing": lambda s, d: mixing.draw_copies(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_out_per_row_in(spark, name):
    run = OPERATORS[name]
    rows = run(spark, messy(spark)).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 2, 3, 4, 5, 6, 7]
    assert run(spark, messy(spark).limit(0)).collect() == []


def test_exact_dedup_groups_null_with_empty(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(messy(spark)).collect()}
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (0, 2, False)
    assert got[2].group_size == 2 and got[2].kept and got[3].group_size == 1


def test_near_dedup_leaves_empty_texts_alone(spark):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(messy(spark)).collect()}
    assert got[3].component_id == 2 and not got[3].kept
    assert all(got[i].kept and got[i].n_shingles == 0 for i in (0, 1, 5))


def test_decontaminate_judges_and_cuts(spark):
    got = {r.doc_id: r for r in decontaminate.judge(messy(spark), benchmark(spark)).collect()}
    assert (got[6].n_hit, got[6].n_items, got[6].contaminated) == (2, 0, True)
    assert not got[0].contaminated and got[2].n_hit == 0
    item = benchmark(spark, [(1, "five SIX seven")])
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(messy(spark), item, "span").collect()}
    assert cut[2].startswith("one two three four eight nine") and cut[0] is None and cut[6] == "é ß"
    assert {r.doc_id for r in decontaminate.decontaminate(messy(spark), item).collect()} == {0, 1, 4, 5, 6, 7}


def test_quality_without_labels_is_one_score(spark):
    rows = quality.classify(messy(spark), labels(spark).limit(0)).collect()
    assert len({r.score for r in rows}) == 1


def test_url_filter(spark):
    urls = [(1, "http://a.EXAMPLE.net/en/1"), (2, "https://net"), (3, None), (4, "x"), (5, "http://example.com/de/?q"), (6, "ftp://w.org/fr/#x"), (7, "http://subnet/"), (1, "http://b.net/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule", "1 as key")
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in url_filter.filter_urls(pages, url_filter.default_rules(spark)).collect())
    assert got == [(1, "example.net/en/", "allow"), (1, "net/", "block"), (2, "", "allow"), (3, "", "allow"), (4, "", "allow"), (5, "example.com/de/", "block"), (6, "org/fr/", "allow"), (7, "", "allow")]
    assert url_filter.filter_urls(pages.limit(0), url_filter.default_rules(spark)).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(pages, url_filter.default_rules(spark).limit(0)).collect()} == {"allow"}


def test_warc_round_trip(spark, tmp_path):
    page = "<html>" + "x" * 200
    rows = [(1, "http://a.net/ b\r\nX: y", page), (2, None, page), (3, "http://c.net", None), (4, "http://d.net", ""), (5, "http://e.net", "short"), (6, "http://f.net", "short"), (2, None, page), (None, "http://g.net", "é" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "'z' as refers_to")
    got = sorted(warc.archive_and_read(pages.drop("refers_to")).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got] == [(None, "response", None, 200), (1, "response", None, 206), (2, "revisit", 1, 206), (2, "revisit", 1, 206), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 5), (6, "response", None, 5)]
    assert bytes(got[1].payload) == page.encode() and got[2].payload is None and got[1].url == "http://a.net/%20b%0D%0AX:%20y"
    assert warc.archive_and_read(pages.drop("refers_to").limit(0)).collect() == []


def test_warc_keeps_every_payload_of_a_repeated_id(spark):
    a, b = "A" * 150, "B" * 150
    pages = spark.createDataFrame([(1, "u", a), (2, "u", a), (2, "u", b), (4, "u", b), (2, "u", b)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect())
    da, db = (hashlib.sha256(x.encode()).hexdigest() for x in (a, b))
    assert got == sorted([(1, da, "response", None), (2, da, "revisit", 1), (2, db, "response", None), (2, db, "response", None), (4, db, "revisit", 2)], key=lambda r: r[:3])


@pytest.mark.parametrize("rows", [9, 0])
def test_pipeline_stages(spark, tmp_path, rows):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = messy(spark).limit(rows)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.collect()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {"doc_id", "text", "shard", "slot"} <= set(last.columns) and last.count() == rows


@pytest.mark.parametrize("base", [2**53, 2**62, -(2**62)])
def test_archives_keep_large_ids(spark, base):
    rows = [(base + 1, "a" * 120), (base + 3, "a" * 120), (None, "b" * 120), (base + 2, "b" * 120), (base + 5, "c"), (None, None)]
    pages = spark.createDataFrame([(i, "https://a.example/", h) for i, h in rows], "page_id long, url string, html string").coalesce(1)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()), key=str)
    want = [(base + 1, "response", None), (base + 3, "revisit", base + 1), (None, "response", None), (base + 2, "response", None), (base + 5, "response", None), (None, "response", None)]
    assert got == sorted(want, key=str)


def test_archives_refuse_text_ids(spark):
    with pytest.raises(ValueError, match="whole number"):
        warc.archive_and_read(spark.createDataFrame([("x", "u", "h")], "page_id string, url string, html string"))


def test_odd_columns_go_through_every_stage(spark, tmp_path):
    """Maps at any depth, dots, backticks and names that differ in case alone from those that a stage adds."""
    texts = [f"text number {i} has words of its own like w{i} v{i} u{i} and t{i}." for i in range(8)]
    rows = [(i, t, "en", "s", len(t), [{"a": i}, {}], {"m": {"x": 1.5}}, ({"k": "v"}, None), None, i, i) for i, t in enumerate(texts)]
    schema = f"{DOCS}, deep array<map<string,int>>, nested map<string,map<string,double>>, holder struct<m: map<string,string>, `a.b`: int>, `meta.lang` string, `tick``s` int, Shard int"
    docs = spark.createDataFrame(rows, schema)
    (tmp_path / "x").mkdir()
    labels(spark).write.parquet(f"{tmp_path}/x/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/x/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{tmp_path}/x")
        kept = [c for c in docs.columns if c != "Shard"]
        assert [c for c in out.columns if c.lower() not in ("shard", "slot")] == kept, name
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        if name != "mixing":
            assert out.count() == (8 if name != "quality classifier" else out.count())
    assert len({tuple(r) for r in docs.select(*common.row_key(docs)).collect()}) == 8
