"""Operators on small inputs whose results plain Python tells."""

from __future__ import annotations

import hashlib
import hmac
import json
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.functions import dates, rules
from sheaf.functions.records import hmac_sha256, redact_json
from sheaf.operators import fields, generic, lists, pacing, sessions, sinks
from sheaf.plans import enrichment, order
from sheaf.queries.sessions import entry_log, outcomes, session_events
from sheaf.sources import catalog, dom, inventory, page_table
from sheaf.streaming import folds, states

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def three_files(spark, tmp_path_factory):
    """Events in three files, each later than the one before, written in that order."""
    path = str(tmp_path_factory.mktemp("stream") / "events.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    a, b = events.selectExpr("percentile(unix_micros(cast(ts as timestamp)), array(0.33, 0.66))").first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for k, part in enumerate((at < a, (at >= a) & (at < b), at >= b)):
        events.where(part).coalesce(1).write.mode("append" if k else "overwrite").parquet(path)
    return path


def test_streams_agree_with_batches_over_three_files(spark, three_files):
    events = spark.read.parquet(three_files)
    assert len(events.inputFiles()) == 3
    rows = lambda df: sorted(map(tuple, df.collect()))
    stream = folds.replay(spark, three_files, lambda s: folds.adaptive_delay(outcomes(s), "user_id"), "user_id", per_batch=1)
    assert rows(stream) == rows(pacing.adaptive_delay(outcomes(events), "user_id"))
    stream = folds.replay(spark, three_files, lambda s: folds.session_states(session_events(s)), "session_id", per_batch=1)
    assert rows(stream) == rows(sessions.session_states(session_events(events)).select("session_id", "failures", "is_paused", "pauses"))


def test_adaptive_delay_carries_a_key_across_batches(spark):
    rng = random.Random(2)
    log = [(k, datetime(2024, 1, 1), i, rng.choice(["success", "success", "success", "rate_limited", "other"])) for k in range(3) for i in range(4000)]
    truth = {}
    for k, _, _, outcome in log:
        truth[k] = pacing.paced(truth.get(k, (2067.0, 0, 0)), outcome)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "900")
    got = {r[0]: tuple(r)[1:] for r in pacing.adaptive_delay(spark.createDataFrame(log, "key long, ts timestamp, seq long, outcome string").orderBy(F.rand(1)), "key").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == truth
    assert pacing.adaptive_delay(spark.createDataFrame([], "key long, ts timestamp, seq long, outcome string"), "key").collect() == []


def test_blocks_of_pacing_compose(spark):
    """Any cut of a log into blocks gives what outcome after outcome gives, whether delays have met in a block or not."""
    rng = random.Random(5)
    for shape in (["success"], ["success", "rate_limited"], ["success"] * 9 + ["other"], ["success"] * 30 + ["rate_limited"], ["rate_limited", "other"]):
        log = rng.choices(shape, k=3000)
        good, limited = np.array([x == "success" for x in log]), np.array([x == "rate_limited" for x in log])
        truth = state = (2067.0, 0, 0)
        for x in log:
            truth = pacing.paced(truth, x)
        cuts = [0, *sorted(rng.sample(range(1, 3000), 40)), 3000]
        for a, b in zip(cuts, cuts[1:], strict=False):
            state = pacing.after(state, pacing.summary(good[a:b], limited[a:b]))
        assert state == truth


def test_one_hot_key_takes_many_tasks(spark):
    log = spark.range(200_000).selectExpr("1L as key", "timestamp_millis(id) as ts", "id as seq", "case when id % 7 = 3 then 'rate_limited' else 'success' end as outcome")
    parts = pacing.blocks(log, "key").groupBy("range").count().collect()
    assert len(parts) >= 2
    state = (2067.0, 0, 0)
    for i in range(200_000):
        state = pacing.paced(state, "rate_limited" if i % 7 == 3 else "success")
    assert [tuple(r)[1:] for r in pacing.adaptive_delay(log, "key").collect()] == [state]


def test_entries_and_cooldowns_on_streams_over_three_files(spark, three_files):
    states.with_rocksdb(spark)
    events = spark.read.parquet(three_files)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    stream = folds.replay(spark, three_files, lambda s: states.pending_entries(entry_log(s)), ["item_id", "opened"], per_batch=1)
    assert rows(stream) == rows(enrichment.pending_entries(entry_log(events)))
    path = f"{three_files}.clock"
    clock = [(1, 0, 1, "failure"), (1, 1, 2, "failure"), (2, 5, 3, "success"), (2, 30, 4, "success"), (3, 31, 5, "failure")]  # session, second, seq, kind: only others move the clock on
    at = lambda k: datetime(2024, 1, 1, 0, 0, k)
    for k, part in enumerate((clock[:3], clock[3:4], clock[4:])):
        spark.createDataFrame([(i, at(s), n, x) for i, s, n, x in part], "session_id long, ts timestamp, seq long, kind string").coalesce(1).write.mode("append" if k else "overwrite").parquet(path)
    got = {r.session_id: (r.failures, r.is_cooling) for r in folds.replay(spark, path, states.session_cooldowns, "session_id", per_batch=1).collect()}
    assert got == {1: (2, False), 2: (0, False), 3: (1, True)}


def test_an_ended_entry_is_released(spark):
    log = [(1, 1, "request", 7, "COLD", False), (1, 2, "request", 7, "WARM", True), (1, 3, "completed", 0, "COLD", False), (1, 4, "failed", 0, "COLD", False), (1, 5, "request", 8, "COLD", True), (2, 1, "completed", 0, "HOT", False)]
    frame = spark.createDataFrame([(i, datetime(2024, 1, 1, 0, 0, s), s, k, u, lane, c) for i, s, k, u, lane, c in log], "item_id long, ts timestamp, seq long, kind string, user_id long, lane string, has_cookies boolean")
    got = sorted(map(tuple, enrichment.pending_entries(frame).collect()))
    assert got == [(1, 1, "HOT", 1, True, 2, 3), (1, 5, "COLD", 1, True, 1, None)]


def test_retry_rounds_keep_lane_and_age(spark):
    queue = spark.createDataFrame([(1, "COLD", 5), (2, "HOT", 9), (3, "HOT", 1)], "item_id long, lane string, queued_at int")
    tries = [(1, 1, "timeout", False, False), (1, 2, None, False, False), (2, 1, "HTTP 404", False, False), (3, 1, "HTTP 429", False, False), (3, 2, "x", True, True)]
    frame = spark.createDataFrame([(i, datetime(2024, 1, 1), n, e, h, p) for i, n, e, h, p in tries], "item_id long, ts timestamp, seq long, error string, has_session boolean, is_paused boolean")
    got = sessions.retry_rounds(queue, frame, 3, [F.col("queued_at")]).orderBy("round", "position").select("round", "item_id", "lane", "queued_at", "tries", "action").collect()
    assert [tuple(r) for r in got] == [
        (1, 3, "HOT", 1, 0, "requeued"), (1, 2, "HOT", 9, 0, "failed"), (1, 1, "COLD", 5, 0, "requeued"),
        (2, 3, "HOT", 1, 1, "held"), (2, 1, "COLD", 5, 1, "completed"), (3, 3, "HOT", 1, 2, "waiting"),
    ]


def test_a_users_rules_and_tables_of_many_parts(spark, monkeypatch):
    own = spark.createDataFrame([(0, "sculptors?", "skip", "mine", None), (99, r"gloss\s+level", "text", "mine", None)], rules.registry(spark).schema)
    rows = spark.createDataFrame([("Sculptor",), (" GLOSS  level ",), ("artists",), ("",), (None,), ("Sculptor",)], "label string")
    for most in (10_000, 7):
        monkeypatch.setattr(rules, "RULES_AT_ONCE", most)
        got = rules.match_rules(rows, "label", rules.registry(spark).unionByName(own)).collect()
        assert sorted((str(r.label), r.rule and (r.rule.prio, r.rule.category)) for r in got) == sorted([("Sculptor", (0, "mine")), ("Sculptor", (0, "mine")), (" GLOSS  level ", (99, "mine")), ("artists", (2, "artist")), ("", None), ("None", None)])


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Name,Status\n1,one,owned\n")
    (tmp_path / "b.csv").write_text('\n"Status","Adult",Title,"Item ID"\nordered,yes,"two, b",2\nStatus,Adult,Title,Item ID\n')
    (tmp_path / "c.csv").write_text("")
    got = inventory.parse_inventory_files(spark, str(tmp_path)).orderBy("item_id").collect()
    assert [(r.item_id, r.name, r.status, r.is_nsfw) for r in got] == [("1", "one", "owned", None), ("2", "two, b", "ordered", True)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("March 5, 2024", "2024-03-05"), ("5 Mar 2024", "2024-03-05"), ("Tue, Sept. 3 2024", "2024-09-03"), ("March 2024", "2024-03-01"), ("2024/3/5", "2024-03-05"), ("3-5-24", "2024-03-05"), ("3.5.77", "1977-03-05"),
        ("2024-03", "2024-03-01"), ("2024", "2024-01-01"), ("Feb 30, 2023", "2023-03-02"), ("Feb 32, 2023", None), ("13/40/24", None), ("Smarch 1, 2024", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_free_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(dates.free_date(F.col("t")).alias("d")).first().d
    assert (got and got.isoformat()) == want


def test_keyed_digests(spark):
    pairs = [("s", "m"), ("", "é"), ("k" * 100, ""), (None, "m"), ("s", None)]
    rows = spark.createDataFrame(pairs, "s string, m string").select("s", "m", hmac_sha256(F.col("s"), F.col("m")).alias("d")).collect()
    for r in rows:
        assert r.d == (None if r.s is None or r.m is None else hmac.new(r.s.encode(), r.m.encode(), hashlib.sha256).hexdigest())


def test_redaction_at_any_depth(spark):
    texts = [json.dumps({"a": [{"apiKey": "x", "b": {"Password": "y", "n": 1}}], "token": "abcdefghijklmnop", "secret": "", "key": 5}), "no json", None]
    rows = [spark.createDataFrame([(t,) for t in texts], "t string").select(redact_json(partial)("t").alias("r")).collect() for partial in (False, True)]
    full, part = (json.loads(r[0].r) for r in rows)
    assert full == {"a": [{"apiKey": "[REDACTED]", "b": {"Password": "[REDACTED]", "n": 1}}], "token": "[REDACTED]", "secret": "", "key": 5}
    assert part["token"] == "abcdefgh...mnop" and [r.r for r in rows[0][1:]] == [None, None]


def plain_fields(line):
    """Cut at the quotes, every second piece is quoted; nothing between two quoted pieces is a quote of its own."""
    pieces, fields = line.split('"'), [""]
    for k, piece in enumerate(pieces):
        if k % 2:
            fields[-1] += piece
        elif not piece and 0 < k < len(pieces) - 1:
            fields[-1] += '"'
        else:
            first, *more = piece.split(",")
            fields[-1] += first
            fields += more
    return [f.strip() for f in fields]


def test_fields_of_lines(spark):
    rng = random.Random(7)
    lines = ["", ",", 'a,"b,c",d', '"x""y",z', 'a"b,c"d,e', '"open,end', " a , b ", '""', '"a"b"c,d"'] + ["".join(rng.choices('ab ,"', k=rng.randint(0, 14))) for _ in range(1500)]
    rows = spark.createDataFrame([(x,) for x in lines], "value string").select("value", inventory.split_fields(F.col("value")).alias("f")).collect()
    assert {r.value: r.f for r in rows} == {x: plain_fields(x) for x in lines}


def test_a_long_line_is_split_in_linear_time(spark):
    line = ",".join(f'"a,{i}"' for i in range(9_000))
    assert spark.createDataFrame([(line,)], "value string").select(F.size(inventory.split_fields(F.col("value")))).first()[0] == 9_000


def test_the_header_is_the_first_line_of_the_first_file(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text(("\nTitle,ID,Owned?\n" if k == 0 else "") + f'"N, {k}",{k + 1},yes owned\nbad,x,\n')
    rows = inventory.parse_inventory(inventory.read_lines(spark, str(tmp_path))).orderBy("item_id").collect()
    assert [(r.item_id, r.name, r.status) for r in rows] == [("1", "N, 0", "owned"), ("2", "N, 1", "owned"), ("3", "N, 2", "owned")]
    with pytest.raises(ValueError):
        inventory.parse_inventory(spark.createDataFrame([("ID",)], "value string"))


def test_plans(spark):
    items = spark.createDataFrame([("1", "owned", True), ("2", "wished", None), ("3", "ordered", False)], "item_id string, status string, is_nsfw boolean")
    lane = lambda df: {r.item_id: r.lane for r in df.collect()}
    assert lane(enrichment.plan_from_inventory(items)) == {"1": "HOT", "2": "COLD", "3": "WARM"}
    named = spark.createDataFrame([(3,), (9,)], "item_id long")
    activity = spark.createDataFrame([("3", "ordered", 4)], "item_id string, status string, activity_order int")
    assert lane(enrichment.plan_full(items, activity, named, [])) == {"9": "COLD"}
    now = F.lit("2024-02-01").cast("timestamp")
    cached = spark.createDataFrame([("1", datetime(2024, 1, 31, 23), None), ("3", datetime(2020, 1, 1), None)], "item_id string, cached_at timestamp, release date")
    assert lane(enrichment.plan_full(items, activity, named, None, cached, now)) == {"2": "COLD", "3": "WARM", "9": "COLD"}


def test_numbering_by_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    got = order.numbered(rows, ["g"], [F.desc("v")], "n").collect()
    for g in range(3):
        mine = sorted((r for r in got if r.g == g), key=lambda r: -r.v)
        assert [r.n for r in mine] == list(range(len(mine)))


PAGE = """<html><body><h1> H </h1><div class="data-field"><div class="data-label">Character</div><div class="data-value"><div class="item-entries"><span switch="a"> Rei </span></div></div></div>
<div class="data-field"><div class="data-label">Title</div><div class="data-value"><a switch="x">T1</a></div></div><div class="data-field"><div class="data-label">Title</div><div class="data-value"><a switch="x"></a></div></div>
<div class="data-field"><div class="data-value">none</div></div><p class="a b">one<p id="q">two &amp; <b>three</b></body></html>"""


def test_a_page_is_parsed_once_and_read_by_all_parts(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    config = generic.SITES["catalog"]
    records = generic.records(pages, config)
    assert records._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.page_id: r.name for r in generic.extract(records, config).collect()}
    assert got == {1: "Rei", 2: None, 3: None}
    row = fields.catalog_fields(fields.field_table(catalog.with_fields(pages))).first()
    assert (row.page_id, row.title) == (1, "T1")
    record = generic.extract_catalog(pages)
    assert "MapInArrow" not in record._jdf.queryExecution().executedPlan().toString() and record.count() == 3


@pytest.mark.parametrize("css, text", [("h1", " H "), ("p.b.a", "one"), ("#q b", "three"), ('p[id^="q"]', "two & three"), ('.gone, [id="q"]', "two & three"), (".data-field .data-field", None)])
def test_selectors_agree_in_both_forms(spark, css, text):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    found = dom.with_records(pages, lambda page: {"n": len(page.nodes)}, "n int", {"x": (css, None)}).first().found.x
    column = dom.with_nodes(pages).select(dom.text("nodes", dom.first(generic.select("nodes", css)))).first()[0]
    assert found == text and column == (text and text.strip())


def test_selectors_that_are_not_understood(spark):
    for css in ("a > b", "", "a::x"):
        with pytest.raises(ValueError):
            dom.selector_parts(css)


def test_markup_inside_a_node(spark):
    page = dom.Page('<div id="d">a <b class="x y">b &lt; c</b><br><i>d</div>')
    assert page.inner(page.nodes[0]) == 'a <b class="x y">b &lt; c</b><br><i>d</i>' and page.inner(None) is None


def test_lists_keep_their_header_without_details(spark):
    overview = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "list_id long, name string")
    details = spark.createDataFrame([(1, "d"), (2, None)], "list_id long, description string")
    items = spark.createDataFrame([(1, 2, 20, "y", None), (1, 1, 10, "x", "u"), (1, 3, None, "z", None)], "list_id long, pos int, item_id long, name string, image_url string")
    got = {r.list_id: (r.description, r.item_ids) for r in lists.with_details(overview, details, items).collect()}
    assert got == {1: ("d", [10, 20]), 2: (None, []), 3: (None, None)}


def test_an_outbox_batch_that_runs_twice_leaves_each_event_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "session_id long, payload string")
    for number, part in ((0, rows), (1, rows.where("session_id = 2").withColumn("payload", F.lit("c"))), (0, rows)):
        sinks.put_batch(part, number, str(tmp_path / "out"), ["session_id", "payload"])
    got = sorted((r.session_id, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (2, "c")]


def test_delivery_attempts_end_where_an_answer_is_final(spark):
    answers = [(1, 0, 503, None), (1, 1, 429, 7), (1, 2, None, None), (1, 3, 500, None), (1, 4, 200, None), (2, 0, 404, None), (2, 1, 200, None), (3, 0, 204, None)]
    frame = spark.createDataFrame([(9, e, a, s, r) for e, a, s, r in answers], "session_id long, event_id long, attempt int, status int, retry_after_s int")
    got = sorted((r.event_id, r.attempt, r.sent_at_ms, r.outcome) for r in sinks.delivery_attempts(frame).collect())
    assert got == [(1, 0, 0, "retry"), (1, 1, 1000, "retry"), (1, 2, 8000, "retry"), (1, 3, 12000, "given_up"), (2, 0, 0, "given_up"), (3, 0, 0, "delivered")]


def test_a_table_function_over_pages(spark):
    page_table.register(spark)
    spark.createDataFrame([(1, "<ul><li><a href='/x'>one</a><li>two</ul>"), (2, None), (3, "")], "page_id long, html string").createOrReplaceTempView("some_pages")
    got = spark.sql("select page_id, ord, tag, text, link from some_pages, lateral page_matches(html, 'a, li') order by page_id, ord").collect()
    assert [tuple(r) for r in got] == [(1, 0, "li", "one", None), (1, 1, "a", "one", "/x"), (1, 2, "li", "two", None)]


def test_pages_of_sites_and_programs_of_their_own(spark):
    html = "<h1>Head</h1><h2 class='own'>Own</h2><img src='/a.jpg'>"
    pages = spark.createDataFrame([(1, "article", html), (2, "mine", html), (3, "none", html), (4, None, None)], "page_id long, site string, html string")
    own = spark.createDataFrame([("mine", "img", None, "h2.own", None, None), ("article", "img", None, "h1", None, None)], generic.SITES_SCHEMA)
    got = generic.extract_by_site(generic.records_by_site(pages, generic.with_sites(generic.site_configs(spark), own))).collect()
    assert sorted((r.page_id, r.name) for r in got) == [(1, "Head"), (2, "Own"), (3, None), (4, None)]


def test_history_survives_a_new_validation(spark):
    old = spark.createDataFrame([(1, 10, 1, 2, 5), (2, 10, 1, 0, None)], "session_id long, validated_at int, auth_errors long, failures long, last_failure int")
    got = sessions.surviving(old, spark.createDataFrame([(1, 12), (1, 20), (3, 7)], "session_id long, ts int")).orderBy("session_id").collect()
    assert [tuple(r) for r in got] == [(1, 20, 0, 2, 5), (2, 10, 1, 0, None), (3, 7, 0, 0, None)]


def test_phrases_match_as_far_as_edits_may_go(spark):
    def share(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return (max(len(a), len(b)) - row[-1]) / max(len(a), len(b))

    rng, phrase = random.Random(8), "just a moment"
    texts = ["", phrase, f"x {phrase} y", "just a momenta", "bust a"] + ["".join(c if rng.random() > 0.2 else rng.choice("xy ") for c in phrase)[: rng.randint(8, 13)] + "z" * rng.randint(0, 4) for _ in range(300)]
    for least in (0.7, 0.8):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.phrase_match(F.col("t"), phrase, least).alias("m")).collect()
        assert {r.t: r.m for r in got} == {t: bool(t) and (phrase in t or share(t, phrase) >= least) for t in texts}
