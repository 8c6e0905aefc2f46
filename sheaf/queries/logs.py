"""Sanitising, redaction, outboxes and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.records import checked_json, hmac_sha256, redact_json
from ..operators import sinks
from ..session import new_path
from .registry import Tables, query


@query(r"select doc_id, left(regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), 2000) as line from documents")
def log_sanitise(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.log_line(F.concat(F.lit("\x1b[31m"), F.col("text"))).alias("line"))


@query(r"""select event_id, '{   "user": ' || user_id || ',   "kind": "' || event_type || '" }' as line from events""")
def object_line(t: Tables) -> DataFrame:
    line = X.object_line(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")))
    return t.events.select("event_id", line.alias("line"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""
    with e as (select event_id, case event_id % 5 when 0 then left(props, 4) when 1 then null else props end as raw from events)
    select event_id, case when json_valid(raw) then cast(json_extract_string(raw, '$.k') as bigint) end as k, case when not json_valid(raw) then 'invalid JSON' end as error from e
""")
def json_errors(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).when(F.col("event_id") % 5 != 1, F.col("props"))
    return t.events.select("event_id", checked_json(raw, "k bigint").alias("c")).select("event_id", "c.value.k", "c.error")


@query(r"""
    select event_id, '{"id":' || event_id || ',"inner":{"authToken":"' || left(event_type, 8) || '...' || right(event_type, 4) || '","note":' || cast(to_json(props) as varchar) || '},"password":"[REDACTED]"}' as record from events
""")
def redact(t: Tables) -> DataFrame:
    record = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("authToken"), F.col("props").alias("note")).alias("inner"), F.lit("x").alias("password")))
    return t.events.select("event_id", redact_json(partial_tokens=True)(record).alias("record"))


def _hmac_sql(secret: str, message: str) -> str:
    """The keyed digest from its definition: two nested hashes over the padded key."""
    padded = secret.encode().ljust(64, b"\0")
    blob = lambda mask: "".join(f"\\x{x ^ mask:02X}" for x in padded)
    return f"sha256('{blob(0x5C)}'::blob || unhex(sha256('{blob(0x36)}'::blob || encode({message}))))"


@query(f"select event_id, {_hmac_sql('secret', 'event_type')} as digest from events")
def hmac_hex(t: Tables) -> DataFrame:
    return t.events.select("event_id", hmac_sha256(F.lit("secret"), F.col("event_type")).alias("digest"))


def _hooks(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(i, f"https://hook.example.net/{i}", f"s{i}") for i in range(3)], "session_id bigint, url string, secret string")


_SIGN = "'sha256=' || case session_id when 0 then " + " ".join(f"{_hmac_sql(f's{i}', 'payload')}" + (f" when {i + 1} then" if i < 2 else " end") for i in range(3)) + " as signature"


@query(f"""
    with e as (select user_id % 5 as session_id, event_id, '{{"session_id":' || (user_id % 5) || ',"item_id":' || event_id || ',"status":"' || case event_type when 'error' then 'failed","error":"timeout: late"' when 'view' then 'skipped"'
                      else 'completed","scraped_data":"{{\\"k\\":1}}"' end || '}}' as payload from events where user_id % 5 < 3)
    select session_id, 'item-complete' as kind, payload, {_SIGN} from e
""")
def item_events(t: Tables) -> DataFrame:
    return _item_outbox(t.events, t).select("session_id", "kind", "payload", "signature")


@query("""
    with i as (select c_custkey % 5 as session_id, string_agg('{"item_id":' || c_custkey || ',"name":"' || c_name || '"}', ',' order by c_custkey) as items from customer group by 1),
    s as (select n as session_id, p as phase from range(5) r(n), (values ('parsing'), ('queueing')) v(p))
    select s.session_id, '{"session_id":' || s.session_id || ',"phase":"' || phase || '","message":"now ' || phase || '"' || case when phase = 'queueing' and items is not null then ',"items":[' || items || ']' else '' end || '}' as payload
    from s left join i on i.session_id = s.session_id where s.session_id < 3
""")
def phase_events(t: Tables) -> DataFrame:
    steps = t.spark.range(5).select(F.col("id").alias("session_id"), F.explode(F.array(F.lit("parsing"), F.lit("queueing"))).alias("phase")).withColumn("message", F.concat(F.lit("now "), "phase"))
    items = t.customer.select((F.col("c_custkey") % 5).alias("session_id"), F.col("c_custkey").alias("item_id"), F.col("c_name").alias("name"))
    return sinks.phase_events(steps, _hooks(t), items).select("session_id", "payload")


@query("""
    select c_custkey % 5 as session_id, '{"session_id":' || (c_custkey % 5) || ',"lists":[' || string_agg('{"list_id":' || c_custkey || ',"name":"' || c_name || '"}', ',' order by c_custkey) || ']}' as payload
    from customer where c_custkey % 5 < 3 group by c_custkey % 5
""")
def lists_events(t: Tables) -> DataFrame:
    lists = t.customer.select((F.col("c_custkey") % 5).alias("session_id"), F.col("c_custkey").alias("list_id"), F.col("c_name").alias("name"))
    return sinks.lists_events(lists, _hooks(t)).select("session_id", "payload")


@query("""
    select event_id, case when event_id % 4 < 3 and event_id % 5 in (0, 1, 4) then case when event_id % 5 = 1 then 7000 else cast(1000 * pow(2, event_id % 4) as bigint) end end as retry_ms from events
""")
def webhook_retry(t: Tables) -> DataFrame:
    e = F.col("event_id")
    status = F.when(e % 5 == 0, 429).when(e % 5 == 1, 503).when(e % 5 == 2, 200).when(e % 5 == 3, 404)
    return t.events.select("event_id", sinks.retry_at_ms(status, e % 4, F.when(e % 5 == 1, 7)).alias("retry_ms"))


@query("select event_id, '[' || event_type || ']' as line from events")
def appended_lines(t: Tables) -> DataFrame:
    """Lines appended in two runs, read back."""
    path = new_path(t.spark, "lines")
    rows = t.events.select("event_id", F.concat(F.col("event_id").cast("string"), F.lit(" ["), "event_type", F.lit("]")).alias("line"))
    for k in (0, 1):
        sinks.append_lines(rows.where(F.col("event_id") % 2 == k), path)
    cut = F.split("value", " ", 2)
    return t.spark.read.text(path).select(cut[0].cast("bigint").alias("event_id"), cut[1].alias("line"))


@query("""select user_id % 5 as session_id, 'item-complete' as kind, '{"session_id":' || (user_id % 5) || ',"item_id":' || event_id || '}' as payload from events where event_type = 'purchase' and user_id % 5 < 3""")
def outbox(t: Tables) -> DataFrame:
    rows = t.events.where("event_type = 'purchase'").select((F.col("user_id") % 5).alias("session_id"), F.col("event_id").alias("item_id"))
    return sinks.outbox(rows, _hooks(t), "item-complete").select("session_id", "kind", "payload")


@query("select event_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(epoch_us(ts) // 1000 % 1000 as varchar), 3, '0') || 'Z] [ENRICHMENT] ' || upper(event_type) || ' itemId=' || user_id || ' ' || props as line from events")
def log_lines(t: Tables) -> DataFrame:
    return t.events.select("event_id", sinks.event_line(F.col("ts"), F.col("event_type"), F.col("user_id"), F.col("props")).alias("line"))


@query("select event_id, event_type, value from events")
def jsonl_roundtrip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "log")
    rows = t.events.select("event_id", "event_type", "value")
    sinks.append_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query("select count(*) filter (event_type <> 'error') as succeeded, count(*) filter (event_type = 'error') as failed from events")
def audit_outcomes(t: Tables) -> DataFrame:
    return sinks.success_counts(t.events.select((F.col("event_type") != "error").alias("ok")))


@query("""
    with recursive a as (select user_id % 5 as session_id, event_id % 300 as event_id, row_number() over (partition by user_id % 5, event_id % 300 order by ts, event_id) - 1 as attempt,
                                case event_type when 'error' then 429 when 'view' then 503 when 'click' then null when 'signup' then 404 else 200 end as status, case when event_type = 'error' and event_id % 2 = 0 then 7 end as after from events),
    r as (select session_id, event_id, attempt, status, after, 0::bigint as sent_at_ms from a where attempt = 0
          union all
          select a.session_id, a.event_id, a.attempt, a.status, a.after, r.sent_at_ms + coalesce(r.after * 1000, cast(1000 * pow(2, r.attempt) as bigint)) from r join a on a.session_id = r.session_id and a.event_id = r.event_id and a.attempt = r.attempt + 1
          where r.attempt < 3 and (r.status is null or r.status = 429 or r.status >= 500))
    select session_id, event_id, attempt, status, sent_at_ms,
           case when attempt < 3 and (status is null or status = 429 or status >= 500) then 'retry' when status between 200 and 299 then 'delivered' else 'given_up' end as outcome from r
""")
def webhook_deliveries(t: Tables) -> DataFrame:
    attempt = F.row_number().over(Window.partitionBy("session_id", "event_id").orderBy("ts", "seq")) - 1
    status = F.expr("case event_type when 'error' then 429 when 'view' then 503 when 'click' then null when 'signup' then 404 else 200 end")
    later = F.when((F.col("event_type") == "error") & (F.col("seq") % 2 == 0), 7)
    rows = t.events.select((F.col("user_id") % 5).alias("session_id"), "ts", F.col("event_id").alias("seq"), "event_type", status.alias("status")).withColumn("retry_after_s", later).withColumn("event_id", F.col("seq") % 300)
    return sinks.delivery_attempts(rows.withColumn("attempt", attempt))


@query(f"""
    with e as (select user_id % 5 as session_id, event_id, '{{"session_id":' || (user_id % 5) || ',"item_id":' || event_id || ',"status":"' || case event_type when 'error' then 'failed","error":"timeout: late"' when 'view' then 'skipped"'
                      else 'completed","scraped_data":"{{\\"k\\":1}}"' end || '}}' as payload from events where user_id % 5 < 3)
    select session_id, 'item-complete' as kind, payload, {_SIGN} from e
""")
def stream_outbox(t: Tables) -> DataFrame:
    """The outbox as a stream of all events, one of whose batches ran twice."""
    path, check = new_path(t.spark, "outbox"), new_path(t.spark, "outbox-check")
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    key = ["session_id", "payload"]
    sinks.stream_outbox(_item_outbox(source, t), path, check, key).awaitTermination()
    sinks.put_batch(_item_outbox(t.events, t), 0, path, key)
    return t.spark.read.parquet(path).select("session_id", "kind", "payload", "signature")


def _item_outbox(events: DataFrame, t: Tables) -> DataFrame:
    status = F.expr("case event_type when 'error' then 'failed' when 'view' then 'skipped' else 'completed' end")
    rows = events.select((F.col("user_id") % 5).alias("session_id"), F.col("event_id").alias("item_id"), status.alias("status"), F.lit("timeout").alias("error_kind"), F.lit("late").alias("error"), F.lit('{"k":1}').alias("data"))
    return sinks.item_events(rows, _hooks(t))
