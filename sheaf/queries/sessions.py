"""Pacing and sessions: the batch folds, and the same folds over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import pacing
from ..operators import sessions as S
from ..plans import enrichment as P
from ..streaming import folds, states
from .plan import _REQUESTS, _now as _queue_time, _requests
from .registry import Tables, query


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def outcomes(events: DataFrame) -> DataFrame:
    kind = F.expr("case when event_type = 'error' then if(event_id % 2 = 0, 'rate_limited', 'other') else 'success' end")
    return events.select("user_id", "ts", F.col("event_id").alias("seq"), kind.alias("outcome"))


def session_events(events: DataFrame) -> DataFrame:
    kind = F.expr("case when event_type in ('error', 'click') then 'failure' when event_id % 10 = 0 then 'resume' else 'success' end")
    return events.select((F.col("user_id") % 40).alias("session_id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))


_PACED = """
    with recursive o as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, case when event_type = 'error' then case when event_id % 2 = 0 then 'rate_limited' else 'other' end else 'success' end as outcome from events),
    f as (select user_id, 0 as k, 2067.0::double as delay, 0 as streak from (select distinct user_id from events)
          union all
          select f.user_id, o.k, case when outcome = 'success' and streak = 2 then greatest(274.0, floor(delay / 1.4)) when outcome = 'rate_limited' then least(180000.0, delay * 1.4) else delay end,
                 case when outcome = 'success' and streak < 2 then streak + 1 else 0 end from f join o on o.user_id = f.user_id and o.k = f.k + 1)
    select user_id, round(max_by(delay, k), 3) as delay_ms, max_by(streak, k) as streak, max(k) as n from f group by user_id
"""


@query(_PACED)
def adaptive_delay(t: Tables) -> DataFrame:
    return pacing.adaptive_delay(outcomes(t.events), "user_id").withColumn("delay_ms", F.round("delay_ms", 3))


_SESSIONS = """
    with e as (select user_id % 40 as session_id, ts, event_id as seq, case when event_type in ('error', 'click') then 'failure' when event_id % 10 = 0 then 'resume' else 'success' end as kind from events),
    r as (select *, sum(case when kind = 'failure' then 0 else 1 end) over (partition by session_id order by ts, seq) as run from e),
    f as (select *, count(*) filter (kind = 'failure') over (partition by session_id, run order by ts, seq) as failures, row_number() over (partition by session_id order by ts, seq) as k from r),
    s as (select session_id, max_by(failures, k) as failures, coalesce(max(k) filter (kind = 'failure' and failures >= 3), 0) > coalesce(max(k) filter (kind = 'resume'), 0) as is_paused, max(ts) filter (kind = 'failure') as last_failure,
                 count(*) filter (kind = 'failure' and failures >= 3) as pauses from f group by session_id)
"""


@query(_SESSIONS + "select session_id, failures, is_paused, pauses from s")
def session_pause(t: Tables) -> DataFrame:
    return S.session_states(session_events(t.events)).drop("last_failure")


@query(_SESSIONS + "select count(*) as sessions, count(*) filter (is_paused) as paused, count(*) filter (20000 - (epoch_ms(timestamp '2024-01-31') - epoch_ms(last_failure)) > 0) as cooling from s")
def session_stats(t: Tables) -> DataFrame:
    return S.session_stats(S.session_states(session_events(t.events)), _now())


_VALIDATED = "with v as (select user_id as session_id, max(ts) as validated_at, count(*) filter (event_type = 'error') % 4 as auth_errors from events group by user_id)"


def _validated(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("validated_at"), (F.count_if(F.col("event_type") == "error") % 4).alias("auth_errors"))


@query(_VALIDATED + "select arg_min(session_id, struct_pack(a := validated_at, b := session_id)) as session_id from v")
def evict_oldest(t: Tables) -> DataFrame:
    return S.oldest_session(_validated(t))


@query(_VALIDATED + "select session_id from v order by validated_at desc, session_id limit 100")
def session_cache(t: Tables) -> DataFrame:
    return S.kept_sessions(_validated(t)).select("session_id")


@query(_VALIDATED + "select session_id, epoch_ms(timestamp '2024-01-30 00:05:00') - epoch_ms(validated_at) < 600000 and auth_errors < 2 as valid from v")
def session_valid(t: Tables) -> DataFrame:
    return _validated(t).select("session_id", S.session_valid(F.col("validated_at"), F.col("auth_errors"), F.lit("2024-01-30 00:05:00").cast("timestamp")).alias("valid"))


@query("""
    with g as (select event_id, user_id, cast(epoch_us(ts) // 1000 - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) // 1000 as double) as gap_ms from events)
    select event_id, gap_ms, coalesce(gap_ms < (user_id % 5 + 1) * 60000, false) as too_early, coalesce(greatest(0, (user_id % 5 + 1) * 60000 - gap_ms), 0) as wait_ms from g
""")
def request_gap(t: Tables) -> DataFrame:
    rows = t.events.withColumnRenamed("event_id", "seq")
    gaps = pacing.request_gaps(rows, "user_id", ((F.col("user_id") % 5 + 1) * 60000).cast("double"))
    return gaps.select(F.col("seq").alias("event_id"), "gap_ms", "too_early", "wait_ms")


@query("""
    select user_id, cast(sum(case when event_type = 'view' then gap end) as double) as view_ms, cast(sum(gap) as double) as total_ms
    from (select user_id, event_type, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) // 1000 - epoch_us(ts) // 1000 as gap from events) group by user_id
""")
def phase_timings(t: Tables) -> DataFrame:
    steps = t.events.select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("phase"))
    return S.phase_times(steps, "user_id", "view").withColumnRenamed("phase_ms", "view_ms")


@query(_VALIDATED + "select count(*) as cached, count(*) filter (epoch_ms(timestamp '2024-01-30 00:05:00') - epoch_ms(validated_at) < 600000) as active from v")
def session_activity(t: Tables) -> DataFrame:
    return S.session_activity(_validated(t), F.lit("2024-01-30 00:05:00").cast("timestamp"))


def auth_events(events: DataFrame) -> DataFrame:
    kind = F.expr("case when event_type = 'signup' and event_id % 3 = 0 then 'validated' when event_type = 'error' then 'auth_error' when event_type = 'click' then 'failure' when event_id % 9 = 0 then 'cloudflare' when event_id % 9 = 1 then 'rate_limited' else 'success' end")
    return events.select((F.col("user_id") % 40).alias("session_id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))


_AUTH = """
    with e as (select user_id % 40 as session_id, ts, event_id as seq, case when event_type = 'signup' and event_id % 3 = 0 then 'validated' when event_type = 'error' then 'auth_error' when event_type = 'click' then 'failure'
                      when event_id % 9 = 0 then 'cloudflare' when event_id % 9 = 1 then 'rate_limited' else 'success' end as kind from events),
    r as (select *, count(*) filter (kind = 'validated') over (partition by session_id order by ts, seq) as run from e),
    a as (select *, count(*) filter (kind = 'auth_error') over (partition by session_id, run order by ts, seq) as errors from r),
    f as (select session_id, ts, seq, kind, sum(case when kind = 'failure' then 0 else 1 end) over (partition by session_id order by ts, seq) as run from e),
    p as (select *, count(*) filter (kind = 'failure') over (partition by session_id, run order by ts, seq) as failures from f)
"""


@query(_AUTH + "select session_id, seq, errors, kind = 'auth_error' and run > 0 and errors = 2 as invalidated from a where kind = 'auth_error'")
def auth_invalidation(t: Tables) -> DataFrame:
    return S.auth_states(auth_events(t.events)).where("kind = 'auth_error'").select("session_id", "seq", "errors", "invalidated")


@query(_AUTH + """
    select session_id, seq, 'paused' as reason from p where kind = 'failure' and failures >= 3
    union all select session_id, seq, 'auth_error' from a where kind = 'auth_error' and run > 0 and errors = 2
    union all select session_id, seq, kind from a where kind in ('cloudflare', 'rate_limited') and run > 0 and errors < 2
""")
def session_notices(t: Tables) -> DataFrame:
    return S.session_notices(auth_events(t.events)).select("session_id", "seq", "reason")


_ATTEMPTS = """
    with a as (select user_id as item_id, ts, event_id as seq, case event_type when 'error' then 'HTTP 429' when 'view' then 'request timeout' when 'click' then 'net::ERR_FAILED' when 'purchase' then case when event_id % 7 = 0 then null else 'HTTP 404' end
                      else case when event_id % 2 = 0 then 'odd' end end as error, user_id % 3 = 0 as has_session, event_id % 4 = 0 as is_paused from events),
    n as (select *, count(error) over (partition by item_id order by ts, seq) as retries, row_number() over (partition by item_id order by ts, seq) as k from a),
    x as (select *, case when error is null then 'completed' when has_session and is_paused then 'held' when has_session or (error <> 'HTTP 404' and retries < 5) then 'requeued' else 'failed' end as act from n),
    f as (select item_id, min(k) as stop from x where act in ('completed', 'failed') group by item_id)
"""


@query(_ATTEMPTS + "select x.item_id, seq, retries, case when k > stop then 'ignored' else act end as action from x left join f on f.item_id = x.item_id")
def retry_loop(t: Tables) -> DataFrame:
    return S.attempt_actions(_tries(t), 5).select("item_id", "seq", "retries", "action")


def _tries(t: Tables) -> DataFrame:
    error = F.expr("case event_type when 'error' then 'HTTP 429' when 'view' then 'request timeout' when 'click' then 'net::ERR_FAILED' when 'purchase' then if(event_id % 7 = 0, null, 'HTTP 404') else if(event_id % 2 = 0, 'odd', null) end")
    return t.events.select(F.col("user_id").alias("item_id"), "ts", F.col("event_id").alias("seq"), error.alias("error"), (F.col("user_id") % 3 == 0).alias("has_session"), (F.col("event_id") % 4 == 0).alias("is_paused"))


@query(f"""
    with n as (select user_id as session_id, event_id as seq, row_number() over (partition by user_id order by ts, event_id) as k from events),
    p as (select *, case when event_id_mod = 10 then 9 when event_id_mod = 9 then least(9, k + 1) else least(9, k) end as number from (select *, seq % 11 as event_id_mod from n)),
    b as (select *, lag(number) over (partition by session_id order by k) as before from p)
    select session_id, seq, list_extract({list(S.PHASES)}, number) as phase, case when before is null then number in (1, 9) else before < 8 and (number = before + 1 or number = 9) end as in_order from b
""")
def phase_progress(t: Tables) -> DataFrame:
    k, mod = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.col("event_id") % 11
    number = F.when(mod == 10, 9).when(mod == 9, F.least(F.lit(9), k + 1)).otherwise(F.least(F.lit(9), k))
    steps = t.events.select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, S.PHASES)), number).alias("phase"))
    return S.phase_progress(steps).select("session_id", "seq", "phase", "in_order")


@query(_PACED)
def stream_adaptive_delay(t: Tables) -> DataFrame:
    return folds.replay(t.spark, f"{t.folder}/events.parquet", lambda s: folds.adaptive_delay(outcomes(s), "user_id"), "user_id").withColumn("delay_ms", F.round("delay_ms", 3))


@query(_SESSIONS + "select session_id, failures, is_paused, pauses from s")
def stream_session_pause(t: Tables) -> DataFrame:
    return folds.replay(t.spark, f"{t.folder}/events.parquet", lambda s: folds.session_states(session_events(s)), "session_id")


@query(f"with {_REQUESTS} select item_id, lane, users, has_cookies, requests from d")
def stream_requests(t: Tables) -> DataFrame:
    class Streamed:
        pass

    def run(s: DataFrame) -> DataFrame:
        view = Streamed()
        view.events = s
        return folds.merged_requests(_requests(view))

    return folds.replay(t.spark, f"{t.folder}/events.parquet", run, "item_id")


def entry_log(events: DataFrame) -> DataFrame:
    """Requests for items, and what ends their entries, read from the events."""
    e, item = F.col("event_id"), F.col("user_id") % 200
    kind = F.expr("case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'request' end")
    lane = F.expr("case when event_type = 'signup' then 'HOT' when event_id % 4 = 0 then 'WARM' else 'COLD' end")
    return events.select(item.alias("item_id"), "ts", e.alias("seq"), kind.alias("kind"), (e % 7).alias("user_id"), lane.alias("lane"), (e % 3 == 0).alias("has_cookies"))


_ENTRIES = """
    with e as (select user_id % 200 as item_id, ts, event_id as seq, event_type in ('purchase', 'error') as ends, event_id % 7 as who, case when event_type = 'signup' then 3 when event_id % 4 = 0 then 2 else 1 end as rank,
                      event_id % 3 = 0 as cookies from events),
    n as (select *, coalesce(sum(ends::int) over (partition by item_id order by ts, seq rows between unbounded preceding and 1 preceding), 0) as entry, row_number() over (partition by item_id order by ts, seq) as k from e),
    g as (select item_id, min_by(seq, k) filter (not ends) as opened, max(rank) filter (not ends) as rank, min_by(rank, k) filter (not ends and cookies) as cookie_rank, count(distinct who) filter (not ends) as users,
                 coalesce(bool_or(cookies) filter (not ends), false) as has_cookies, count(*) filter (not ends) as requests, max(seq) filter (ends) as ended_by from n group by item_id, entry)
    select item_id, opened, case when rank = 3 or coalesce(cookie_rank > 1, false) then 'HOT' when rank = 2 then 'WARM' else 'COLD' end as lane, users, has_cookies, requests, ended_by from g where requests > 0
"""


@query(_ENTRIES)
def pending_entries(t: Tables) -> DataFrame:
    return P.pending_entries(entry_log(t.events))


@query(_ENTRIES)
def stream_pending_entries(t: Tables) -> DataFrame:
    states.with_rocksdb(t.spark)
    return folds.replay(t.spark, f"{t.folder}/events.parquet", lambda s: states.pending_entries(entry_log(s)), ["item_id", "opened"])


_COOLING = _SESSIONS + "select session_id, failures, is_paused, pauses, coalesce(epoch_ms(last_failure) + 20000 > (select epoch_ms(max(ts)) from events), false) as is_cooling from s"


@query(_COOLING)
def session_cooldowns(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").cast("timestamp").alias("now"))
    states_ = S.session_states(session_events(t.events)).join(F.broadcast(newest))  # one row
    return states_.select("session_id", "failures", "is_paused", "pauses", (S.cooldown_ms(F.col("last_failure"), F.col("now")) > 0).alias("is_cooling"))


@query(_COOLING)
def stream_session_cooldowns(t: Tables) -> DataFrame:
    states.with_rocksdb(t.spark)
    return folds.replay(t.spark, f"{t.folder}/events.parquet", lambda s: states.session_cooldowns(session_events(s)), "session_id")


@query(f"""
    {_ATTEMPTS.strip().replace("with a as", "with recursive a as", 1)},
    {_REQUESTS},
    y as (select x.item_id, k, act from x left join f on f.item_id = x.item_id where stop is null or k <= stop),
    r as (select item_id, lane, 1 as round, 0 as tries, coalesce((select act from y where y.item_id = d.item_id and k = 1), 'waiting') as action from d
          union all
          select r.item_id, lane, round + 1, tries + 1, coalesce(y.act, 'waiting') from r left join y on y.item_id = r.item_id and y.k = r.round + 1 where action in ('requeued', 'held'))
    select round, item_id, lane, tries, action, row_number() over (partition by round order by case lane when 'HOT' then 0 when 'WARM' then 1 else 2 end, score desc, queued_at, item_id) - 1 as position
    from r join (select item_id, score, queued_at from s) using (item_id)
""")
def retry_rounds(t: Tables) -> DataFrame:
    queue = P.scored(P.merge_requests(_requests(t)), _queue_time())
    order = [F.desc("score"), F.col("queued_at"), F.col("item_id")]
    return S.retry_rounds(queue, _tries(t), 5, order).select("round", "item_id", "lane", "tries", "action", "position")


@query("""
    with v as (select user_id as session_id, max(ts) as validated_at, count(*) filter (event_type = 'error') % 4 as auth_errors, count(*) filter (event_type = 'click') % 3 as failures, max(ts) filter (event_type = 'click') as last_failure
               from events where event_id % 2 = 0 group by user_id),
    w as (select user_id as session_id, max(ts) as ts from events where event_id % 7 = 3 group by user_id)
    select session_id, greatest(validated_at, ts) as validated_at, case when ts is not null then 0 else auth_errors end as auth_errors, coalesce(failures, 0) as failures, last_failure from v full join w using (session_id)
""")
def session_history(t: Tables) -> DataFrame:
    old = t.events.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("session_id")).agg(
        F.max("ts").alias("validated_at"), (F.count_if(F.col("event_type") == "error") % 4).alias("auth_errors"),
        (F.count_if(F.col("event_type") == "click") % 3).alias("failures"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("last_failure"),
    )
    return S.surviving(old, t.events.where("event_id % 7 = 3").select(F.col("user_id").alias("session_id"), "ts"))


@query(f"with {_REQUESTS} select session_id, list_sort(list_distinct(list(who))) as users from q where session_id is not null group by session_id")
def session_users(t: Tables) -> DataFrame:
    return P.session_users(_requests(t))
