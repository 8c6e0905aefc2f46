"""Inventory, plans and the request queue, rendered from orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import enrichment as P
from ..plans.order import numbered
from ..session import new_path, written
from ..sources import inventory as I
from ..sources.dom import spread
from .registry import Tables, query


def _now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


HEADER = "ID,Name,Category,Status,Release Date,Price,NSFW"
_ITEMS = """
    i as (select cast(o_orderkey as varchar) as item_id, 'Order "' || o_orderkey || '", ' || o_orderpriority as name, o_orderpriority as category, case o_orderstatus when 'F' then 'owned' when 'O' then 'ordered' else 'wished' end as status,
                 strftime(o_orderdate, '%Y-%m-%d') as release_date, cast(cast(o_custkey as int) as varchar) as price, o_orderkey % 3 = 0 as is_nsfw from orders where o_orderkey % 13 <> 0)
"""


def _lines(t: Tables) -> DataFrame:
    d = F.format_string(
        '%s,"Order ""%s"", %s",%s, %s ,%s,%s,%s', F.when(F.col("o_orderkey") % 13 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")), F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderpriority"),
        F.expr("case o_orderstatus when 'F' then 'Owned' when 'O' then 'ORDERED' else 'Wished' end"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "Yes").otherwise("no"),
    )
    lines = spread(t.orders).select(d.alias("value"))
    return lines.unionByName(t.spark.createDataFrame([(HEADER,), ("",), ("   ",)], "value string"))


def _items(t: Tables) -> DataFrame:
    return I.parse_inventory(_lines(t), HEADER)


@query(f"with {_ITEMS} select * from i")
def csv_inventory(t: Tables) -> DataFrame:
    return _items(t)


@query(f"with {_ITEMS} select * replace (case when cast(item_id as bigint) % 4 = 1 then null else is_nsfw end as is_nsfw) from i")
def csv_files(t: Tables) -> DataFrame:
    """Files with columns of other names and order, each read by its own header."""
    key = F.col("o_orderkey")
    cells = {
        "id": F.when(key % 13 == 0, "n/a").otherwise(key.cast("string")), "name": F.format_string('Order "%s", %s', key.cast("string"), F.col("o_orderpriority")), "category": F.col("o_orderpriority"),
        "status": F.expr("case o_orderstatus when 'F' then 'Owned' when 'O' then 'ORDERED' else 'Wished' end"), "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "price": F.col("o_custkey").cast("string"),
        "nsfw": F.when(key % 3 == 0, "Yes").otherwise("no"),
    }
    shapes = (
        (("ID", "id"), ("Name", "name"), ("Category", "category"), ("Status", "status"), ("Release Date", "date"), ("Price", "price"), ("NSFW", "nsfw")),
        (("Price", "price"), ("Status", "status"), ("Item ID", "id"), ("Title", "name"), ("Release Date", "date"), ("Type", "category")),
        (("Adult?", "nsfw"), ("Released", "date"), ("Cost", "price"), ("Item", "id"), ("Name", "name"), ("Item type", "category"), ("Owned", "status")),
        (("Name", "name"), ("ID", "id"), ("NSFW", "nsfw"), ("Category", "category"), ("Status", "status"), ("Price", "price"), ("Release", "date")),
    )
    paths = []
    for k, shape in enumerate(shapes):
        paths.append(new_path(t.spark, "inventory"))
        t.orders.where(key % 4 == k).select(*(cells[c].alias(h) for h, c in shape)).write.option("header", True).option("escape", '"').csv(paths[-1])
    return I.parse_inventory_files(t.spark, paths)


@query(f"with {_ITEMS} select count(*) as total, count(*) filter (status = 'owned') as owned, count(*) filter (status = 'ordered') as ordered, count(*) filter (status = 'wished') as wished, count(*) filter (is_nsfw) as nsfw from i")
def status_stats(t: Tables) -> DataFrame:
    return P.status_stats(_items(t))


@query("select count(*) as items from orders")
def csv_item_count(t: Tables) -> DataFrame:
    return I.item_count(_lines(t))


_ACTIVITY = "a as (select *, row_number() over (partition by o_orderstatus order by o_orderdate desc, o_orderkey) - 1 as activity_order from orders)"


def _activity(t: Tables) -> DataFrame:
    rows = numbered(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderstatus"], [F.desc("o_orderdate"), F.col("o_orderkey")], "activity_order")
    status = F.expr("case o_orderstatus when 'F' then 'owned' when 'O' then 'ordered' else 'wished' end")
    return rows.select(F.col("o_orderkey").cast("string").alias("item_id"), status.alias("status"), "activity_order")


@query(f"with {_ACTIVITY} select cast(o_orderkey as varchar) as item_id, activity_order from a")
def activity_order(t: Tables) -> DataFrame:
    return _activity(t).select("item_id", "activity_order")


@query(f"with {_ACTIVITY}, {_ITEMS} select item_id, status, case when o_orderkey % 4 <> 0 then activity_order end as activity_order from i join a on item_id = cast(o_orderkey as varchar)")
def merge_activity(t: Tables) -> DataFrame:
    activity = _activity(t).where("cast(item_id as bigint) % 4 <> 0")
    return P.merge_activity(_items(t), activity).select("item_id", "status", "activity_order")


_ORPHANS = f"with {_ITEMS}, o as (select distinct cast(l_partkey * 7 as varchar) as item_id from lineitem where l_partkey * 7 not in (select cast(item_id as bigint) from i))"


def _orphans(t: Tables, items: DataFrame) -> DataFrame:
    return P.orphans(t.lineitem.select((F.col("l_partkey") * 7).alias("item_id")), items)


@query(_ORPHANS + " select item_id, 'wished' as status, true as is_orphan from o")
def orphans(t: Tables) -> DataFrame:
    return _orphans(t, _items(t))


@query(_ORPHANS + """
    select item_id, status, case when is_nsfw then 'HOT' when status = 'wished' then 'COLD' else 'WARM' end as lane, null::boolean as is_orphan from i where status in ('owned', 'wished')
    union all select item_id, 'wished', 'COLD', true from o
""")
def plan_union(t: Tables) -> DataFrame:
    items = written(_items(t), "items")  # read twice: the lines are split once
    return P.plan(items, _orphans(t, items), ["owned", "wished"]).select("item_id", "status", "lane", "is_orphan")


@query(f"with {_ITEMS} select item_id, name, status as collection_status from i")
def webhook_items(t: Tables) -> DataFrame:
    return P.webhook_items(_items(t)).select("item_id", "name", "collection_status")


_REQUESTS = """
    q as (select event_id as request_id, user_id as item_id, event_id % 7 as who, ts as queued_at, event_id % 3 = 0 as has_cookies, case when event_id % 3 = 0 then event_id % 5 end as session_id,
                 case event_type when 'signup' then 'HOT' when 'purchase' then 'WARM' when 'click' then 'WARM' else 'COLD' end as lane, case event_type when 'purchase' then 'owned' when 'click' then 'ordered' when 'view' then 'wished' end as status
          from events),
    m as (select item_id, max(case lane when 'HOT' then 3 when 'WARM' then 2 else 1 end) as rank, min_by(lane, struct_pack(a := queued_at, b := request_id)) filter (has_cookies) as cookie_lane, count(distinct who) as users, min(queued_at) as queued_at,
                 bool_or(has_cookies) as has_cookies, min_by(coalesce(status, 'wished'), struct_pack(a := queued_at, b := request_id)) as status, min_by(session_id, struct_pack(a := queued_at, b := request_id)) filter (has_cookies) as session_id, count(*) as requests from q group by item_id),
    d as (select item_id, case when rank = 3 or coalesce(cookie_lane <> 'COLD', false) then 'HOT' when rank = 2 then 'WARM' else 'COLD' end as lane, users, queued_at, has_cookies, status, session_id, requests from m),
    s as (select *, case status when 'owned' then 30 when 'ordered' then 20 else 10 end + case when has_cookies and session_id is not null then 20 else 0 end + least(20, users * 5) + least(10.0, (epoch_ms(timestamp '2024-02-01') - epoch_ms(queued_at)) / 60000.0) as score from d),
    p as (select *, row_number() over (order by case lane when 'HOT' then 0 when 'WARM' then 1 else 2 end, score desc, queued_at, item_id) - 1 as position from s)
"""


def _requests(t: Tables) -> DataFrame:
    e = F.col("event_id")
    lane = F.expr("case event_type when 'signup' then 'HOT' when 'purchase' then 'WARM' when 'click' then 'WARM' else 'COLD' end")
    status = F.expr("case event_type when 'purchase' then 'owned' when 'click' then 'ordered' when 'view' then 'wished' end")
    return t.events.select(e.alias("request_id"), F.col("user_id").alias("item_id"), (e % 7).alias("user_id"), F.col("ts").alias("queued_at"), (e % 3 == 0).alias("has_cookies"), F.when(e % 3 == 0, e % 5).alias("session_id"), lane.alias("lane"), status.alias("status"))


def _queue(t: Tables) -> DataFrame:
    return P.scored(P.merge_requests(_requests(t)), _now())


@query(f"with {_REQUESTS} select item_id, lane, users, status, has_cookies, session_id, requests from d")
def dedup_requests(t: Tables) -> DataFrame:
    return P.merge_requests(_requests(t)).drop("queued_at")


@query(f"with {_REQUESTS} select item_id, lane, round(score, 6) as score from s")
def queue_order(t: Tables) -> DataFrame:
    return P.admitted(_queue(t)).select("item_id", "lane", F.round("score", 6).cast("double").alias("score"))


@query(f"""
    with {_REQUESTS}, c as (select *, row_number() over (partition by lane order by queued_at, item_id) as arrival from s)
    select item_id, lane, round(score, 6) as score from c where arrival <= 20
""")
def queue_admitted(t: Tables) -> DataFrame:
    """What a queue of 20 places a lane takes: the rest is turned away."""
    return P.admitted(_queue(t), 20).select("item_id", "lane", F.round("score", 6).cast("double").alias("score"))


@query(f"with {_REQUESTS} select item_id, lane, position from p")
def queue_position(t: Tables) -> DataFrame:
    return P.positions(_queue(t)).select("item_id", "lane", "position")


@query(f"""
    with {_REQUESTS}, a as (select count(*) filter (event_id % 3 = 0) as completed, count(*) filter (event_id % 3 = 1) as failed, count(*) filter (event_id % 3 = 2) as processing from events)
    select count(*) filter (lane = 'HOT') as hot, count(*) filter (lane = 'WARM') as warm, count(*) filter (lane = 'COLD') as cold, count(*) as total, any_value(processing) as processing, any_value(completed) as completed, any_value(failed) as failed, 2067.0::double as delay_ms from d, a
""")
def queue_stats(t: Tables) -> DataFrame:
    return P.queue_stats(P.merge_requests(_requests(t)), _attempts(t), 2067.0)


def _attempts(t: Tables) -> DataFrame:
    k = F.col("request_id") % 3
    return _requests(t).withColumn("outcome", F.when(k == 0, "completed").when(k == 1, "failed").otherwise("processing"))


@query("""
    select case event_type when 'purchase' then 'owned' when 'click' then 'ordered' else 'wished' end as status, count(*) as queued, count(*) filter (event_id % 3 = 0) as completed, count(*) filter (event_id % 3 = 1) as failed from events group by 1
""")
def status_progress(t: Tables) -> DataFrame:
    return P.status_progress(_attempts(t))


@query(f"with {_REQUESTS} select session_id, count(*) as pending from d where session_id is not null group by session_id")
def pending_by_session(t: Tables) -> DataFrame:
    return P.pending_by_session(P.merge_requests(_requests(t)))


@query(f"with {_REQUESTS} select sum(requests - 1) as deduplicated, count(*) as queued from d")
def admission_counts(t: Tables) -> DataFrame:
    return P.admission_counts(P.merge_requests(_requests(t)))


@query(f"with {_REQUESTS} select c_custkey as item_id from customer where c_custkey in (select item_id from d)")
def pending_lookup(t: Tables) -> DataFrame:
    return P.pending(t.customer.select(F.col("c_custkey").alias("item_id")), P.merge_requests(_requests(t)))


@query(f"with {_REQUESTS} select item_id from d where not (has_cookies and session_id is not null and session_id in (1, 2))")
def dispatchable(t: Tables) -> DataFrame:
    sessions = t.spark.createDataFrame([(1, True, 0), (2, False, 200), (3, False, 50)], "session_id bigint, is_paused boolean, cooldown_until_ms bigint")
    return P.dispatchable(P.merge_requests(_requests(t)), sessions, F.lit(100)).select("item_id")


@query(f"with {_REQUESTS}, f as (select distinct user_id as item_id, event_id % 5 as session_id from events where event_type = 'error') select item_id, (item_id, session_id) in (select (item_id, session_id) from f) as cancelled from d where session_id is not null")
def cancel_failed(t: Tables) -> DataFrame:
    queue = P.merge_requests(_requests(t)).where("session_id is not null")
    failed = t.events.where("event_type = 'error'").select(F.col("user_id").alias("item_id"), (F.col("event_id") % 5).alias("session_id"))
    stays, gone = P.cancel_failed(queue, failed)
    return stays.select("item_id", F.lit(False).alias("cancelled")).unionByName(gone.select("item_id", F.lit(True).alias("cancelled")))


@query(f"with {_REQUESTS} select item_id, item_id in (select c_custkey from customer) as one_gone, coalesce(session_id in (1, 3), false) as session_gone from d")
def cancellations(t: Tables) -> DataFrame:
    queue = P.merge_requests(_requests(t))
    by_id = [x.select("item_id", F.lit(g).alias("one_gone")) for x, g in zip(P.cancel(queue, t.customer.select(F.col("c_custkey").alias("item_id"))), (False, True), strict=True)]
    sessions = t.spark.createDataFrame([(1,), (3,)], "session_id bigint")
    by_session = [x.select("item_id", F.lit(g).alias("session_gone")) for x, g in zip(P.cancel_sessions(queue, sessions), (False, True), strict=True)]
    return by_id[0].union(by_id[1]).join(by_session[0].union(by_session[1]), "item_id")


@query("select p_partkey as id from part where p_partkey % 3 <> 0 order by p_partkey limit 100 offset 20")
def id_source(t: Tables) -> DataFrame:
    ids = t.part.select(F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_partkey").cast("string")).try_cast("bigint").alias("id"))
    return I.id_page(ids, 20, 100)


@query("select * from (values (12), (-3), (7), (12)) v(id)")
def id_literals(t: Tables) -> DataFrame:
    return I.literal_ids(t.spark, "12, -3,x7,,7abc , 12")


@query("select event_id, unnest([user_id, -event_id, event_id]) as id from events")
def id_lists(t: Tables) -> DataFrame:
    """Ids of a list in each row."""
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    rows = t.events.select("event_id", F.concat(u, F.lit(", -"), e, F.lit(",x"), e, F.lit(",, "), e, F.lit("abc ,")).alias("ids"))
    return I.listed_ids(rows, "ids").select("event_id", "id")


@query("select o_orderkey as id from orders where o_orderkey % 5 <> 0")
def id_file(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    path = new_path(t.spark, "ids")
    t.orders.select(F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("#"), key)).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("  "), key, F.lit(" items"))).otherwise(key).alias("value")).write.text(path)
    return I.file_ids(t.spark, path)
