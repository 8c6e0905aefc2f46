"""Scalar functions, rule tables and time-to-live queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cache, dates, rules
from ..functions import text as X
from ..operators import quality
from .registry import Tables, query

NOW = "1998-06-15 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _pick(key: str, *values: str):
    """One of ``values`` by a number's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(key) % len(values) + 1).cast("int"))


LABELS = ("Company", "ARTISTS", "Original  illustrators", "Colour producers", "Releases View all (+12)Hide", "Owned by", "Top 100", "Nothing", " Title ", "Distributor", "Paintings", "Shops")


@query(f"""
    with e as (select event_id, list_extract({list(LABELS)}, cast(event_id % 12 + 1 as int)) as label from events), l as (select *, lower(trim(label)) as k from e)
    select event_id, label,
           case k when 'company' then 1 when 'artists' then 2 when 'distributor' then 3 when 'original  illustrators' then 6 when 'colour producers' then 11 when 'title' then 12 when 'releases view all (+12)hide' then 20
                  when 'owned by' then 23 when 'top 100' then 35 when 'shops' then 37 end as prio,
           case k when 'company' then 'grouped' when 'artists' then 'grouped' when 'distributor' then 'individual' when 'original  illustrators' then 'individual' when 'colour producers' then 'individual'
                  when 'title' then 'text' when 'releases view all (+12)hide' then 'releases' when 'owned by' then 'count' when 'top 100' then 'skip' when 'shops' then 'skip' end as strategy,
           case k when 'distributor' then 'Distributor' when 'original  illustrators' then 'Illustrator' when 'colour producers' then 'Color Producer' end as role from l
""")
def label_lookup(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", _pick("event_id", *LABELS).alias("label"))
    rows = rows.select("event_id", "label", X.trim("label").alias("trimmed")).withColumn("rule", rules.label_rule(F.col("trimmed")))
    return rows.select("event_id", "label", "rule.prio", "rule.strategy", "rule.role")


_FOUND = f"""
    with e as (select event_id, case when event_id % 13 = 12 then 'Maker of ' || event_type else list_extract({list(LABELS)}, cast(event_id % 12 + 1 as int)) end as label from events), l as (select *, lower(trim(label)) as k from e),
    r as (select event_id, label,
           case when k like 'maker of %' then 0 when k = 'distributor' then 0 else case k when 'company' then 1 when 'artists' then 2 when 'original  illustrators' then 6 when 'colour producers' then 11 when 'title' then 12
                  when 'releases view all (+12)hide' then 20 when 'owned by' then 23 when 'top 100' then 35 when 'shops' then 37 end end as prio,
           case when k like 'maker of %' then 'individual' when k = 'distributor' then 'skip' else case k when 'company' then 'grouped' when 'artists' then 'grouped' when 'original  illustrators' then 'individual'
                  when 'colour producers' then 'individual' when 'title' then 'text' when 'releases view all (+12)hide' then 'releases' when 'owned by' then 'count' when 'top 100' then 'skip' when 'shops' then 'skip' end end as strategy,
           case when k like 'maker of %' then 'company' when k = 'distributor' then 'custom' else case k when 'company' then 'company' when 'artists' then 'artist' when 'original  illustrators' then 'artist'
                  when 'colour producers' then 'artist' when 'title' then 'metadata' when 'releases view all (+12)hide' then 'release' when 'owned by' then 'metadata' when 'top 100' then 'metadata' when 'shops' then 'metadata' end end as category,
           case when k like 'maker of %' then substr(k, 10) when k = 'distributor' then null else case k when 'original  illustrators' then 'Illustrator' when 'colour producers' then 'Color Producer' end end as role from l)
"""


def _user_rules(t: Tables) -> DataFrame:
    """The registry with a user's rows before it: one for each type of event, and one that overrides a rule."""
    own = t.events.select("event_type").distinct().selectExpr("0 as prio", r"concat('maker\\s+of\\s+', event_type) as pattern", "'individual' as strategy", "'company' as category", "event_type as role")
    other = t.spark.createDataFrame([(0, "distributors?", "skip", "custom", None)], "prio int, pattern string, strategy string, category string, role string")
    return rules.registry(t.spark).unionByName(own).unionByName(other)


def _found_labels(t: Tables) -> DataFrame:
    label = F.when(F.col("event_id") % 13 == 12, F.concat(F.lit("Maker of "), "event_type")).otherwise(_pick("event_id", *LABELS))
    return rules.match_rules(t.events.select("event_id", label.alias("label")), "label", _user_rules(t))


@query(_FOUND + "select * from r")
def label_rules(t: Tables) -> DataFrame:
    return _found_labels(t).select("event_id", "label", "rule.prio", "rule.strategy", "rule.category", "rule.role")


@query(_FOUND + "select coalesce(category, 'none') as category, coalesce(strategy, 'none') as strategy, count(*) as n, count(distinct label) as labels from r group by 1, 2")
def label_categories(t: Tables) -> DataFrame:
    rule = lambda c: F.coalesce(F.col(f"rule.{c}"), F.lit("none")).alias(c)
    return _found_labels(t).groupBy(rule("category"), rule("strategy")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"))


RAW_ROLES = ("Sculptors", "original illustrator", "Char. designers", "ori creator", " Mangakas ", "Color producer", "Somebody", "PLANNING", "labels")


@query(f"""
    with p as (select p_partkey, list_extract({list(RAW_ROLES)}, cast(p_partkey % 9 + 1 as int)) as raw from part)
    select p_partkey, case lower(trim(raw)) when 'sculptors' then 'Sculptor' when 'original illustrator' then 'Illustrator' when 'char. designers' then 'Character Designer' when 'ori creator' then 'Original Creator'
           when 'mangakas' then 'Mangaka' when 'color producer' then 'Color Producer' when 'planning' then 'Planning' when 'labels' then 'Label' else trim(raw) end as role from p
""")
def role_normalise(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.trim(_pick("p_partkey", *RAW_ROLES)).alias("role")).withColumn("role", rules.role_name(F.col("role")))


@query(f"""
    with p as (select p_partkey, p_type, list_extract({list(RAW_ROLES)}, cast(p_partkey % 9 + 1 as int)) as raw from part),
    q as (select p_partkey, case when p_partkey % 10 = 9 then p_type else raw end as raw from p)
    select p_partkey, case lower(trim(raw)) when 'sculptors' then 'Sculptor' when 'original illustrator' then 'Illustrator' when 'char. designers' then 'Character Designer' when 'ori creator' then 'Original Creator'
           when 'mangakas' then 'Mangaka' when 'color producer' then 'Color Producer' when 'planning' then 'Planning' when 'labels' then 'Label' else case when p_partkey % 10 = 9 then 'Type' else trim(raw) end end as role from q
""")
def role_rules(t: Tables) -> DataFrame:
    """Roles by a table to which the types of parts are added."""
    raw = F.when(F.col("p_partkey") % 10 == 9, F.col("p_type")).otherwise(_pick("p_partkey", *RAW_ROLES))
    own = t.part.select("p_type").distinct().select(F.lit(100).alias("prio"), F.concat(F.lit("\\Q"), "p_type", F.lit("\\E")).alias("pattern"), F.lit("Type").alias("role"))
    rows = rules.match_rules(t.part.select("p_partkey", raw.alias("raw")), "raw", rules.role_table(t.spark).unionByName(own))
    return rows.select("p_partkey", F.coalesce("rule.role", X.trim("raw")).alias("role"))


@query("select category, strategy, count(*) as n from (values " + ", ".join(f"('{c}', '{s}')" for _, s, c, _ in rules.LABELS) + ") v(category, strategy) group by category, strategy")
def registry_by_category(t: Tables) -> DataFrame:
    return rules.registry(t.spark).groupBy("category", "strategy").agg(F.count(F.lit(1)).alias("n"))


_TTL = f"""
    with o as (select o_orderkey, case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) end as r, timestamp '{NOW}' as now, timestamp '{NOW}' - to_days(cast(o_orderkey % 100 as int)) as cached from orders),
    d as (select *, floor((epoch_ms(now) - epoch_ms(cast(r as timestamp))) / 86400000.0) as days from o),
    c as (select *, case when r is null then 'unknown' when cast(r as timestamp) > now then 'future' when floor(days / 30) < 3 then 'recent' when year(r) = year(now) then 'current_year' when year(r) = year(now) - 1 then 'established' else 'legacy' end as category from d),
    k as (select *, case category when 'future' then 7 when 'recent' then 14 when 'current_year' then 30 when 'established' then 60 else 90 end as ttl_days, case category when 'future' then 30 when 'recent' then 20 when 'current_year' then 10 when 'legacy' then 0 else 5 end as bonus,
                 cast(o_orderkey % 100 as int) as age from c)
"""


def _cached(t: Tables) -> DataFrame:
    release = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", release.alias("r"), (_now() - F.make_dt_interval((F.col("o_orderkey") % 100).cast("int"))).alias("cached"))


@query(_TTL + """
    select o_orderkey, category, cast(ttl_days as bigint) * 86400000 as ttl_ms, ttl_days || ' days' as ttl_human,
           case when category = 'unknown' then 'no valid release date' when category = 'future' then 'released in ' || away || ' days' when category in ('recent', 'current_year') then 'released ' || (away // 30) || ' months ago'
                else 'released ' || (year(now) - year(r)) || ' years ago' end as reason
    from (select *, cast(floor(abs(epoch_ms(now) - epoch_ms(cast(r as timestamp))) / 86400000.0) as bigint) as away from k)
""")
def ttl_category(t: Tables) -> DataFrame:
    return _cached(t).select("o_orderkey", cache.ttl(F.col("r"), _now()).alias("t")).select("o_orderkey", "t.category", "t.ttl_ms", "t.ttl_human", "t.reason")


@query(_TTL + "select o_orderkey, age < ttl_days as valid from k")
def cache_valid(t: Tables) -> DataFrame:
    return _cached(t).select("o_orderkey", cache.valid(F.col("cached"), F.col("r"), _now()).alias("valid"))


@query(_TTL + "select o_orderkey, strftime(cached + to_days(ttl_days), '%Y-%m-%d %H:%M:%S') as expires from k")
def cache_expiry(t: Tables) -> DataFrame:
    return _cached(t).select("o_orderkey", F.date_format(cache.expires(F.col("cached"), F.col("r"), _now()), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query(_TTL + "select o_orderkey, cast(least(100, floor(least(1.0, age / cast(ttl_days as double)) * 50 + bonus + case when age >= ttl_days then 20 else 0 end + 0.5)) as int) as priority from k")
def refresh_priority(t: Tables) -> DataFrame:
    return _cached(t).select("o_orderkey", cache.refresh_priority(F.col("cached"), F.col("r"), _now()).alias("priority"))


@query("""
    with e as (select event_id, event_id * 54321 % 400000000 as ms from events), d as (select *, ms // 86400000 as d, ms % 86400000 // 3600000 as h, ms % 3600000 // 60000 as m from e)
    select event_id, case when d > 0 and h > 0 then d || 'd ' || h || 'h' when d > 0 then d || ' days' when h > 0 and m > 0 then h || 'h ' || m || 'm' when h > 0 then h || ' hours' else m || ' minutes' end as human from d
""")
def duration_format(t: Tables) -> DataFrame:
    return t.events.select("event_id", cache.duration(F.col("event_id") * 54321 % 400000000).alias("human"))


_PAIRS = "with p as (select a.p_partkey, a.p_name as a, b.p_name as b from part a join part b on b.p_partkey = a.p_partkey + 1)"


def _pairs(t: Tables) -> DataFrame:
    left, right = t.part.select("p_partkey", F.col("p_name").alias("a")), t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return left.join(right, "p_partkey")


@query(_PAIRS + "select p_partkey, levenshtein(a, b) as distance from p")
def edit_distance(t: Tables) -> DataFrame:
    return _pairs(t).select("p_partkey", X.distance(F.col("a"), F.col("b")).alias("distance"))


@query(_PAIRS + "select p_partkey, round((greatest(length(a), length(b)) - levenshtein(a, b)) / cast(greatest(length(a), length(b)) as double), 9) as similarity from p")
def similarity(t: Tables) -> DataFrame:
    return _pairs(t).select("p_partkey", F.round(X.similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


TITLES = ("Just  a   MOMENT...", "Catalog item", "Justa moment", "Welcome", "Security check required", "Plese wait", "An ordinary page with a rather long title")
BODIES = ("An ordinary text about nothing in particular.", "please   ENABLE cookies", "Acces denied", "Words and more words", "")


@query(f"""
    with e as (select event_id, list_extract({list(TITLES)}, cast(event_id % 7 + 1 as int)) as title, list_extract({list(BODIES)}, cast(event_id % 5 + 1 as int)) as body from events)
    select event_id, title in ('Just  a   MOMENT...', 'Justa moment', 'Security check required', 'Plese wait') or body in ('please   ENABLE cookies', 'Acces denied') as challenge from e
""")
def challenge_pages(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", _pick("event_id", *TITLES).alias("title"), _pick("event_id", *BODIES).alias("body"))
    return quality.with_challenge(rows).select("event_id", "challenge")


MESSAGES = ("Timeout", "request timeout", "HTTP 404", "RATE_LIMIT hit", "HTTP 429", "NSFW item", "net::ERR_FAILED", "odd", "item not found, or authentication is needed", "Cloudflare")


@query(f"""
    with e as (select event_id, list_extract({list(MESSAGES)}, cast(event_id % 10 + 1 as int)) as message from events)
    select event_id, case message when 'request timeout' then 'timeout' when 'HTTP 404' then 'not_found' when 'item not found, or authentication is needed' then 'not_found' when 'RATE_LIMIT hit' then 'rate_limited'
        when 'HTTP 429' then 'rate_limited' when 'Cloudflare' then 'rate_limited' when 'NSFW item' then 'auth_required' when 'net::ERR_FAILED' then 'network' else 'unknown' end as error_class from e
""")
def classify_error(t: Tables) -> DataFrame:
    return t.events.select("event_id", rules.error_class(_pick("event_id", *MESSAGES)).alias("error_class"))


@query("select event_id, event_id % 10 in (0, 1, 3, 4, 6, 7, 9) and event_id % 5 < 3 as eligible from events")
def retry_eligible(t: Tables) -> DataFrame:
    return t.events.select("event_id", rules.retry_eligible(rules.error_class(_pick("event_id", *MESSAGES)), F.col("event_id") % 5, F.lit(3)).alias("eligible"))


@query("""
    select event_id, event_id % 4 = 0 as missing_page, event_id % 3 = 0 as blocked, event_id % 2 = 0 and event_id % 5 > 0 as logged_in from events
""")
def page_state(t: Tables) -> DataFrame:
    from ..operators import quality

    e = F.col("event_id")
    title = F.concat(F.when(e % 4 == 0, "Error 404 ").otherwise("Item "), F.when(e % 3 == 0, "Access denied").otherwise(""))
    body, url = F.when(e % 4 == 0, "Not Found").otherwise("text"), F.lit("https://www.example.net/item/1")
    menu_title = F.when(e % 5 == 0, "ERROR").otherwise("Home")
    return t.events.select("event_id", quality.missing_page(url, title, body, "example.net").alias("missing_page"), quality.blocked_page(title, F.lit(False)).alias("blocked"), quality.logged_in(menu_title, e % 2 == 0).alias("logged_in"))


@query("select event_id, cast(case when event_id % 3 = 0 then event_id % 20 * 1000 else 1000 * pow(2, event_id % 4) end as bigint) as delay_ms from events")
def webhook_delay(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select("event_id", rules.webhook_delay_ms(F.when(e % 3 == 0, e % 20), e % 4).alias("delay_ms"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30.000Z' as iso from orders where o_orderkey % 7 <> 0 union all select o_orderkey, null from orders where o_orderkey % 7 = 0")
def parse_list_date(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 == 0, "13/40/2020, 10:20:30").otherwise(F.concat(F.date_format("o_orderdate", "M/d/yyyy"), F.lit(", 10:20:30")))
    return t.orders.select("o_orderkey", dates.list_time(text).alias("iso"))


@query("""
    select o_orderkey, cast(case o_orderkey % 6 when 0 then cast(o_orderdate as date) when 1 then date_trunc('month', o_orderdate) when 2 then date_trunc('month', o_orderdate) when 3 then date_trunc('month', o_orderdate)
           when 4 then date_trunc('year', o_orderdate) end as date)::varchar as date from orders
""")
def release_date(t: Tables) -> DataFrame:
    f = lambda p: F.date_format("o_orderdate", p)
    forms = F.array(f("yyyy-MM-dd"), f("yyyy-MM"), f("MMMM yyyy"), f("yyyy MMM"), f("yyyy"), F.lit("soon"))
    return t.orders.select("o_orderkey", dates.release_date(F.element_at(forms, (F.col("o_orderkey") % 6 + 1).cast("int"))).cast("string").alias("date"))


@query("select event_id, case event_id % 4 when 0 then 'private' when 1 then 'friends' else 'public' end as privacy from events")
def privacy(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.privacy(_pick("event_id", "A Private list", "FRIENDS only", "Public", "")).alias("privacy"))


@query("select p_partkey, round(p_retailprice, 2) as number from part")
def numeric_prefix(t: Tables) -> DataFrame:
    text = F.concat(F.lit("  "), F.format_string("%.2f", "p_retailprice"), F.lit(" JPY 3"))
    return t.part.select("p_partkey", F.round(X.numeric_prefix(text), 2).alias("number"))


@query("select event_id, case when event_id % 5 = 0 then 1000 when event_id % 100 < 50 then 1000 else least(event_id % 100 * 700, 30000) end as wait_ms from events")
def cap_wait(t: Tables) -> DataFrame:
    e = F.col("event_id")
    wait = F.when(e % 5 == 0, F.lit(None)).otherwise(F.when(e % 100 < 50, F.lit(-1)).otherwise(e % 100 * 700))
    return t.events.select("event_id", X.cap_wait(wait).cast("bigint").alias("wait_ms"))


@query("select p_partkey, 'https://www.example.net/?q=' || replace(p_name, ' ', '%20') || '&page=' || (p_partkey % 9) as url from part")
def url_build(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("https://www.example.net/?q="), X.encode_part(F.col("p_name")), F.lit("&page="), (F.col("p_partkey") % 9).cast("string")).alias("url"))


@query(f"""
    with d as (select event_id, case when event_id % 3 = 0 then 'overloaded' when event_id % 4 > 0 then 'expired' else 'unknown' end as diagnosis from events)
    select event_id, d.diagnosis, confidence, explanation, reachable from d
    join (values {", ".join(f"('{k}', {c}::double, '{e}', {r})" for k, (c, e, r) in rules.DIAGNOSES.items())}) v(diagnosis, confidence, explanation, reachable) on v.diagnosis = d.diagnosis
""")
def probe_diagnosis(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select("event_id", rules.diagnosis(e % 3 != 0, e % 4).alias("d")).select("event_id", "d.*")


@query("select event_id, event_type, event_type = 'view' or event_type in ('click', 'error') as enabled, event_type <> '' as every from events")
def namespace_match(t: Tables) -> DataFrame:
    some, every = F.array(F.lit("app:view"), F.lit("log:*")), F.array(F.lit("*"))
    name = F.concat(F.when(F.col("event_type").isin("click", "error"), "log:").otherwise("app:"), F.col("event_type"))
    return t.events.select("event_id", "event_type", X.namespace_enabled(name, some).alias("enabled"), X.namespace_enabled(name, every).alias("every"))


_MAP = "map_from_arrays(array('user', 'pass', 'other'), array(event_type, if(event_id % 2 = 0, 'x', ''), 'y'))"


@query("select event_id, case when event_id % 2 = 0 then 'sid' else 'pass,sid' end as missing from events")
def required_keys(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.array_join(X.missing_keys(F.expr(_MAP), ["user", "pass", "sid"]), ",").alias("missing"))


@query("select event_id, case when event_id % 2 = 0 then 'pass,user' else 'user' end as kept, 'pass,user' as redacted from events")
def map_allowlist(t: Tables) -> DataFrame:
    m = F.expr(_MAP)
    return t.events.select("event_id", X.key_snapshot(X.allowed_entries(m, ["user", "pass"])).alias("kept"), X.key_snapshot(X.redacted_entries(m, ["user", "pass"])).alias("redacted"))


@query("""
    with r as (select page_id, case when page_id % 5 = 0 then '' else url end as url, page_id % 7 <> 0 as has_config from pages)
    select page_id, case when url = '' then 'url is missing' when not has_config then 'config is missing' end as reason from r
""")
def quarantine(t: Tables) -> DataFrame:
    from ..operators import quality

    rows = t.pages.select("page_id", F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 7 != 0, "{}").alias("config"))
    good, bad = quality.quarantine(rows, ["url", "config"])
    return good.select("page_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("page_id", "reason"))


@query("""
    with u as (select user_id, list_sort(list_distinct(list(event_type))) as kinds, count(*) as n from events group by user_id)
    select user_id, array_to_string(kinds, ',') as kinds, list_contains(kinds, 'error') as has_error, array_to_string(list_sort(list_distinct(list_append(kinds, 'resume'))), ',') as joined from u
""")
def array_ops(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return rows.select("user_id", F.array_join("kinds", ",").alias("kinds"), F.array_contains("kinds", "error").alias("has_error"), F.array_join(F.array_sort(F.array_union("kinds", F.array(F.lit("resume")))), ",").alias("joined"))


@query("select doc_id, left(text, 100) as preview, array_to_string(list_slice(string_split(text, ' '), 1, 3), '|') as first_words from documents")
def first_k(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring("text", 1, 100).alias("preview"), F.array_join(F.slice(F.split("text", " "), 1, 3), "|").alias("first_words"))


@query("select l_orderkey, string_agg(cast(l_partkey as varchar), ', ' order by l_linenumber, l_partkey) as parts from lineitem group by l_orderkey")
def ordered_concat(t: Tables) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: x["l_partkey"].cast("string")), ", ").alias("parts"))
