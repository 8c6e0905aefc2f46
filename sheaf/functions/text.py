"""String functions as column expressions.  Lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_STRING, MAX_LOG, MAX_OBJECT_LOG, MAX_WAIT_MS, DEFAULT_WAIT_MS = 1000, 2000, 500, 30_000, 1000
#: What ``trim`` takes away.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(c: Column | str) -> Column:
    """Both ends without any Unicode white space or byte order mark."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Lower case, trimmed, each run of white space one space."""
    return F.regexp_replace(trim(F.lower(c)), r"(?U)[\s\uFEFF]+", " ")


def filled(c: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(c, F.lit(""))


def group(c: Column, pattern: str, i: int = 1) -> Column:
    """A group of the first match; null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i))


def image_upgrade(url: Column) -> Column:
    """Full resolution: the first small-image folder of the path gives way to that of large ones."""
    return F.regexp_replace(url, r"(?s)^(.*?)/upload/items/[01]/", "$1/upload/items/2/")


def trailing_id(href: Column) -> Column:
    return group(href, r"/([0-9]+)\z").try_cast("bigint")


def path_id(href: Column, kind: str) -> Column:
    return group(href, rf"/{kind}/([0-9]+)").try_cast("bigint")


def numeric_prefix(c: Column) -> Column:
    """The number that a text starts with."""
    return group(c, r"(?U)^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)").try_cast("double")


def first_count(c: Column) -> Column:
    """First run of digits once commas are gone."""
    return group(F.regexp_replace(c, ",", ""), "([0-9]+)").try_cast("bigint")


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.substring(a, 1, MAX_STRING), F.substring(b, 1, MAX_STRING))


def similarity(a: Column, b: Column) -> Column:
    """Share of the longer text that the edits leave; 1 for two empty ones."""
    longest = F.greatest(F.char_length(F.substring(a, 1, MAX_STRING)), F.char_length(F.substring(b, 1, MAX_STRING)))
    return F.when(longest == 0, F.lit(1.0)).otherwise((longest - distance(a, b)) / longest)


def log_line(c: Column, most: int = MAX_LOG) -> Column:
    """Safe to log: line ends as spaces, no terminal sequences or control characters, cut."""
    c = F.regexp_replace(c, r"[\r\n]", " ")
    c = F.regexp_replace(c, r"\x1b\[[0-9;]*[a-zA-Z]", "")
    return F.substring(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), 1, most)


def object_line(record: Column) -> Column:
    pretty = F.regexp_replace(F.to_json(record, {"pretty": "true"}), '" : ', '": ')
    return F.substring(log_line(pretty), 1, MAX_OBJECT_LOG)


def cap_wait(ms: Column) -> Column:
    ms = F.coalesce(ms, F.lit(DEFAULT_WAIT_MS))
    return F.when(ms < 0, F.lit(DEFAULT_WAIT_MS)).otherwise(F.least(ms, F.lit(MAX_WAIT_MS)))


def privacy(c: Column) -> Column:
    c = F.lower(c)
    return F.when(c.contains("private"), "private").when(c.contains("friend"), "friends").otherwise("public")


def encode_part(c: Column) -> Column:
    """Percent-encoding of a URL component."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def host_allowed(url: Column, domain: str) -> Column:
    h = host(url)
    return F.coalesce((h == domain) | h.endswith("." + domain), F.lit(False))


def outbound_allowed(url: Column) -> Column:
    """http or https, and no loopback or private address."""
    h, scheme = host(url), F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    inside = h.isin("localhost", "127.0.0.1", "::1", "[::1]") | h.startswith("10.") | h.startswith("192.168.") | h.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\.")
    return F.coalesce(scheme.isin("http", "https") & ~inside, F.lit(False))


def namespace_enabled(name: Column, enabled: Column) -> Column:
    return F.exists(enabled, lambda p: (p == "*") | (p == name) | (p.endswith(":*") & name.startswith(F.regexp_replace(p, r"\*\z", ""))))


def missing_keys(record: Column, required: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, required)), lambda k: F.coalesce(F.try_element_at(record, k), F.lit("")) == "")


def allowed_entries(record: Column, allowed: list[str]) -> Column:
    return F.map_filter(record, lambda k, v: k.isin(*allowed) & v.isNotNull() & (v != ""))


def redacted_entries(record: Column, allowed: list[str]) -> Column:
    return F.transform_values(F.map_filter(record, lambda k, v: k.isin(*allowed)), lambda k, v: F.lit("[REDACTED]"))


def key_snapshot(record: Column) -> Column:
    return F.array_join(F.array_sort(F.map_keys(record)), ",")
