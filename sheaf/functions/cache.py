"""How long a cached record stays good, and how urgent its refresh is.  ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, HOUR_MS, MINUTE_MS = 86_400_000, 3_600_000, 60_000
#: Days to keep and points for urgency by category.
TTL_DAYS = {"future": 7, "recent": 14, "current_year": 30, "established": 60, "legacy": 90, "unknown": 90}
BONUS = {"future": 30, "recent": 20, "current_year": 10, "established": 5, "legacy": 0, "unknown": 5}


def _ms(t: Column) -> Column:
    return F.unix_millis(t.cast("timestamp"))


def _of(category: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), category)


def category(release: Column, now: Column) -> Column:
    months = F.floor(F.floor((_ms(now) - _ms(release)) / DAY_MS) / 30)
    return (
        F.when(release.isNull(), "unknown").when(_ms(release) > _ms(now), "future").when(months < 3, "recent")
        .when(F.year(release) == F.year(now), "current_year").when(F.year(release) == F.year(now) - 1, "established").otherwise("legacy")
    )


def ttl_ms(kind: Column) -> Column:
    return _of(kind, TTL_DAYS).cast("bigint") * DAY_MS


def ttl(release: Column, now: Column) -> Column:
    kind = category(release, now)
    days = F.floor(F.abs(_ms(now) - _ms(release)) / DAY_MS)
    months, years = F.floor(days / 30), F.year(now) - F.year(release)
    reason = (
        F.when(kind == "unknown", "no valid release date").when(kind == "future", F.concat(F.lit("released in "), days.cast("string"), F.lit(" days")))
        .when(kind.isin("recent", "current_year"), F.concat(F.lit("released "), months.cast("string"), F.lit(" months ago"))).otherwise(F.concat(F.lit("released "), years.cast("string"), F.lit(" years ago")))
    )
    return F.struct(ttl_ms(kind).alias("ttl_ms"), F.concat(_of(kind, TTL_DAYS).cast("string"), F.lit(" days")).alias("ttl_human"), kind.alias("category"), reason.alias("reason"))


def valid(cached: Column, release: Column, now: Column) -> Column:
    return _ms(now) - _ms(cached) < ttl_ms(category(release, now))


def expires(cached: Column, release: Column, now: Column) -> Column:
    return F.timestamp_millis(_ms(cached) + ttl_ms(category(release, now)))


def refresh_priority(cached: Column, release: Column, now: Column) -> Column:
    """0 to 100: age up to 50, the category's points, 20 for an expired entry."""
    kind = category(release, now)
    age, most = _ms(now) - _ms(cached), ttl_ms(kind)
    points = F.least(F.lit(1.0), age / most) * 50 + _of(kind, BONUS) + F.when(age >= most, 20).otherwise(0)
    return F.least(F.lit(100), F.floor(points + 0.5)).cast("int")


def duration(ms: Column) -> Column:
    d, h, m = (F.floor(x).cast("string") for x in (ms / DAY_MS, ms % DAY_MS / HOUR_MS, ms % HOUR_MS / MINUTE_MS))
    two = lambda a, x, b, y: F.concat(a, F.lit(x), b, F.lit(y))
    return (
        F.when(d.cast("int") > 0, F.when(h.cast("int") > 0, two(d, "d ", h, "h")).otherwise(F.concat(d, F.lit(" days"))))
        .when(h.cast("int") > 0, F.when(m.cast("int") > 0, two(h, "h ", m, "m")).otherwise(F.concat(h, F.lit(" hours")))).otherwise(F.concat(m, F.lit(" minutes")))
    )
