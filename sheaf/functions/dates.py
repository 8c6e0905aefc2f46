"""Dates of catalog pages, lists and releases.  Days and months beyond the calendar roll over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import group, trim

#: Accepted month spellings.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}


def rolled(year: Column, month: Column, day: Column) -> Column:
    """A date of any month and day numbers; two-digit years are of the 1900s."""
    year = F.when(year < 100, year + 1900).otherwise(year)
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)


def _int(c: Column, pattern: str, i: int) -> Column:
    return group(c, pattern, i).try_cast("int")


def month_number(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(table, F.lower(name))


def catalog_date(text: Column) -> Column:
    """M/D/YYYY, M/YYYY (its first day), an ISO date, or what ``free_date`` reads."""
    full, month = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z", r"^([0-9]{1,2})/([0-9]{4})\z"
    return F.coalesce(
        rolled(_int(text, full, 3), _int(text, full, 1), _int(text, full, 2)),
        rolled(_int(text, month, 2), _int(text, month, 1), F.lit(1)),
        group(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})").try_cast("date"),
        free_date(text),
    )


def free_date(text: Column) -> Column:
    """A date in words or other separators: March 5, 2024; 5 Mar 2024; Tue Mar 05 2024; March 2024; 2024/3/5; 3-5-24; 2024-03; 2024.

    Months go by their first three letters, years of two digits are 2000 to 2049 and 1950 to 1999, absent days are the
    first.  Days up to 31 roll over into the next month; beyond that, and for months beyond 12, there is no date.
    """
    t = F.regexp_replace(trim(text), r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+", "")
    year, word = r"([0-9]{4}|[0-9]{2})", r"([A-Za-z]{3,})\.?"
    named = (  # pattern, then which group is the year, the month and the day
        (rf"^{word}\s+([0-9]{{1,2}}),?\s+{year}\z", 3, 1, 2),
        (rf"^([0-9]{{1,2}})[\s-]+{word},?[\s-]+{year}\z", 3, 2, 1),
        (rf"^{word},?\s+([0-9]{{4}})\z", 2, 1, None),
    )
    numbers = (
        (r"^([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})\z", 1, 2, 3),
        (rf"^([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]{year}\z", 3, 1, 2),
        (r"^([0-9]{4})-([0-9]{1,2})\z", 1, 2, None),
        (r"^([0-9]{4})\z", 1, None, None),
    )
    short = F.create_map(*(F.lit(x) for n in range(1, 13) for x in (next(k for k, v in MONTHS.items() if v == n)[:3], n)))

    def read(pattern: str, y: int, m: int | None, d: int | None, words: bool) -> Column:
        month = F.lit(1) if m is None else F.try_element_at(short, F.lower(F.substring(group(t, pattern, m), 1, 3))) if words else _int(t, pattern, m)
        day = F.lit(1) if d is None else _int(t, pattern, d)
        n = _int(t, pattern, y)
        n = F.when(F.char_length(group(t, pattern, y)) == 4, n).when(n < 50, n + 2000).otherwise(n + 1900)
        return F.when(month.between(1, 12) & day.between(1, 31), rolled(n, month, day))

    return F.coalesce(*(read(*x, True) for x in named), *(read(*x, False) for x in numbers))


def list_time(text: Column) -> Column:
    """MM/DD/YYYY, HH:MM:SS in UTC as an ISO text with milliseconds."""
    t, p = trim(text), r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}),\s*([0-9]{2}):([0-9]{2}):([0-9]{2})\z"
    m, d = _int(t, p, 1), _int(t, p, 2)
    day = F.when(m.between(1, 12) & d.between(1, 31), rolled(_int(t, p, 3), m, d))
    seconds = F.unix_date(day).cast("bigint") * 86400 + _int(t, p, 4) * 3600 + _int(t, p, 5) * 60 + _int(t, p, 6)
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def release_date(text: Column) -> Column:
    """YYYY, YYYY-MM, YYYY-MM-DD, Month YYYY or YYYY Month."""
    t = trim(text)
    iso, month_year, year_month = r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?\z", r"^([A-Za-z]+)\s*([0-9]{4})\z", r"^([0-9]{4})\s*([A-Za-z]+)\z"
    return F.coalesce(
        rolled(_int(t, iso, 1), F.coalesce(_int(t, iso, 2), F.lit(1)), F.coalesce(_int(t, iso, 3), F.lit(1))),
        rolled(_int(t, month_year, 2), month_number(group(t, month_year, 1)), F.lit(1)),
        rolled(_int(t, year_month, 1), month_number(group(t, year_month, 2)), F.lit(1)),
    )
