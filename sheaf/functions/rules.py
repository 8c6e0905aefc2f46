"""Ordered rule tables as expressions: the first rule that fits decides."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .text import trim

#: Label pattern, strategy, category, role.
LABELS = (
    ("compan(?:y|ies)", "grouped", "company", None),
    ("artists?", "grouped", "artist", None),
    ("distributors?", "individual", "company", "Distributor"),
    ("retailers?", "individual", "company", "Retailer"),
    ("publishers?", "individual", "company", "Publisher"),
    (r"original\s+illustrators?", "individual", "artist", "Illustrator"),
    ("sculptors?", "individual", "artist", "Sculptor"),
    ("illustrators?", "individual", "artist", "Illustrator"),
    ("painters?", "individual", "artist", "Painter"),
    ("designers?", "individual", "artist", "Designer"),
    (r"colou?r(?:\s+producers?)?", "individual", "artist", "Color Producer"),
    ("title", "text", "metadata", None),
    ("origins?", "text", "metadata", None),
    ("version", "text", "metadata", None),
    ("classifications?", "text", "metadata", None),
    ("category", "category", "metadata", None),
    ("materials?", "materials", "metadata", None),
    ("dimensions?", "dimensions", "metadata", None),
    ("various", "tags", "tag", None),
    (r"releases?(?:\s+view\s+all\s+\(\+[0-9]+\)hide)?", "releases", "release", None),
    ("characters?", "skip", "metadata", None),
    ("score", "score", "metadata", None),
    (r"owned\s+by", "count", "metadata", None),
    (r"ordered\s+by", "count", "metadata", None),
    (r"sold\s+by", "skip", "metadata", None),
    (r"wished\s+by", "count", "metadata", None),
    (r"mentioned\s+in", "skip", "metadata", None),
    (r"listed\s+in", "count", "metadata", None),
    (r"average\s+rating", "skip", "metadata", None),
    (r"added\s+by", "skip", "metadata", None),
    (r"last\s+edited\s+by", "skip", "metadata", None),
    ("wishability", "skip", "metadata", None),
    (r"hunted\s+by", "skip", "metadata", None),
    (r"reviewed\s+by", "skip", "metadata", None),
    (r"top\s+[0-9]+", "skip", "metadata", None),
    ("events?", "skip", "metadata", None),
    ("shops?", "skip", "metadata", None),
)
#: Role pattern and its canonical name.
ROLES = (
    ("sculptors?", "Sculptor"), ("illustrators?", "Illustrator"), (r"original\s+illustrators?", "Illustrator"), ("painters?", "Painter"), (r"colou?r(?:\s+producers?)?", "Color Producer"),
    ("designers?", "Designer"), (r"char(?:\.|acter)?\s+designers?", "Character Designer"), (r"ori(?:\.|ginal)?\s+creators?", "Original Creator"), ("manufacturers?", "Manufacturer"),
    ("distributors?", "Distributor"), ("retailers?", "Retailer"), ("publishers?", "Publisher"), ("producers?", "Producer"), ("labels?", "Label"), ("circles?", "Circle"),
    ("cooperations?", "Cooperation"), ("directors?", "Director"), ("photographers?", "Photographer"), ("plannings?", "Planning"), ("mangakas?", "Mangaka"),
)
#: Error class and the substrings that tell it.
ERRORS = (
    ("timeout", ("timeout", "TIMEOUT")),
    ("not_found", ("404", "NOT_FOUND", "not found")),
    ("rate_limited", ("429", "RATE_LIMIT", "rate limit", "CLOUDFLARE", "Cloudflare")),
    ("auth_required", ("AUTH", "authentication", "NSFW")),
    ("network", ("NETWORK", "ERR_", "disconnected")),
)
#: Phrases of challenge pages' titles and bodies.
CHALLENGE_TITLES = (
    "Just a moment", "Please wait", "Checking your browser", "DDoS protection", "Security check", "Verifying you are human", "Challenge in progress", "Browser check", "Un moment", "Bitte warten",
    "Espere por favor", "Attendere prego", "しばらくお待ちください", "Just a sec", "Hold on", "Wait a moment", "One moment please", "Cloudflare", "CF-RAY", "Ray ID",
)
CHALLENGE_BODIES = (
    "Just a moment", "Please wait while we verify", "Checking your browser before accessing", "This process is automatic", "Your browser will redirect automatically",
    "Please enable JavaScript and cookies", "Please turn JavaScript on and reload the page", "DDoS protection by Cloudflare", "Performance & security by Cloudflare", "Your IP", "Ray ID", "Cloudflare Ray ID",
    "verify you are a human", "verify that you are not a robot", "prove you are human", "human verification", "bot detection", "automated requests", "Please enable cookies", "JavaScript required",
    "Please enable JavaScript", "browser does not support JavaScript", "cookies disabled", "Security service", "Website is under attack mode", "High security", "Browser integrity check", "Challenge page",
    "Access denied", "Forbidden", "blocked by security policy", "Por favor espere", "Veuillez patienter", "Bitte warten Sie", "お待ちください", "请等待",
)
TITLE_LEAST, BODY_LEAST = 0.8, 0.7
SYMBOLS = (("¥", "JPY"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("₩", "KRW"))
CODES = "JPY|CNY|USD|EUR|GBP|KRW|TWD|HKD"


def _spellings(pattern: str) -> set[str]:
    """Some of the texts that a pattern fits, in lower case: those with one space where it has any number."""
    out, left = set(), [pattern.replace(r"\s+", " ").replace(r"\.", "\0")]
    while left:
        p = left.pop()
        m = re.search(r"\(\?:([^()]*)\)(\??)|([a-z\0])\?(?!:)", p)
        if m:
            ways = [m[3], ""] if m[3] else [*m[1].split("|"), *([""] if m[2] else [])]
            left += [p[: m.start()] + w + p[m.end() :] for w in ways]
        elif re.fullmatch("[a-z \0]+", p):
            out.add(p.replace("\0", "."))
    return out


def _first(c: Column, table, value) -> Column:
    """Of the first row whose pattern fits.  The usual spellings are looked up; only other texts are tried pattern by pattern."""
    rows = list(table)
    usual = {s: next(r for p, *r in rows if re.fullmatch(p, s)) for p, *_ in rows for s in _spellings(p)}
    lower = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    known = F.create_map(*(x for s, r in sorted(usual.items()) for x in (F.lit(s), value(r))))
    return F.coalesce(F.try_element_at(known, lower), _tried(c, rows, value))


def _tried(c: Column, table, value) -> Column:
    out = None
    for pattern, *rest in table:
        test = c.rlike(rf"(?i)^(?:{pattern})\z")
        out = F.when(test, value(rest)) if out is None else out.when(test, value(rest))
    return out


def label_rule(label: Column) -> Column:
    """prio (from 1), strategy, category and role of a trimmed label; null for an unknown one.  Many patterns are tried on
    it, so it should be a column, not an expression."""
    table = [(p, i, s, c, r) for i, (p, s, c, r) in enumerate(LABELS, 1)]
    return _first(label, table, lambda r: F.struct(F.lit(r[0]).alias("prio"), F.lit(r[1]).alias("strategy"), F.lit(r[2]).alias("category"), F.lit(r[3]).cast("string").alias("role")))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(LABELS, 1)], "prio int, pattern string, strategy string, category string, role string")


def role_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(ROLES, 1)], "prio int, pattern string, role string")


#: Rules of a table that are broadcast at once.
RULES_AT_ONCE = 10_000


def match_rules(rows: DataFrame, text: str, table: DataFrame, name: str = "rule") -> DataFrame:
    """``rows`` with ``name``, the first rule by ``prio`` whose ``pattern`` fits the whole trimmed text, whatever its case; a
    struct of the table's columns but the pattern, null where none fits.

    ``table`` is data: ``registry`` or ``role_table``, or either with a user's rows unioned in (of equal priorities the
    smaller pattern counts).  Each distinct text is tried once; a table longer than ``RULES_AT_ONCE`` is tried in parts.
    Null texts fit nothing.
    """
    known = table.withColumn("_part", F.lit(0))
    parts = -(-table.count() // RULES_AT_ONCE)
    if parts > 1:
        known = written(table.withColumn("_part", F.pmod(F.xxhash64("prio", "pattern"), F.lit(parts)).cast("int")), "rules")
    kept = [c for c in table.columns if c != "pattern"]
    texts = rows.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    texts = written(texts, "texts") if parts > 1 else texts
    fits = F.rlike(trim("_text"), F.concat(F.lit("(?i)^(?:"), F.col("pattern"), F.lit(r")\z")))
    tried = [texts.join(F.broadcast(known.where(F.col("_part") == k)), fits) for k in range(max(1, parts))]
    every = tried[0]
    for more in tried[1:]:
        every = every.unionByName(more)
    first = every.groupBy("_text").agg(F.min_by(F.struct(*kept), F.struct("prio", "pattern")).alias(name))
    return rows.join(first, rows[text] == first["_text"], "left").drop("_text")


def role_name(role: Column) -> Column:
    """The usual name of a trimmed role, itself if there is none; also better a column."""
    return F.coalesce(_first(role, ROLES, lambda r: F.lit(r[0])), role)


def error_class(message: Column) -> Column:
    out = None
    for kind, parts in ERRORS:
        test = message.contains(parts[0])
        for p in parts[1:]:
            test = test | message.contains(p)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def retry_eligible(kind: Column, retries: Column, most: Column) -> Column:
    return (kind != "auth_required") & (retries < most) & kind.isin("timeout", "rate_limited", "network", "unknown")


def symbol_currency(text: Column) -> Column:
    out = None
    for sign, code in SYMBOLS:
        out = F.when(text.contains(sign), code) if out is None else out.when(text.contains(sign), code)
    return out


def phrase_match(text: Column, phrase: str, least: float) -> Column:
    """The phrase is in the text, or the two are similar.  Similarity is bounded by the lengths' ratio, so edits are
    counted only where the ratio allows, and no further than they may go; ``text`` is collapsed already."""
    n = len(phrase)
    length = F.char_length(text)
    near = (length * least <= n) & (length >= n * least)
    edits = F.levenshtein(text, F.lit(phrase), int((1 - least) * n / least + 1e-9))
    longest = F.greatest(length, F.lit(n))
    alike = (edits >= 0) & ((longest - edits) / longest >= least)
    return F.when(text == "", False).when(text.contains(phrase), True).when(near, alike).otherwise(False)


def challenge_page(title: Column, body: Column, titles: tuple = (), bodies: tuple = ()) -> Column:
    """Does the page ask the visitor to wait or prove something instead of showing content?  Both texts are collapsed."""
    out = F.lit(False)
    for text, phrases, least in ((title, (*titles, *CHALLENGE_TITLES), TITLE_LEAST), (body, (*bodies, *CHALLENGE_BODIES), BODY_LEAST)):
        for p in dict.fromkeys(" ".join(p.lower().split()) for p in phrases):
            out = out | F.coalesce(phrase_match(text, p, least), F.lit(False))
    return out


def lane(status: Column, nsfw: Column, orphan: Column) -> Column:
    return F.when(F.coalesce(orphan, F.lit(False)), "COLD").when(F.coalesce(nsfw, F.lit(False)), "HOT").when(status == "wished", "COLD").otherwise("WARM")


def lane_rank(c: Column) -> Column:
    return F.when(c == "HOT", 3).when(c == "WARM", 2).when(c == "COLD", 1)


def score(status: Column, has_session: Column, users: Column, age_minutes: Column) -> Column:
    """Standing of a request within its lane."""
    return F.when(status == "owned", 30).when(status == "ordered", 20).otherwise(10) + F.when(has_session, 20).otherwise(0) + F.least(F.lit(20), users * 5) + F.least(F.lit(10.0), age_minutes)


#: Why a session fails, how sure that is, what a user is told, and whether the site can be reached.
DIAGNOSES = {
    "overloaded": (0.85, "The site seems to be overloaded: pages that need no session fail too.", False),
    "expired": (0.9, "The site answers, but requests of this session fail: it has probably expired.", True),
    "unknown": (0.5, "The site answers; the failure may have been a passing one.", True),
}


def diagnosis(probe_ok: Column, failures: Column) -> Column:
    """diagnosis, confidence, explanation and reachable."""
    whole = lambda k: F.struct(F.lit(k).alias("diagnosis"), *(F.lit(v).alias(n) for n, v in zip(("confidence", "explanation", "reachable"), DIAGNOSES[k], strict=True)))
    return F.when(~probe_ok, whole("overloaded")).when(failures > 0, whole("expired")).otherwise(whole("unknown"))


def webhook_delay_ms(retry_after_s: Column, attempt: Column) -> Column:
    return F.coalesce(retry_after_s * 1000, F.pow(F.lit(2), attempt) * 1000).cast("bigint")
