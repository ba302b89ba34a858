"""Text, URL and hash functions: Column to Column, all built-in expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole words removed from company names and titles, the abbreviations expanded in titles, and parameters that addresses lose.
COMPANY_SUFFIXES = "co corp corporation global group inc incorporated india labs limited llc llp ltd private pvt services software solutions systems technologies technology".split()
TITLE_NOISE = [
    "apply now", "experienced", "female", "fresher", "hiring", "immediate", "immediate joiners", "immediately", "job", "jobs", "joiner", "joiners", "male", "opening", "openings", "opportunity",
    "req", "required", "urgent", "urgently", "vacancies", "vacancy", "wfh", "work from home",
]
TITLE_ABBREVIATIONS = [
    ("sr", "senior"), ("jr", "junior"), ("dev", "developer"), ("engg?", "engineer"), ("mgr", "manager"), ("arch", "architect"),
    ("swe", "software engineer"), ("sde", "software engineer"), ("fullstack", "full stack"), ("nodejs", "node js"),
]
TRACKING_PARAMETERS = (
    "fbclid gclid pagenum position ref referrer searchid session_id sid source src trackingid trk utm_campaign utm_content utm_id utm_medium utm_source utm_term"
).split()
# Forms of credentials that must not be shown.
SECRET_PATTERNS = [
    r"sk-or-v1-[A-Za-z0-9_-]{8,}",
    r"sk-[A-Za-z0-9]{20,}",
    r"AIza[A-Za-z0-9_-]{20,}",
    r"AQ\.[A-Za-z0-9_-]{20,}",
    r"ghp_[A-Za-z0-9]{20,}",
    r"(?i)Bearer\s+[A-Za-z0-9._-]{12,}",
    r"(?i)\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s@]+@",
]
# Ranks of log levels.
LOG_LEVELS = {"debug": 10, "info": 20, "warn": 30, "error": 40}
# Tags that end a line, and entities with their characters.
BLOCK_TAGS = "p div br li tr h[1-6] section article ul ol table".split()
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
_SPACE = r"\s\p{Z}\uFEFF"


def _decomposed(text: str) -> str:
    """Compatibility decomposition without combining accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not "\u0300" <= c <= "\u036f")


def key_of(text: str | None) -> str:
    """:func:`normalize_key` of a Python string."""
    return " ".join(re.findall("[a-z0-9]+", _decomposed((text or "").lower())))


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Lower-case characters that decompose into one letter or digit, those, and the characters that decompose into several with some among them."""
    one, several = [], {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        flat = re.sub("[^a-z0-9]", " ", _decomposed(c)) if c == c.lower() else ""
        if len(flat) == 1 and flat != " ":
            one.append((c, flat))
        elif flat.strip():
            several[c] = flat
    return "".join(p[0] for p in one), "".join(p[1] for p in one), several


_FROM, _TO, _SEVERAL = _fold_tables()


def trim_ws(c: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.regexp_replace(c, rf"^[{_SPACE}]+|[{_SPACE}]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_ws(c.cast("string")), F.lit(""))


def fold_accents(c: Column) -> Column:
    """Lower-case text without accents; ligatures and the like as their letters. All built in; the letter-wise way only where such a character occurs."""
    flat = F.translate(c, _FROM, _TO)
    known = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    apart = F.array_join(F.transform(F.split(flat, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    some = flat.rlike(r"[^\x00-\x7F]") & (F.length(F.translate(flat, "".join(_SEVERAL), "")) < F.length(flat))
    return F.regexp_replace(F.when(some, apart).otherwise(flat), "[\u0300-\u036f]", "")


def normalize_key(c: Column) -> Column:
    """Lower case, no accents, runs of other characters as one space; null as ''."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def _without(c: Column, words: list[str]) -> Column:
    gone = F.regexp_replace(c, rf"\b(?:{'|'.join(sorted(words, key=lambda w: (-len(w), w)))})\b", " ")
    return F.trim(F.regexp_replace(gone, " +", " "))


def normalize_company(c: Column) -> Column:
    return _without(normalize_key(c), COMPANY_SUFFIXES)


def normalize_title(c: Column) -> Column:
    out = _without(normalize_key(c), TITLE_NOISE)
    for short, full in TITLE_ABBREVIATIONS:
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    return F.trim(F.regexp_replace(out, " +", " "))


def normalize_url(c: Column) -> Column:
    """One form per address: https, no www., usual port, fragment, tracking or trailing slash; parameters sorted by name; lower case.

    Parameters of one name keep their order; one without ``=`` gets it. Null gives
    ''. What has no scheme and host is trimmed, lower-cased and freed of trailing
    slashes.
    """
    s = trim_ws(F.coalesce(c, F.lit("")))
    part = lambda k: F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@\s]*)@)?([^/?#\s]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(3)), r"^www\.", ""), F.when(F.lower(part(1)) == "http", ":80$").otherwise(":443$"), "")
    path = F.replace(F.when(part(4) == "", "/").otherwise(part(4)), F.lit(" "), F.lit("%20"))
    named = F.transform(F.filter(F.split(part(5), "&"), lambda p: p != ""), lambda p, k: F.struct(F.substring_index(p, "=", 1).alias("name"), k.alias("k"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.array_sort(F.filter(named, lambda p: ~F.lower(p["name"]).isin(*TRACKING_PARAMETERS)))
    query = F.replace(F.array_join(F.transform(kept, lambda p: p["p"]), "&"), F.lit(" "), F.lit("+"))
    login = F.when(part(2) != "", F.concat(part(2), F.lit("@"))).otherwise("")
    url = F.concat(F.lit("https://"), login, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.lower(F.when(part(3) != "", F.regexp_replace(url, "/$", "")).otherwise(F.regexp_replace(s, "/+$", "")))


def html_to_text(c: Column) -> Column:
    """Readable text of an HTML fragment: blocks as lines, entities decoded, spaces collapsed, at most one empty line."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        t = F.regexp_replace(t, f"(?i){entity}", char)
    t = F.regexp_replace(t, "[ \t\u00a0\u2000-\u200b]+", " ")
    t = F.regexp_replace(t, rf"\n[{_SPACE}]*\n[{_SPACE}]*\n+", "\n\n")
    t = F.regexp_replace(t, rf"[{_SPACE}&&[^\n]]*\n[{_SPACE}&&[^\n]]*", "\n")
    return trim_ws(t)


def truncate_words(c: Column, n: int, marker: str = "\n[...description truncated...]") -> Column:
    """At most n characters, cut at the last space if that lies in the last fifth, with a marker."""
    cut = F.substring(c, 1, n)
    last = n - F.instr(F.reverse(cut), " ")
    body = F.when((F.instr(cut, " ") > 0) & (last > 0.8 * n), cut.substr(F.lit(1), last)).otherwise(cut)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(body, rf"[{_SPACE}]+$", ""), F.lit(marker)))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' words; 0 if either has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def first_keyword(c: Column, keywords: list[str]) -> Column:
    """The first keyword, in the list's order, that occurs as whole words once both are normalised; null if none.

    A keyword of several words may also begin or end inside a word.
    """
    text = F.concat(F.lit(" "), normalize_key(c), F.lit(" "))
    keys = [(k, key_of(k)) for k in keywords]
    found = [F.when(text.contains(x if " " in x else f" {x} "), F.lit(k)) for k, x in keys if x]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def fingerprint(company: Column, title: Column, location: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("|", normalize_company(company), normalize_title(title), normalize_key(location), normalize_url(url)), 256)


def content_hash(title: Column, company: Column, description: Column, pay: Column, experience: Column, skills: Column) -> Column:
    """A hash of what a posting says, whatever the order of its skills."""
    listed = F.array_join(F.array_sort(F.transform(F.coalesce(skills, F.array().cast("array<string>")), normalize_key)), ",")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("|", normalize_title(title), normalize_company(company), normalize_key(description), normalize_key(pay), normalize_key(experience), blank(listed)), 256)


def escape_like(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def redact(c: Column) -> Column:
    """The text with every credential replaced by a mark."""
    for pattern in SECRET_PATTERNS:
        c = F.regexp_replace(c, pattern, F.lit("[REDACTED]"))
    return c


def level_at_least(level: Column, least: str) -> Column:
    """Whether a log line of a level is shown; unknown levels aren't."""
    known = F.create_map(*[F.lit(x) for pair in LOG_LEVELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(level)) >= LOG_LEVELS[least], F.lit(False))


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("bigint")


def richness(description: Column, pay: Column, experience: Column, location: Column, remote: Column, skills: Column, posted: Column, apply_url: Column) -> Column:
    """How much a record says, for choosing between two of the same."""
    flag = lambda c, w: F.when(c.isNotNull(), F.lit(w)).otherwise(0)
    listed = F.greatest(F.coalesce(F.size(skills), F.lit(0)), F.lit(0))
    return F.coalesce(F.length(description), F.lit(0)) + flag(pay, 500) + flag(experience, 500) + flag(location, 200) + flag(remote, 200) + listed * 50 + flag(posted, 100) + flag(apply_url, 100)
