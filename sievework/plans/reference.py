"""Queries of the general operators over the tables, each with SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonfn, parse
from ..functions import text as fn
from ..operators import greedy, keyed
from ..session import table
from ..sources import readers, sinks
from ..streaming.ingest import latest_events, replay, windowed_counts
from . import readmodel

#: The moment from which the tables are looked at.
NOW = dt.datetime(2026, 9, 12)
_BUILT: dict[str, tuple] = {}


def query(sql: str | None):
    """Register a query of (tables) under its function's name, with its SQL."""

    def add(f):
        _BUILT[f.__name__] = ((lambda spark, sf_dir, f=f: f(lambda name: table(spark, sf_dir, name))), sql)
        return f

    return add


_KEY = "trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"
_SUFFIX = r"\b(?:" + "|".join(sorted(fn.COMPANY_SUFFIXES, key=lambda w: (-len(w), w))) + r")\b"
_NOISE = r"\b(?:" + "|".join(sorted(fn.TITLE_NOISE, key=lambda w: (-len(w), w))) + r")\b"


def _sql_without(x: str, pattern: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{pattern}', ' ', 'g'), ' +', ' ', 'g'))"


def _sql_company(c: str) -> str:
    return _sql_without(_KEY.format(c), _SUFFIX)


def _sql_title(c: str) -> str:
    x = _sql_without(_KEY.format(c), _NOISE)
    for short, full in fn.TITLE_ABBREVIATIONS:
        x = rf"regexp_replace({x}, '\b{short}\b', '{full}', 'g')"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


_TRACK = "[" + ", ".join(f"'{p}'" for p in fn.TRACKING_PARAMETERS) + "]"
# the address in parts cut at '://', '#', '?' and '/', without a pattern for the whole
_URL = """CASE WHEN u IS NULL OR instr(u, '://') < 2 THEN regexp_replace(lower(coalesce(u, '')), '/+$', '')
 ELSE lower(rtrim_one('https://' || host || path || CASE WHEN len(pairs) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(pairs), lambda p: p.p), '&') END)) END""".replace("rtrim_one(", "regexp_replace(").replace("END))", "END, '/$', ''))")
_WITH_Q = f"""(SELECT * EXCLUDE (rest), regexp_replace(lower(string_split(rest, '/')[1]), '^www\\.', '') AS host, CASE WHEN instr(rest, '/') = 0 THEN '/' ELSE substring(rest, instr(rest, '/')) END AS path FROM (
 SELECT *, string_split(substring(no_hash, instr(no_hash, '://') + 3), '?')[1] AS rest,
 list_filter([struct_pack(name := string_split(p, '=')[1], k := k, p := CASE WHEN instr(p, '=') > 0 THEN p ELSE p || '=' END) FOR p, k IN string_split(CASE WHEN instr(no_hash, '?') > 0 THEN substring(no_hash, instr(no_hash, '?') + 1) ELSE '' END, '&') IF p <> ''], lambda x: NOT list_contains({_TRACK}, lower(x.name))) AS pairs
 FROM (SELECT *, trim(url) AS u, string_split(trim(url), '#')[1] AS no_hash FROM jobs)))"""


@query(f"SELECT id, {_URL} AS url_key FROM {_WITH_Q}")
def normalize_url(t) -> DataFrame:
    return t("jobs").select("id", fn.normalize_url(F.col("url")).alias("url_key"))


@query(f"SELECT {_URL} AS url_key, min(id) AS first_id, count(*) AS n FROM {_WITH_Q} GROUP BY 1")
def canonical_url_first(t) -> DataFrame:
    return t("jobs").groupBy(fn.normalize_url(F.col("url")).alias("url_key")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


_HTML = "coalesce(description, '')"
for _p, _r, _f in ((r"(?s)<script.*?</script>|<style.*?</style>", " ", "gi"), (r"</?(?:p|div|br|li|tr|h[1-6]|section|article|ul|ol|table)[^>]*>", "\n", "gi"), ("<[^>]+>", " ", "g")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_r}', '{_f}')"
for _e, _c in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    _HTML = f"regexp_replace({_HTML}, '{_e}', '{_c}', 'gi')"
# lines are trimmed one by one, then runs of empty ones are cut to one
_HTML = f"trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace({_HTML}, '[ \\t\\x{{00a0}}\\x{{2000}}-\\x{{200b}}]+', ' ', 'g'), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9))"


@query(f"SELECT id, {_HTML} AS plain FROM jobs")
def html_to_text(t) -> DataFrame:
    return t("jobs").select("id", fn.html_to_text(F.col("description")).alias("plain"))


@query("""SELECT id, CASE WHEN length(description) <= 200 THEN description ELSE rtrim(CASE WHEN instr(c, ' ') > 0 AND 200 - instr(reverse(c), ' ') > 160
 THEN substring(c, 1, 200 - instr(reverse(c), ' ')) ELSE c END) || chr(10) || '[...description truncated...]' END AS short FROM (SELECT id, description, substring(description, 1, 200) AS c FROM jobs)""")
def truncate_words(t) -> DataFrame:
    return t("jobs").select("id", fn.truncate_words(F.col("description"), 200).alias("short"))


def _sql_tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split({_KEY.format(c)}, ' '), lambda w: w <> ''))"


@query(f"""SELECT id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9) END AS similarity
 FROM (SELECT id, {_sql_tokens('title')} AS a, {_sql_tokens('description')} AS b FROM jobs)""")
def token_similarity(t) -> DataFrame:
    return t("jobs").select("id", F.round(fn.token_similarity(fn.normalize_key(F.col("title")), fn.normalize_key(F.col("description"))), 9).alias("similarity"))


_WORDS = ["night shift", "kafka", "payments"]


@query("SELECT id, CASE " + " ".join(f"WHEN contains(k, ' {w} ')" + (f" OR contains(k, '{w}')" if " " in w else "") + f" THEN '{w}'" for w in _WORDS) + f" END AS keyword FROM (SELECT id, ' ' || {_KEY.format('concat_ws(chr(32), title, description)')} || ' ' AS k FROM jobs)")
def first_keyword(t) -> DataFrame:
    return t("jobs").select("id", fn.first_keyword(F.concat_ws(" ", "title", "description"), _WORDS).alias("keyword"))


@query(f"SELECT id, sha256(concat_ws('|', {_sql_company('company')}, {_sql_title('title')}, {_KEY.format('location')}, {_URL})) AS fp FROM {_WITH_Q}")
def fingerprint(t) -> DataFrame:
    return t("jobs").select("id", fn.fingerprint(*map(F.col, ("company", "title", "location", "url"))).alias("fp"))


@query(f"""SELECT id, sha256(concat_ws('|', {_sql_title('title')}, {_sql_company('company')}, {_KEY.format('description')}, {_KEY.format('salary.raw')}, {_KEY.format('experience_required.raw')},
 coalesce(array_to_string(list_sort(list_transform(skills, lambda s: {_KEY.format('s')})), ','), ''))) AS hash FROM jobs""")
def content_hash(t) -> DataFrame:
    c = fn.content_hash(F.col("title"), F.col("company"), F.col("description"), F.col("salary.raw"), F.col("experience_required.raw"), F.col("skills"))
    return t("jobs").select("id", c.alias("hash"))


@query("SELECT id, replace(replace(replace(title, chr(92), chr(92) || chr(92)), '%', chr(92) || '%'), '_', chr(92) || '_') AS escaped FROM jobs")
def escape_like(t) -> DataFrame:
    return t("jobs").select("id", fn.escape_like(F.col("title")).alias("escaped"))


@query("SELECT doc_id, concat_ws(' ', text, 'keys [REDACTED] [REDACTED] [REDACTED], [REDACTED] [REDACTED] [REDACTED]; [REDACTED]host.example/x sk-short') AS safe FROM documents")
def redact(t) -> DataFrame:
    n = F.lpad(F.col("doc_id").cast("string"), 24, "A")
    planted = ["keys sk-or-v1-", n, " sk-", n, " AIza", n, ", AQ.", n, " ghp_", n, " bearer ", n, "; https://user:", n, "@host.example/x sk-short"]
    return t("documents").select("doc_id", fn.redact(F.concat_ws(" ", "text", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in planted]))).alias("safe"))


@query("SELECT source, sum(greatest(1, ceil(length(text) / 4.0)))::BIGINT AS tokens FROM documents GROUP BY source")
def estimated_tokens(t) -> DataFrame:
    return t("documents").groupBy("source").agg(F.sum(fn.estimated_tokens(F.col("text"))).alias("tokens"))


# by looking for padded words, not by the engine's patterns
_PLACE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(x, ' {w.replace('%', '').replace('-', ' ')} ')" for w in words) + f" THEN '{kind}'" for kind, words in parse.PLACES) + " END"


@query(f"SELECT id, {_PLACE} AS place FROM (SELECT id, ' ' || regexp_replace(lower(concat_ws(' ', title, location)), '[^a-z0-9_]+', ' ', 'g') || ' ' AS x FROM jobs)")
def work_place(t) -> DataFrame:
    return t("jobs").select("id", parse.work_place(F.col("title"), F.col("location")).alias("place"))


@query(r"""WITH x AS (SELECT id, lower(trim(experience_required.raw)) AS t FROM jobs),
 y AS (SELECT id, t, list_transform(regexp_extract_all(t, '\d+(?:\.\d+)?'), lambda n: n::DOUBLE) AS f, regexp_replace(t, '\d+(\.\d+)?', '#', 'g') AS shape FROM x)
 SELECT id, CASE WHEN contains(shape, 'fresher') OR contains(shape, 'no experience') OR t = '0 years' THEN 0.0 WHEN shape SIMILAR TO '.*# ?(-|to) ?#.*' THEN least(f[1], f[2]) WHEN contains(shape, 'max') OR contains(shape, 'up to') THEN NULL ELSE f[1] END AS min_years,
 CASE WHEN shape SIMILAR TO '.*# ?(-|to) ?#.*' THEN greatest(f[1], f[2]) WHEN contains(shape, 'max') OR contains(shape, 'up to') THEN f[1] END AS max_years FROM y""")
def experience_range(t) -> DataFrame:
    x = t("jobs").select("id", parse.experience_range(F.col("experience_required.raw")).alias("e"))
    return x.select("id", "e.min_years", "e.max_years")


@query("""SELECT id, CASE WHEN d <= 0 OR id % 5 = 4 THEN TIMESTAMP '2026-09-12' WHEN id % 5 = 0 THEN TIMESTAMP '2026-09-12' - to_days(7 * (d // 7)) WHEN id % 5 = 1 THEN TIMESTAMP '2026-09-12' - to_days(30 * (d // 30))
 WHEN id % 5 = 2 THEN first_seen_at::DATE::TIMESTAMP ELSE TIMESTAMP '2026-09-12' - to_days(CASE WHEN d = 1 THEN 1 ELSE d END) END AS posted_time
 FROM (SELECT id, first_seen_at, date_diff('day', first_seen_at::DATE, DATE '2026-09-12')::INTEGER AS d FROM jobs WHERE first_seen_at IS NOT NULL)""")
def posted_at(t) -> DataFrame:
    d, kind = F.datediff(F.lit(NOW.date()), F.col("first_seen_at").cast("date")), F.col("id") % 5
    ago = lambda n, unit: F.concat(F.lit("Posted "), F.floor(n).cast("string"), F.lit(f" {unit} ago"))
    told = F.when((d <= 0) | (kind == 4), F.when(d % 2 == 0, "Just now").otherwise("3 hours ago")).when(kind == 0, ago(d / 7, "weeks")).when(kind == 1, ago(d / 30, "months")).when(kind == 2, F.date_format("first_seen_at", "yyyy-MM-dd")).when(d == 1, "Yesterday").otherwise(ago(d, "days"))
    at = parse.posted_at(told, F.lit(NOW).cast("timestamp_ntz")).cast("timestamp_ntz")
    return t("jobs").where("first_seen_at is not null").select("id", at.alias("posted_time"))


@query("SELECT id, array_to_string(list_distinct_in_order, '|') AS listed FROM (SELECT id, [x FOR x, i IN s IF list_position(s, x) = i] AS list_distinct_in_order FROM (SELECT id, list_filter(list_transform(coalesce(skills, []), lambda x: trim(x)), lambda x: x <> '') AS s FROM jobs))")
def skills_list(t) -> DataFrame:
    typed = F.concat(F.array_join("skills", " ; "), F.lit(" |, ;"), F.array_join("skills", ","))  # every skill twice, and blanks
    return t("jobs").select("id", F.array_join(F.coalesce(parse.skills_list(typed), F.array()), "|").alias("listed"))


_RICH = """coalesce(length(description), 0) + CASE WHEN salary IS NULL THEN 0 ELSE 500 END + CASE WHEN experience_required IS NULL THEN 0 ELSE 500 END + CASE WHEN location IS NULL THEN 0 ELSE 200 END
 + CASE WHEN remote IS NULL THEN 0 ELSE 200 END + coalesce(len(skills), 0) * 50 + CASE WHEN posted_at IS NULL THEN 0 ELSE 100 END + CASE WHEN application_url IS NULL THEN 0 ELSE 100 END"""


def _rich() -> Column:
    return fn.richness(*map(F.col, ("description", "salary", "experience_required", "location", "remote", "skills", "posted_at", "application_url")))


@query(f"SELECT h, id, rich FROM (SELECT lower(trim(content_hash)) AS h, id, ({_RICH})::BIGINT AS rich, row_number() OVER (PARTITION BY lower(trim(content_hash)) ORDER BY ({_RICH}) DESC, id) AS rn FROM jobs WHERE content_hash IS NOT NULL) WHERE rn = 1")
def richest_per_hash(t) -> DataFrame:
    x = t("jobs").where("content_hash is not null").select(F.lower(F.trim("content_hash")).alias("h"), F.col("id"), _rich().cast("bigint").alias("rich"))
    return x.groupBy("h").agg(F.max(F.struct("rich", (-F.col("id")).alias("k"))).alias("m")).select("h", (-F.col("m.k")).alias("id"), "m.rich")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, coalesce(json_extract_string(props, '$.none'), 'default') AS other FROM events")
def json_props(t) -> DataFrame:
    p = jsonfn.json_or(F.col("props"), "k bigint, none string", F.named_struct(F.lit("k"), F.lit(None).cast("bigint"), F.lit("none"), F.lit(None).cast("string")))
    return t("events").select("event_id", p["k"].alias("k"), F.coalesce(p["none"], F.lit("default")).alias("other"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, NULL::VARCHAR AS stage FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, 'extract' FROM events WHERE event_id % 2 <> 0")
def json_from_noise(t) -> DataFrame:
    noisy = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('<think>{"k": 0}</think> Answer:\n```json\n'), "props", F.lit("\n``` done"))).otherwise("no answer")
    p = jsonfn.parsed(noisy, "k bigint")
    return t("events").select("event_id", p.alias("p")).select("event_id", "p.value.k", "p.stage")


# ---- keyed operators


@query("SELECT job_id, id, score, recommendation FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS rn FROM job_evaluations) WHERE rn = 1")
def latest_evaluation(t) -> DataFrame:
    return readmodel.latest_evaluations(t("job_evaluations")).select("job_id", "id", "score", "recommendation")


@query("SELECT h, local_model, id FROM (SELECT lower(trim(content_hash)) AS h, local_model, id, row_number() OVER (PARTITION BY lower(trim(content_hash)), local_model ORDER BY created_at DESC, id DESC) AS rn FROM job_evaluations) WHERE rn = 1")
def latest_per_hash_and_model(t) -> DataFrame:
    e = t("job_evaluations").select(F.lower(F.trim("content_hash")).alias("h"), "local_model", "created_at", "id")
    return keyed.latest(e, ["h", "local_model"], ["created_at", "id"]).select("h", "local_model", "id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event(t) -> DataFrame:
    return keyed.latest(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT k, id FROM (SELECT upper(trim(external_id)) AS k, id, row_number() OVER (PARTITION BY source, upper(trim(external_id)) ORDER BY id) AS rn FROM jobs) WHERE rn = 1")
def first_per_key(t) -> DataFrame:
    x = t("jobs").select("source", F.upper(F.trim("external_id")).alias("k"), "id")
    return keyed.first_by(x, ["source", "k"], [F.col("id")]).select("k", "id")


_SNAP = """(SELECT source, upper(regexp_replace(external_id, '^\\s+|\\s+$', '', 'g')) AS k, snapshot_no, max(struct_pack(a := last_seen_at, b := loaded_at, h := lower(trim(content_hash)), f := first_seen_at)) AS m FROM job_snapshots GROUP BY ALL)"""


@query(f"""WITH x AS (SELECT source, k, snapshot_no, m.h AS h, m.f AS f FROM {_SNAP}), l AS (SELECT max(snapshot_no) AS n FROM x),
 o AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY snapshot_no DESC) AS back, row_number() OVER (PARTITION BY source, k ORDER BY snapshot_no) AS fore FROM x),
 s AS (SELECT a.source, a.k, a.h, a.snapshot_no AS n, b.f FROM o a JOIN o b ON a.source = b.source AND a.k IS NOT DISTINCT FROM b.k AND b.fore = 1 WHERE a.back = 1),
 p AS (SELECT source, k, h FROM o WHERE back = 2)
 SELECT s.source, s.k, s.h, s.f AS first_seen_at, CASE WHEN s.n < l.n THEN 'KEPT' WHEN p.source IS NULL THEN 'NEW' WHEN s.h IS DISTINCT FROM p.h THEN 'CHANGED' ELSE 'UNCHANGED' END AS change
 FROM s CROSS JOIN l LEFT JOIN p ON s.source = p.source AND s.k IS NOT DISTINCT FROM p.k""")
def upsert_changes(t) -> DataFrame:
    """The table after every delivery was upserted in turn, with what the last one did to each row."""
    from ..operators.snapshots import trimmed

    order = ["last_seen_at", "loaded_at", "h", "first_seen_at"]
    x = t("job_snapshots").select("source", F.upper(trimmed(F.col("external_id"))).alias("k"), "snapshot_no", "last_seen_at", "loaded_at", F.lower(F.trim("content_hash")).alias("h"), "first_seen_at")
    rows = keyed.latest(x, ["source", "k", "snapshot_no"], order)
    last = rows.agg(F.max("snapshot_no")).first()[0]
    # what all earlier deliveries leave: the state of the latest, the first sight of the earliest
    m = rows.where(F.col("snapshot_no") < last).groupBy("source", "k").agg(F.max(F.struct("snapshot_no", "h")).alias("l"), F.min(F.struct("snapshot_no", "first_seen_at")).alias("f"))
    stored = m.select("source", "k", F.col("l.h").alias("h"), F.col("f.first_seen_at").alias("first_seen_at"))
    return keyed.upsert(stored, rows.where(F.col("snapshot_no") == last).select("source", "k", "h", "first_seen_at"), ["source", "k"], "h", ["first_seen_at"])


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN j.k IS NULL THEN 'NEW' WHEN j.h IS DISTINCT FROM i.h THEN 'CHANGED' ELSE 'UNCHANGED' END AS change FROM (SELECT source, upper(trim(external_id)) AS k, arg_max(lower(trim(content_hash)), incoming_id) AS h FROM incoming_jobs WHERE source IS NOT NULL AND external_id IS NOT NULL GROUP BY ALL) i LEFT JOIN (SELECT source, upper(trim(external_id)) AS k, arg_max(lower(trim(content_hash)), id) AS h FROM jobs GROUP BY ALL) j ON i.source = j.source AND i.k = j.k) GROUP BY change")
def upsert_state_counts(t) -> DataFrame:
    rows = lambda name, i: t(name).select("source", F.upper(F.trim("external_id")).alias("k"), F.col(i).alias("id"), F.lower(F.trim("content_hash")).alias("h")).where("source is not null and k is not null")
    newest = lambda x: x.groupBy("source", "k").agg(F.max_by("h", F.when(F.col("h").isNotNull(), F.col("id"))).alias("h"))
    x = keyed.upsert(newest(rows("jobs", "id")), newest(rows("incoming_jobs", "incoming_id")), ["source", "k"], "h", [])
    return x.where("change != 'KEPT'").groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source, trim(url) AS address FROM incoming_jobs WHERE source IS NOT NULL AND trim(url) <> '' AND (source, trim(url)) NOT IN (SELECT source, trim(url) FROM jobs WHERE url IS NOT NULL AND source IS NOT NULL)")
def insert_absent(t) -> DataFrame:
    rows = lambda name: t(name).where("source is not null").select("source", F.trim("url").alias("address")).where("address != ''")
    return keyed.insert_absent(rows("jobs"), rows("incoming_jobs"), ["source", "address"])


@query("""SELECT DISTINCT source, upper(trim(external_id)) AS k FROM incoming_jobs i WHERE source IS NOT NULL AND external_id IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.source = i.source AND upper(trim(j.external_id)) = upper(trim(i.external_id)))""")
def absent_jobs(t) -> DataFrame:
    keyed_rows = lambda name: t(name).select("source", F.upper(F.trim("external_id")).alias("k")).where("source is not null and k is not null")
    return keyed.insert_absent(keyed_rows("jobs"), keyed_rows("incoming_jobs"), ["source", "k"])


@query("SELECT hit, count(*) AS n FROM (SELECT EXISTS (SELECT 1 FROM job_evaluations e WHERE lower(trim(e.content_hash)) = lower(trim(j.content_hash)) AND e.local_model = 'desk-8b') AS hit FROM jobs j) GROUP BY hit")
def cache_hits(t) -> DataFrame:
    key = F.lower(F.trim("content_hash")).alias("h")
    x = keyed.cache_split(t("jobs").select(key), t("job_evaluations").where("local_model = 'desk-8b'").select(key), ["h"])
    return x.groupBy("hit").agg(F.count("*").alias("n"))


@query("SELECT id, row_number() OVER (ORDER BY created_at, id) AS pos, (row_number() OVER (ORDER BY created_at, id) - 1) // 5 AS batch_id FROM job_evaluations")
def batches(t) -> DataFrame:
    return keyed.batches(t("job_evaluations").select("id", "created_at"), ["created_at", "id"], 5).select("id", "pos", "batch_id")


@query("SELECT id, escalated AND row_number() OVER (PARTITION BY escalated ORDER BY created_at, id) <= 25 AS granted FROM job_evaluations")
def within_budget(t) -> DataFrame:
    return keyed.within_budget(t("job_evaluations").select("id", "created_at", "escalated"), F.col("escalated"), ["created_at", "id"], 25).select("id", "granted")


@query("""WITH p AS (SELECT source, page, count(*) AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY id)) AS sig FROM (SELECT source, id, id // 100 AS page FROM jobs) GROUP BY ALL),
 q AS (SELECT *, (n = 0 OR coalesce(sig = lag(sig) OVER w, false))::INTEGER AS stop, coalesce(n < lag(n) OVER w, false)::INTEGER AS short FROM p WINDOW w AS (PARTITION BY source ORDER BY page)),
 r AS (SELECT *, sum(stop) OVER w + coalesce(sum(short) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM q WINDOW w AS (PARTITION BY source ORDER BY page))
 SELECT source, page, n FROM r WHERE past = 0""")
def page_stops(t) -> DataFrame:
    p = t("jobs").select("source", "id", F.floor(F.col("id") / 100).alias("page")).groupBy("source", "page").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")).alias("sig"))
    return keyed.page_stops(p, "source", "page", "sig", "n").select("source", "page", "n")


# ---- deduplication


def _dedupe(t) -> tuple[DataFrame, DataFrame]:
    key = F.concat_ws("::", "source", F.upper(F.trim("external_id")))
    exact = {"EXTERNAL_ID": F.when(F.col("external_id").isNotNull(), key), "URL": fn.normalize_url(F.col("url")), "FINGERPRINT": F.lower(F.trim("fingerprint"))}
    return greedy.greedy_dedupe(t("jobs"), "id", exact, [fn.normalize_company(F.col("company")), fn.normalize_key(F.col("location"))], fn.normalize_title(F.col("title")), 0.9, _rich(), "first_seen_at", occupants=True)


# one row after the other: founders of slots, their occupants and the occupants' richness as lists, and what was dropped
_DEDUPE = f"""
WITH RECURSIVE x AS MATERIALIZED (SELECT id, first_seen_at, ({_RICH})::BIGINT AS rich, CASE WHEN external_id IS NOT NULL THEN concat_ws('::', source, upper(trim(external_id))) END AS k1, nullif({_URL}, '') AS k2, nullif(lower(trim(fingerprint)), '') AS k3,
 {_sql_company('company')} AS c, {_KEY.format('location')} AS l, string_split({_sql_title('title')}, ' ') AS t FROM {_WITH_Q}),
k AS (SELECT id, 1 AS layer, k1 AS v FROM x UNION ALL SELECT id, 2, k2 FROM x UNION ALL SELECT id, 3, k3 FROM x),
e AS (SELECT a.id, list(struct_pack(layer := a.layer, j := b.id) ORDER BY a.layer, b.id) AS exact FROM k a JOIN k b ON a.layer = b.layer AND a.v = b.v AND b.id < a.id GROUP BY a.id),
d AS (SELECT id, c, l, list_distinct(list_filter(t, lambda w: w <> '')) AS w FROM x),
f AS (SELECT a.id, b.id AS j, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS sim FROM d a JOIN d b ON a.c = b.c AND a.l = b.l AND b.id < a.id WHERE len(a.w) > 0 AND len(b.w) > 0),
g AS (SELECT id, list(struct_pack(far := -sim, j := j)) AS near FROM f WHERE sim >= 0.9 GROUP BY id),
n AS MATERIALIZED (SELECT x.id, rich, row_number() OVER (ORDER BY x.id) AS rn, coalesce(exact, []) AS exact, coalesce(near, []) AS near FROM x LEFT JOIN e USING (id) LEFT JOIN g USING (id)),
r AS (
 SELECT 0::BIGINT AS rn, []::BIGINT[] AS founders, []::BIGINT[] AS occupants, []::BIGINT[] AS rich, NULL::STRUCT(id BIGINT, founder BIGINT, layer INTEGER, sim DOUBLE) AS told
 UNION ALL
 SELECT rn, CASE WHEN slot IS NULL THEN list_append(founders, id) ELSE founders END, CASE WHEN slot IS NULL THEN list_append(occupants, id) WHEN mine > rich[slot] THEN list_concat(occupants[:slot - 1], list_concat([id], occupants[slot + 1:])) ELSE occupants END,
 CASE WHEN slot IS NULL THEN list_append(rich, mine) WHEN mine > rich[slot] THEN list_concat(rich[:slot - 1], list_concat([mine], rich[slot + 1:])) ELSE rich END,
 CASE WHEN slot IS NOT NULL THEN struct_pack(id := id, founder := founders[slot], layer := coalesce(hit.layer, 4), sim := CASE WHEN hit IS NULL THEN -best.far ELSE 1.0 END) END
 FROM (SELECT *, coalesce(list_position(founders, hit.j), best.slot) AS slot FROM (
  SELECT n.rn, n.id, n.rich AS mine, r.founders, r.occupants, r.rich, list_filter(n.exact, lambda y: list_contains(r.founders, y.j))[1] AS hit,
  list_min(list_transform(list_filter(n.near, lambda y: list_contains(r.occupants, y.j)), lambda y: struct_pack(far := y.far, slot := list_position(r.occupants, y.j)))) AS best FROM r JOIN n ON n.rn = r.rn + 1))),
dropped AS (SELECT told.id AS id, told.founder AS founder, ['EXTERNAL_ID', 'URL', 'FINGERPRINT', 'FUZZY'][told.layer] AS strategy, told.sim AS similarity FROM r WHERE told IS NOT NULL)
"""


@query(_DEDUPE + """, slots AS (SELECT x.id, coalesce(d.founder, x.id) AS founder, rich, first_seen_at FROM x LEFT JOIN dropped d USING (id))
 SELECT founder, arg_min(id, struct_pack(a := -rich, b := id)) AS survivor, min(first_seen_at) AS first_seen, count(*) AS n_rows FROM slots GROUP BY founder""")
def dedupe_survivors(t) -> DataFrame:
    return _dedupe(t)[0]


@query(_DEDUPE + "SELECT id, founder, strategy, round(similarity, 9) AS similarity FROM dropped")
def dedupe_dropped(t) -> DataFrame:
    return _dedupe(t)[1].withColumn("similarity", F.round("similarity", 9))


@query(f"SELECT h, n, first_id FROM (SELECT sha256({_KEY.format('text')}) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1) WHERE n > 1")
def exact_duplicate_texts(t) -> DataFrame:
    return t("documents").groupBy(F.sha2(fn.normalize_key(F.col("text")), 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"""WITH x AS (SELECT DISTINCT {_sql_company('company')} AS c, {_sql_title('title')} AS t FROM jobs), y AS (SELECT c, t, list_distinct(list_filter(string_split(t, ' '), lambda w: w <> '')) AS w FROM x WHERE t <> ''),
 z AS (SELECT a.c, a.t AS x, b.t AS y, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS s FROM y a JOIN y b ON a.c = b.c AND a.t < b.t) SELECT c, x, y, round(s, 9) AS similarity FROM z WHERE s >= 0.6""")
def similar_titles(t) -> DataFrame:
    x = t("jobs").select(fn.normalize_company(F.col("company")).alias("c"), fn.normalize_title(F.col("title")).alias("t")).where("t != ''")
    return greedy.similar_texts(x, ["c"], "t", 0.6).where("x < y").select("c", "x", "y", F.round("similarity", 9).alias("similarity"))


# ---- read model, ranking, counts

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS rn FROM job_evaluations) WHERE rn = 1)"
_VIEW = f"(SELECT j.*, e.score, e.confidence, e.recommendation, coalesce(a.status, 'NEW') AS status FROM jobs j LEFT JOIN {_LATEST} e ON e.job_id = j.id LEFT JOIN job_applications a ON a.job_id = j.id)"


def _view(t) -> DataFrame:
    return readmodel.job_view(t("jobs"), t("job_evaluations"), t("job_applications"))


@query(f"SELECT id, score, recommendation, status FROM {_VIEW}")
def job_view(t) -> DataFrame:
    return _view(t).select("id", "score", "recommendation", "status")


@query(f"""SELECT id, score, status FROM {_VIEW} WHERE source IN ('karyapath', 'baycareer') AND (contains(lower(title), 'engineer') OR contains(lower(company), 'engineer') OR contains(lower(description), 'engineer'))
 AND last_seen_at >= TIMESTAMP '2026-06-01' AND score >= 50 AND score <= 95 AND recommendation IN ('APPLY', 'CONSIDER') AND status NOT IN ('ARCHIVED', 'REJECTED')""")
def find_jobs(t) -> DataFrame:
    since = F.lit(dt.datetime(2026, 6, 1)).cast("timestamp_ntz")
    return readmodel.find_jobs(_view(t), sources=["karyapath", "baycareer"], search="Engineer", seen_since=since, min_score=50, max_score=95, labels=["APPLY", "CONSIDER"]).select("id", "score", "status")


@query("SELECT id FROM jobs WHERE contains(lower(title), '_engineer') OR contains(lower(title), '100%')")
def search_literal(t) -> DataFrame:
    return t("jobs").where(readmodel.contains("title", "_Engineer") | readmodel.contains("title", "100%")).select("id")


_RANK = "score DESC, first_seen_at >= TIMESTAMP '2026-09-11' DESC, coalesce(posted_at, TIMESTAMP '1970-01-01') DESC, confidence DESC, company COLLATE NOCASE, id"


def _ranked(t) -> DataFrame:
    return _view(t).withColumn("is_new", F.col("first_seen_at") >= F.lit(dt.datetime(2026, 9, 11)).cast("timestamp_ntz"))


@query(f"SELECT id, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY {_RANK}) AS rank FROM {_VIEW} WHERE score IS NOT NULL) WHERE rank <= 100")
def rank_jobs(t) -> DataFrame:
    from pyspark.sql import Window as W

    top = _ranked(t).where("score is not null").orderBy(*readmodel.ranking()).limit(100)  # a top-k report
    return top.select("id", "score", F.row_number().over(W.orderBy(*readmodel.ranking())).cast("bigint").alias("rank"))


@query(f"SELECT id, score, recommendation FROM {_VIEW} WHERE score IS NOT NULL AND recommendation <> 'SKIP' ORDER BY {_RANK} LIMIT 5")
def best_matches(t) -> DataFrame:
    return readmodel.best_matches(_ranked(t)).select("id", "score", "recommendation")


@query("SELECT id, first_seen_at >= TIMESTAMP '2026-08-15' AS is_new FROM jobs WHERE last_seen_at >= TIMESTAMP '2026-08-15' ORDER BY first_seen_at DESC, id LIMIT 500")
def recent_jobs(t) -> DataFrame:
    return readmodel.recent_jobs(t("jobs"), dt.datetime(2026, 8, 15)).select("id", "is_new")


@query(f"SELECT l.recommendation, coalesce(n, 0) AS n FROM (SELECT unnest(['HIGH_PRIORITY', 'APPLY', 'CONSIDER', 'SKIP']) AS recommendation) l LEFT JOIN (SELECT recommendation, count(*) AS n FROM {_LATEST} GROUP BY 1) c USING (recommendation)")
def label_counts(t) -> DataFrame:
    return readmodel.label_counts(t("job_evaluations"))


@query(f"SELECT status, count(*) AS n FROM {_VIEW} GROUP BY status")
def status_counts(t) -> DataFrame:
    return _view(t).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM job_evaluations) GROUP BY reason")
def reason_counts(t) -> DataFrame:
    return t("job_evaluations").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT list_sort(list(DISTINCT source)) AS sources, count(DISTINCT company) AS n_companies FROM jobs")
def distinct_sources(t) -> DataFrame:
    return t("jobs").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.countDistinct("company").alias("n_companies"))


@query("SELECT b.source, count(j.id) AS n FROM boards b LEFT JOIN jobs j ON j.source = b.source AND j.remote = 'HYBRID' GROUP BY b.source")
def source_counts(t) -> DataFrame:
    names = [r.source for r in t("boards").select("source").collect()]  # a row per board
    return readers.source_counts(t("jobs").where("remote = 'HYBRID'"), names)


@query("SELECT id, status, started_at FROM runs WHERE status = 'COMPLETED' ORDER BY started_at DESC, id DESC LIMIT 20 OFFSET 20")
def run_page(t) -> DataFrame:
    return readmodel.page(t("runs").where("status = 'COMPLETED'").select("id", "status", "started_at"), [F.col("started_at").desc(), F.col("id").desc()], 20, 20)


@query("SELECT id, status, date_diff('second', started_at, completed_at) AS seconds, len(errors)::INTEGER AS n_errors, status = 'RUNNING' AND started_at < TIMESTAMP '2026-09-12' - INTERVAL 6 HOUR AS interrupted, jobs_fetched - jobs_deduplicated AS n_duplicates FROM runs")
def run_view(t) -> DataFrame:
    return readmodel.run_view(t("runs"), NOW)


@query("SELECT sum(jobs_fetched)::BIGINT AS fetched, sum(jobs_deduplicated)::BIGINT AS kept, sum(jobs_filtered)::BIGINT AS filtered, sum(jobs_evaluated)::BIGINT AS evaluated, count(*) FILTER (len(errors) > 0) AS with_errors FROM runs")
def run_funnel(t) -> DataFrame:
    s = lambda c: F.sum(c)
    return t("runs").agg(s("jobs_fetched").alias("fetched"), s("jobs_deduplicated").alias("kept"), s("jobs_filtered").alias("filtered"), s("jobs_evaluated").alias("evaluated"), F.count_if(F.size("errors") > 0).alias("with_errors"))


@query("SELECT e.id FROM job_evaluations e WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = e.job_id) OR e.run_id IS NULL")
def dangling_evaluations(t) -> DataFrame:
    e = t("job_evaluations")
    gone = e.join(t("jobs").select(F.col("id").alias("job_id")), "job_id", "left_anti").select("id")
    return gone.union(e.where("run_id is null").select("id")).distinct()


@query("SELECT j.id, j.title, e.score FROM jobs j JOIN " + _LATEST + " e ON e.job_id = j.id WHERE j.last_seen_at >= TIMESTAMP '2026-08-01'")
def export_latest(t) -> DataFrame:
    since = F.lit(dt.datetime(2026, 8, 1)).cast("timestamp_ntz")
    e = readmodel.latest_evaluations(t("job_evaluations")).select(F.col("job_id").alias("id"), "score")
    return t("jobs").where(F.col("last_seen_at") >= since).select("id", "title").join(e, "id")


@query("SELECT id::VARCHAR AS id, coalesce(nullif(title, ''), 'unknown') AS title, coalesce(strftime(posted_at, '%Y-%m-%d'), 'unknown') AS posted_at, coalesce(nullif(array_to_string(skills, '; '), ''), 'unknown') AS skills FROM jobs")
def csv_rows(t) -> DataFrame:
    return sinks.csv_columns(t("jobs").select("id", "title", "posted_at", "skills"))


_RULES = [("disallow", "/jobs/"), ("allow", "/jobs/1"), ("disallow", "/*/apply$")]


@query("""SELECT id, greatest(CASE WHEN regexp_matches(p, '^/jobs/1') THEN 7 ELSE -1 END, -1) >= greatest(CASE WHEN regexp_matches(p, '^/jobs/') THEN 6 ELSE -1 END, CASE WHEN regexp_matches(p, '^/.*/apply$') THEN 9 ELSE -1 END) AS allowed
 FROM (SELECT id, regexp_replace(coalesce(application_url, url), '^https?://[^/]+', '') AS p FROM jobs WHERE coalesce(application_url, url) IS NOT NULL)""")
def robots_allowed(t) -> DataFrame:
    path = F.regexp_replace(F.coalesce("application_url", "url"), "^https?://[^/]+", "")
    return readers.robots_allowed(t("jobs").select("id", path.alias("p")).where("p is not null"), "p", _RULES).select("id", "allowed")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(t) -> DataFrame:
    return windowed_counts(t("events"), "ts", "event_type")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id")
def event_replay(t) -> DataFrame:
    return replay(t("events"), "event_id", 100).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def event_tail(t) -> DataFrame:
    return latest_events(t("events"), "event_id", 500).select("event_id", "user_id", "event_type")


QUERIES = {k: f for k, (f, _) in _BUILT.items()}
ORACLES = {k: q for k, (_, q) in _BUILT.items() if q}
