"""Queries of the operators on postings, runs, applications and their reports, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonfn, parse
from ..functions import text as fn
from ..operators import keyed, records
from ..sources import readers, sinks
from . import readmodel
from .reference import _BUILT, _HTML, _KEY, _LATEST, _PLACE, _URL, _VIEW, _WITH_Q, NOW, _ranked, _sql_company, _sql_title, _view, query

_BEFORE = set(_BUILT)
_NOW = "TIMESTAMP '2026-09-12'"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


# figures by themselves, units as padded words
_MONEY = r"""(SELECT *, list_filter(list_transform(regexp_extract_all(t, '\d+(?:[.,]\d+)*'), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), lambda x: x > 0) AS f,
 ' ' || regexp_replace(t, '[^a-z0-9_/]+', ' ', 'g') || ' ' AS w FROM (SELECT *, lower(trim(salary, ' ' || chr(9) || chr(10) || chr(160))) AS t FROM incoming_jobs))"""
_HAS = lambda words: "(" + " OR ".join(f"regexp_matches(w, '(^|[^a-z0-9_]){x}[^a-z0-9_]')" for x in words) + ")"


@query(f"""SELECT incoming_id, CASE WHEN none THEN NULL WHEN contains(t, '₹') OR contains(t, 'rs') OR contains(t, 'inr') OR contains(t, 'lpa') OR contains(t, 'lakh') OR contains(t, 'crore') THEN 'INR' WHEN contains(t, '$') OR contains(t, 'usd') THEN 'USD'
 WHEN contains(t, '€') OR contains(t, 'eur') THEN 'EUR' WHEN contains(t, '£') OR contains(t, 'gbp') THEN 'GBP' END AS currency,
 CASE WHEN none THEN NULL ELSE list_min(g) END AS low, CASE WHEN NOT none AND list_max(g) > list_min(g) THEN list_max(g) END AS high,
 CASE WHEN none THEN NULL WHEN contains(w, 'per hour ') OR contains(w, ' hourly ') OR regexp_matches(w, '[a-z0-9_]/(hr|hour)[^a-z0-9_]') THEN 'HOURLY' WHEN {_HAS(['per month', 'monthly', 'pm'])} OR regexp_matches(w, '[a-z0-9_]/(mo|month)[^a-z0-9_]') THEN 'MONTHLY'
 WHEN {_HAS(['lpa', 'per annum', 'annually', 'yearly', 'per year', 'pa'])} OR regexp_matches(w, '[a-z0-9_]/(yr|year)[^a-z0-9_]') THEN 'YEARLY' WHEN (lakh OR crore) AND len(f) > 0 THEN 'YEARLY' END AS period
 FROM (SELECT *, list_transform(f, lambda x: x * CASE WHEN crore THEN 10000000 WHEN lakh THEN 100000 ELSE 1 END) AS g FROM (SELECT *, {_HAS(['lpa', 'lakh', 'lac'])} AS lakh, {_HAS(['crore'])} AS crore,
 contains(t, 'not disclosed') OR contains(t, 'not specified') OR contains(t, 'unspecified') OR contains(t, 'as per industry') OR contains(t, 'as per company') OR contains(t, 'negotiable') OR contains(t, 'confidential') AS none FROM {_MONEY}))""")
def salary_range(t) -> DataFrame:
    x = t("incoming_jobs").select("incoming_id", parse.salary_range(F.col("salary")).alias("s"))
    return x.select("incoming_id", "s.currency", F.col("s.min").alias("low"), F.col("s.max").alias("high"), "s.period")


def _incoming(t) -> DataFrame:
    return records.normalized(t("incoming_jobs"), _now(), at=F.col("posted_at"))


_RAW_HTML = _HTML
_N_WITH_Q = _WITH_Q.replace("FROM jobs", "FROM incoming_jobs")


@query(f"""SELECT incoming_id, CASE WHEN title IS NULL OR trim(title) = '' THEN 'job has no title' WHEN company IS NULL OR trim(company) = '' THEN 'job has no company' WHEN u IS NULL OR u = '' THEN 'job has no URL' END AS error,
 coalesce(nullif(trim(external_id, ' ' || chr(9) || chr(10) || chr(160)), ''), substring(sha256(coalesce(source, '') || '|' || {_URL}), 1, 32)) AS external_id,
 sha256(concat_ws('|', {_sql_company('company')}, {_sql_title('title')}, {_KEY.format('location')}, {_URL})) AS fingerprint, len({_RAW_HTML}) AS n_chars FROM {_N_WITH_Q}""")
def normalized_jobs(t) -> DataFrame:
    return _incoming(t).select("incoming_id", "error", "external_id", "fingerprint", F.length("description").cast("bigint").alias("n_chars"))


@query(f"""SELECT incoming_id, {_PLACE} AS place FROM (SELECT incoming_id, ' ' || regexp_replace(lower(concat_ws(' ', trim(location), trim(title), substring({_RAW_HTML}, 1, 1500))), '[^a-z0-9_]+', ' ', 'g') || ' ' AS x FROM incoming_jobs)""")
def normalized_places(t) -> DataFrame:
    return _incoming(t).select("incoming_id", F.col("remote").alias("place"))


@query("SELECT source, count(*) FILTER (WHERE bad) AS n_rejected, count(*) AS n_rows FROM (SELECT source, coalesce(trim(title), '') = '' OR coalesce(trim(company), '') = '' OR coalesce(trim(url), '') = '' AS bad FROM incoming_jobs) GROUP BY source")
def rejected_rows(t) -> DataFrame:
    return _incoming(t).groupBy("source").agg(F.count_if(F.col("error").isNotNull()).alias("n_rejected"), F.count("*").alias("n_rows"))


_N = lambda c: f"regexp_replace(printf('%.6f', {c}), '\\.?0+$', '')"
_PAY = f"""coalesce(nullif(salary.raw, ''), CASE WHEN salary.min IS NULL AND salary.max IS NULL THEN NULL ELSE trim(coalesce(salary.currency, '') || ' ' || CASE WHEN salary.min IS NOT NULL AND salary.max IS NOT NULL THEN {_N('salary.min')} || '-' || {_N('salary.max')}
 ELSE {_N('coalesce(salary.min, salary.max)')} END || CASE WHEN salary.period IS NULL THEN '' ELSE ' ' || lower(salary.period) END) END"""
_YEARS = f"""coalesce(nullif(e.raw, ''), CASE WHEN e.min_years IS NOT NULL AND e.max_years IS NOT NULL THEN {_N('e.min_years')} || '-' || {_N('e.max_years')} || ' years' WHEN e.min_years IS NOT NULL THEN {_N('e.min_years')} || '+ years'
 WHEN e.max_years IS NOT NULL THEN 'up to ' || {_N('e.max_years')} || ' years' END"""
_UNSAID = "(SELECT * REPLACE (struct_pack(currency := salary.currency, min := salary.min, max := salary.max, period := salary.period, raw := CASE WHEN id % 2 = 0 THEN salary.raw END) AS salary), struct_pack(min_years := experience_required.min_years, max_years := experience_required.max_years, raw := CASE WHEN id % 2 = 0 THEN experience_required.raw END) AS e FROM jobs)"


@query(f"SELECT id, {_PAY}) AS pay, {_YEARS}, 'unknown') AS years FROM {_UNSAID}")
def formatted_ranges(t) -> DataFrame:
    """Every second row without its raw text, so that the figures are formatted."""
    raw = lambda c: F.when(F.col("id") % 2 == 0, F.col(f"{c}.raw"))
    pay = parse.format_salary(*[F.col(f"salary.{k}") for k in ("currency", "min", "max", "period")], raw("salary"))
    years = parse.format_experience(F.col("experience_required.min_years"), F.col("experience_required.max_years"), raw("experience_required"), "unknown")
    return t("jobs").select("id", pay.alias("pay"), years.alias("years"))


@query(f"SELECT id, CASE WHEN posted_at IS NULL THEN 'unknown' WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 30 THEN d || 'd ago' WHEN d < 365 THEN d // 30 || 'mo ago' ELSE d // 365 || 'y ago' END AS posted FROM (SELECT id, posted_at, floor(epoch_us({_NOW}) / 86400000000 - epoch_us(posted_at) / 86400000000)::BIGINT AS d FROM jobs)")
def relative_days(t) -> DataFrame:
    return t("jobs").select("id", parse.relative_day(F.col("posted_at"), _now()).alias("posted"))


@query("SELECT id, CASE WHEN s < 1 THEN '<1s' WHEN s < 60 THEN s || 's' ELSE s // 60 || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' END AS took FROM (SELECT id, date_diff('second', started_at, completed_at) AS s FROM runs)")
def run_durations(t) -> DataFrame:
    return t("runs").select("id", parse.duration_text(F.timestamp_diff("SECOND", F.col("started_at"), F.col("completed_at"))).alias("took"))


# ---- applications and runs

_UPDATES = """(SELECT job_id, id AS seq, created_at AS "at", CASE recommendation WHEN 'HIGH_PRIORITY' THEN 'APPLIED' WHEN 'APPLY' THEN 'INTERESTED' WHEN 'SKIP' THEN 'ARCHIVED' END AS status, concerns[1] AS notes FROM job_evaluations)"""


@query(f"""WITH u AS (SELECT *, row_number() OVER w AS rn, last_value(status IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM {_UPDATES} WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
 v AS (SELECT u.*, u.status IS NOT NULL AND u.status IS DISTINCT FROM coalesce(u.said, a.status, CASE WHEN rn > 1 THEN 'NEW' END) AS step FROM u LEFT JOIN job_applications a USING (job_id)),
 n AS (SELECT job_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(notes, seq) FILTER (notes IS NOT NULL) AS notes, arg_min("at", seq) FILTER (step AND status = 'APPLIED') AS applied_at, string_agg(status, ',' ORDER BY seq) FILTER (step) AS steps FROM v GROUP BY job_id)
 SELECT coalesce(n.job_id, a.job_id) AS job_id, coalesce(n.status, a.status, 'NEW') AS status, coalesce(n.notes, a.notes, '') AS notes, coalesce(a.applied_at, n.applied_at) AS applied_at,
 concat_ws(',', nullif(array_to_string(list_transform(a.status_history, lambda h: h.status), ','), ''), n.steps) AS steps FROM n FULL JOIN job_applications a ON n.job_id = a.job_id""")
def application_updates(t) -> DataFrame:
    """Applications after the evaluations, taken as updates in their order."""
    r = F.col("recommendation")
    status = F.when(r == "HIGH_PRIORITY", "APPLIED").when(r == "APPLY", "INTERESTED").when(r == "SKIP", "ARCHIVED")
    u = t("job_evaluations").select("job_id", F.col("id").alias("seq"), F.col("created_at").alias("at"), status.alias("status"), F.try_element_at("concerns", F.lit(1)).alias("notes"))
    x = records.updated_applications(t("job_applications"), u, ["seq"])
    return x.select("job_id", "status", "notes", "applied_at", F.array_join(F.col("status_history.status"), ",").alias("steps"))


_CLOSINGS = f"(SELECT r.id, {_NOW} AS at, CASE WHEN n IS NULL THEN 'nothing evaluated' END AS error, n AS jobs_evaluated FROM (SELECT id FROM runs WHERE status <> 'COMPLETED' UNION ALL SELECT 1000) r LEFT JOIN (SELECT run_id, count(*) AS n FROM job_evaluations GROUP BY 1) e ON e.run_id = r.id)"


@query(f"""SELECT r.id, CASE WHEN c.id IS NULL THEN r.status WHEN c.error IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, coalesce(c.at, r.completed_at) AS completed_at, CASE WHEN c.id IS NOT NULL AND c.error IS NULL THEN c.jobs_evaluated ELSE r.jobs_evaluated END AS jobs_evaluated,
 array_to_string(CASE WHEN c.error IS NULL THEN coalesce(r.errors, []) ELSE list_append(coalesce(r.errors, []), c.error) END, '; ') AS errors
 FROM (SELECT id, status, completed_at, jobs_evaluated, errors FROM runs UNION ALL SELECT 1000, 'RUNNING', NULL, NULL, []) r LEFT JOIN {_CLOSINGS} c ON c.id = r.id""")
def run_lifecycle(t) -> DataFrame:
    """A run is started, then all open or failed ones are closed by what was evaluated in them."""
    runs = t("runs")
    start = runs.sparkSession.createDataFrame([(1000,)], "id bigint").withColumn("started_at", _now())
    runs = records.started_runs(runs, start)
    done = t("job_evaluations").groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("jobs_evaluated"))
    closing = runs.where("status != 'COMPLETED'").select("id").join(done, "id", "left").select("id", _now().alias("at"), F.when(F.col("jobs_evaluated").isNull(), "nothing evaluated").alias("error"), "jobs_evaluated")
    return records.closed_runs(runs, closing).select("id", "status", "completed_at", "jobs_evaluated", F.array_join(F.coalesce("errors", F.array().cast("array<string>")), "; ").alias("errors"))


@query("SELECT id, status FROM runs ORDER BY started_at DESC, id DESC LIMIT 1")
def latest_run(t) -> DataFrame:
    return t("runs").orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(1).select("id", "status")


@query("SELECT id, status, jobs_new FROM runs WHERE id = 17")
def run_by_id(t) -> DataFrame:
    return t("runs").where("id = 17").select("id", "status", "jobs_new")


@query("SELECT count(*) AS n_all, count(*) FILTER (status = 'FAILED') AS n_failed FROM runs")
def run_counts(t) -> DataFrame:
    return t("runs").agg(F.count("*").alias("n_all"), F.count_if(F.col("status") == "FAILED").alias("n_failed"))


@query("SELECT id, ceil(greatest(0, jobs_evaluated - jobs_from_cache) / 5.0)::BIGINT AS n_batches FROM runs")
def run_batches(t) -> DataFrame:
    return t("runs").select("id", F.ceil(F.greatest(F.lit(0), F.col("jobs_evaluated") - F.col("jobs_from_cache")) / 5).cast("bigint").alias("n_batches"))


@query(f"SELECT j.id, e.id AS evaluation_id, s.state FROM jobs j JOIN {_LATEST} e ON e.job_id = j.id LEFT JOIN (SELECT lower(trim(fingerprint)) AS f, CASE WHEN count(*) = 1 THEN 'NEW' ELSE 'SEEN' END AS state FROM jobs WHERE fingerprint IS NOT NULL GROUP BY 1) s ON s.f = lower(trim(j.fingerprint))")
def evaluated_states(t) -> DataFrame:
    key = F.lower(F.trim("fingerprint")).alias("f")
    state = t("jobs").where("fingerprint is not null").groupBy(key).agg(F.when(F.count("*") == 1, "NEW").otherwise("SEEN").alias("state"))
    e = readmodel.latest_evaluations(t("job_evaluations")).select(F.col("job_id").alias("id"), F.col("id").alias("evaluation_id"))
    return t("jobs").select("id", key).join(e, "id").join(state, "f", "left").select("id", "evaluation_id", "state")


@query("SELECT id, job_id, score FROM (SELECT id, job_id, score FROM job_evaluations UNION ALL SELECT (SELECT max(id) FROM job_evaluations) + row_number() OVER (ORDER BY id), job_id, score + 1 FROM job_evaluations WHERE degraded)")
def evaluation_log(t) -> DataFrame:
    """The log after evaluations that were degraded are made again."""
    log = t("job_evaluations").select("id", "job_id", "score", "created_at")
    again = t("job_evaluations").where("degraded").select("id", "job_id", (F.col("score") + 1).alias("score"), "created_at")
    return records.appended(log, again, _now()).select("id", "job_id", "score")


_IDS = "(SELECT job_id FROM job_applications WHERE status = 'INTERVIEWING')"


@query(f"SELECT id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS pos FROM job_evaluations WHERE job_id IN {_IDS}")
def evaluations_by_ids(t) -> DataFrame:
    from pyspark.sql import Window as W

    ids = t("job_applications").where("status = 'INTERVIEWING'").select("job_id")
    pos = F.row_number().over(W.partitionBy("job_id").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    return readmodel.by_ids(t("job_evaluations"), ids, "job_id").select("id", "job_id", pos.cast("bigint").alias("pos"))


@query(f"SELECT id, source, title FROM jobs WHERE id IN {_IDS}")
def jobs_by_ids(t) -> DataFrame:
    return readmodel.by_ids(t("jobs"), t("job_applications").where("status = 'INTERVIEWING'").select("job_id")).select("id", "source", "title")


@query("SELECT e.id, e.job_id, CASE WHEN r.id IS NOT NULL THEN e.run_id END AS run_id FROM job_evaluations e JOIN (SELECT id FROM jobs WHERE source <> 'lakhline') j ON j.id = e.job_id LEFT JOIN (SELECT id FROM runs WHERE status <> 'FAILED') r ON r.id = e.run_id")
def referential_actions(t) -> DataFrame:
    """Evaluations after the postings of a board and the failed runs were deleted."""
    out = records.surviving_children(t("job_evaluations"), t("jobs").where("source != 'lakhline'"), "job_id", ("run_id", t("runs").where("status != 'FAILED'")))
    return out.select("id", "job_id", "run_id")


# ---- what a model is asked and answers


@query("SELECT id, job_id, score, array_to_string(CASE WHEN id % 3 = 0 THEN [] ELSE coalesce(reasons, []) END, '; ') AS reasons, CASE WHEN id % 3 = 0 THEN false ELSE coalesce(needs_cloud, false) END AS needs_cloud FROM job_evaluations")
def decoded_envelopes(t) -> DataFrame:
    """Evaluations in batches of five as JSON, every third without lists and flags, and decoded again."""
    e = t("job_evaluations").withColumn("full", F.col("id") % 3 != 0)
    rows = [F.col("id"), F.col("job_id").alias("jobId"), "score", F.when(F.col("full"), F.col("reasons")).alias("reasons"), F.when(F.col("full"), F.col("needs_cloud")).alias("needsCloud")]
    sent = e.groupBy(F.floor((F.col("id") - 1) / 5).alias("batch_id")).agg(jsonfn.envelope(rows).alias("body"))
    got = sent.select(F.explode(jsonfn.opened(F.col("body"), "id: bigint, jobId: bigint, score: double, matchingSkills: array<string>, missingSkills: array<string>, reasons: array<string>, concerns: array<string>, needsCloud: boolean")).alias("e"))
    d = jsonfn.evaluation_defaults(F.col("e"))
    return got.select("e.id", F.col("e.jobId").alias("job_id"), "e.score", F.array_join(d["reasons"], "; ").alias("reasons"), d["needsCloud"].alias("needs_cloud"))


@query("""WITH q AS (SELECT (id - 1) // 5 AS batch_id, job_id FROM job_evaluations), r AS (SELECT (id - 1) // 5 AS batch_id, CASE WHEN escalated THEN -job_id ELSE job_id END AS job_id FROM job_evaluations WHERE NOT degraded)
 SELECT a.batch_id, a.asked, coalesce(b.told, 0) AS told, coalesce(b.told = a.asked AND b.bad = 0, false) AS usable FROM (SELECT batch_id, count(*) AS asked FROM q GROUP BY 1) a
 LEFT JOIN (SELECT r.batch_id, count(*) AS told, count(*) FILTER (NOT EXISTS (SELECT 1 FROM q WHERE q.batch_id = r.batch_id AND q.job_id = r.job_id)) AS bad FROM r GROUP BY 1) b USING (batch_id)""")
def batch_check(t) -> DataFrame:
    e = t("job_evaluations").withColumn("batch_id", F.floor((F.col("id") - 1) / 5))
    told = e.where("not degraded").select("batch_id", F.when(F.col("escalated"), -F.col("job_id")).otherwise(F.col("job_id")).alias("job_id"))
    return records.checked_batches(e.select("batch_id", "job_id"), told)


@query(f"""SELECT id, coalesce(location, 'unknown') AS location, coalesce(remote, 'unknown') AS remote, {_PAY}, 'unknown') AS salary, {_YEARS}, 'unknown') AS years, length(description) <= 120 AS whole FROM (SELECT *, experience_required AS e FROM jobs)""")
def prompt_view(t) -> DataFrame:
    p = readmodel.prompt_view(t("jobs"), 120)
    return p.select("id", "location", "remote", "salary", F.col("experienceRequired").alias("years"), (~F.col("description").endswith("[...description truncated...]")).alias("whole"))


@query("SELECT id, 'Profile: {\"years\":5}' || chr(10) || 'Jobs: [' || '{\"jobId\":\"' || id || '\"' AS head FROM jobs")
def prompts(t) -> DataFrame:
    text = readmodel.prompt(readmodel.prompt_view(t("jobs"), 120), "Profile: {profile}\nJobs: {jobs}", '{"years":5}')
    return text.select("id", F.substring_index("prompt", ',"title"', 1).alias("head"))


@query("SELECT id, pos FROM (SELECT id, row_number() OVER (ORDER BY (lower(trim(content_hash)) IN (SELECT lower(trim(content_hash)) FROM job_evaluations)) IS NOT TRUE, id) AS pos FROM jobs)")
def cached_first(t) -> DataFrame:
    key = F.lower(F.trim("content_hash")).alias("h")
    x = keyed.cache_split(t("jobs").select("id", key), t("job_evaluations").select(key).where("h is not null"), ["h"])
    return keyed.ranked_in_order(x.select("id", (~F.col("hit")).alias("fresh")), ["fresh", "id"]).select("id", "pos")


@query("SELECT id, CASE WHEN recommendation IN ('APPLY', 'CONSIDER') AND score BETWEEN 50 AND 90 THEN score END AS score, CASE WHEN recommendation IN ('APPLY', 'CONSIDER') AND score BETWEEN 50 AND 90 THEN NULL ELSE 'schema' END AS stage FROM job_evaluations")
def checked_answers(t) -> DataFrame:
    """Answers as a model gives them, of which only those within range and list are taken."""
    answer = F.concat(F.lit("Here you are: "), F.to_json(F.struct("score", "recommendation")), F.lit(" - done"))
    p = jsonfn.parsed(answer, "score double, recommendation string", lambda v: v["score"].between(50, 90) & v["recommendation"].isin("APPLY", "CONSIDER"))
    return t("job_evaluations").select("id", p.alias("p")).select("id", "p.value.score", "p.stage")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'purchase')")
def shown_events(t) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "purchase", "warn").when(kind == "view", "debug").when(kind == "click", "info")
    return t("events").where(fn.level_at_least(level, "warn")).select("event_id")


# ---- reports


@query(f"""SELECT kind, name, n FROM (SELECT 'total' AS kind, '' AS name, count(*) AS n FROM jobs UNION ALL SELECT 'new', '', count(*) FROM jobs WHERE first_seen_at >= {_NOW} - INTERVAL 24 HOUR
 UNION ALL SELECT 'status', s, sum(n)::BIGINT FROM (SELECT status AS s, count(*) AS n FROM job_applications a WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.id = a.job_id) GROUP BY 1 UNION ALL SELECT 'NEW', (SELECT count(*) FROM jobs) - (SELECT count(*) FROM job_applications a WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.id = a.job_id))) GROUP BY s
 UNION ALL SELECT 'label', recommendation, count(*) FROM {_LATEST} e WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.id = e.job_id) GROUP BY 2) WHERE n > 0""")
def job_stats(t) -> DataFrame:
    return records.stats(_view(t), _now())


@query("SELECT reason, n, row_number() OVER (ORDER BY n DESC, reason) AS pos FROM (SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM job_evaluations) GROUP BY reason)")
def sorted_reasons(t) -> DataFrame:
    n = t("job_evaluations").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return keyed.ranked_in_order(n.withColumn("less", -F.col("n")), ["less", "reason"]).select("reason", "n", "pos")


@query(f"""SELECT e.score, round(e.confidence, 2) AS confidence, e.recommendation, j.company, j.title, coalesce(j.location, 'unknown') AS location, coalesce(j.remote, 'unknown') AS remote, {_PAY}, 'unknown') AS salary, {_YEARS}, 'unknown') AS "experienceRequired",
 coalesce(strftime(j.posted_at, '%Y-%m-%d'), 'unknown') AS "postedAt", j.source, j.url AS "jobUrl", coalesce(j.application_url, j.url) AS "applicationUrl", coalesce(array_to_string(x.matching_skills, '; '), '') AS "matchingSkills", coalesce(array_to_string(x.missing_skills, '; '), '') AS "missingSkills",
 coalesce(array_to_string(x.reasons, '; '), '') AS reasons, coalesce(array_to_string(x.concerns, '; '), '') AS concerns, x.provider_used AS "providerUsed", CASE WHEN j.first_seen_at >= TIMESTAMP '2026-09-11' THEN 'yes' ELSE 'no' END AS "isNew"
 FROM (SELECT *, experience_required AS e FROM jobs) j JOIN {_LATEST} e ON e.job_id = j.id JOIN job_evaluations x ON x.id = e.id""".replace("e.raw", "j.e.raw").replace("e.min_years", "j.e.min_years").replace("e.max_years", "j.e.max_years"))
def report_rows(t) -> DataFrame:
    x = keyed.latest(t("job_evaluations").select("job_id", "created_at", F.col("id").alias("evaluation_id"), "score", "confidence", "recommendation", "matching_skills", "missing_skills", "reasons", "concerns", "provider_used"), ["job_id"], ["created_at", "evaluation_id"])
    ranked = t("jobs").join(x.withColumnRenamed("job_id", "id").drop("created_at"), "id").withColumn("is_new", F.col("first_seen_at") >= F.lit("2026-09-11").cast("timestamp_ntz"))
    return sinks.report_rows(ranked)


@query(f"SELECT id, status FROM {_VIEW} WHERE contains(lower(company), 'media') AND first_seen_at >= TIMESTAMP '2026-08-01' AND status NOT IN ('ARCHIVED', 'REJECTED')")
def new_jobs_of_company(t) -> DataFrame:
    return readmodel.find_jobs(_view(t), company="Media", new_since=F.lit("2026-08-01").cast("timestamp_ntz"), sort="first_seen").select("id", "status")


def _top(sort: str):
    def f(t) -> DataFrame:
        return readmodel.find_jobs(_ranked(t), sort=sort, limit=50).select("id")

    f.__name__ = f"sorted_by_{sort}"
    return f


_OPEN = f"SELECT id FROM {_VIEW} WHERE status NOT IN ('ARCHIVED', 'REJECTED') ORDER BY "
for _sort, _order in {
    "score": "coalesce(score, -1) DESC, first_seen_at >= TIMESTAMP '2026-09-11' DESC, posted_at DESC NULLS LAST, id", "posted": "posted_at DESC NULLS LAST, id", "first_seen": "first_seen_at DESC NULLS LAST, id",
}.items():
    query(f"{_OPEN}{_order} LIMIT 50")(_top(_sort))


@query("SELECT source, url_key, first_id FROM (SELECT source, trim(url) AS url_key, min(id) AS first_id FROM jobs WHERE url IS NOT NULL AND trim(title) <> '' GROUP BY ALL)")
def first_addresses(t) -> DataFrame:
    x = t("jobs").select("id", "source", "title", F.trim("url").alias("url_key")).where("url_key is not null")
    return readers.first_addresses(x, "source", "url_key", ["id"]).select("source", "url_key", F.col("id").alias("first_id"))


@query("SELECT id, CASE WHEN starts_with(address, 'https://www.dakshajobs.example') THEN NOT contains(address, '/view/1') WHEN starts_with(address, 'https://lakhline.example') THEN true ELSE false END AS allowed FROM (SELECT id, url AS address FROM jobs WHERE url IS NOT NULL)")
def robots_gate(t) -> DataFrame:
    answers = {"https://www.dakshajobs.example": (200, "User-agent: *\nDisallow: /view/1"), "https://lakhline.example": (404, None), "https://thamesroles.example": (200, "<!doctype html>"), "https://openmix.example": (503, None)}
    return readers.robots_gate(t("jobs").where("url is not null").select("id", "url"), answers, "bot").select("id", "allowed")


@query("SELECT id, source FROM jobs WHERE contains(lower(concat_ws(' ', title, description)), 'kafka') OR contains(lower(concat_ws(' ', title, description)), 'night shift')")
def matching_rows(t) -> DataFrame:
    return readers.matching(t("jobs"), ["Kafka", "night shift"]).select("id", "source")


@query("SELECT id, job_id, status, len(status_history)::INTEGER AS n_steps FROM job_applications WHERE id IS NOT NULL AND job_id IS NOT NULL AND status IS NOT NULL")
def conformed_applications(t) -> DataFrame:
    return records.conform(t("job_applications").drop("notes"), "job_applications").select("id", "job_id", "status", F.size("status_history").alias("n_steps"))


QUERIES = {k: f for k, (f, _) in _BUILT.items() if k not in _BEFORE}
ORACLES = {k: q for k, (_, q) in _BUILT.items() if q and k not in _BEFORE}
