"""Read model: postings with their latest evaluation and application, filtered, counted and paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import truncate_words
from ..operators.keyed import latest

LABELS = ["HIGH_PRIORITY", "APPLY", "CONSIDER", "SKIP"]


def latest_evaluations(evaluations: DataFrame) -> DataFrame:
    """The last evaluation of each posting; of the same instant the greater id counts."""
    return latest(evaluations.select("job_id", "created_at", "id", "score", "confidence", "recommendation", "provider_used", "reasons"), ["job_id"], ["created_at", "id"])


def job_view(jobs: DataFrame, evaluations: DataFrame, applications: DataFrame) -> DataFrame:
    """Every posting once, with evaluation and application where there is one; the default status is NEW."""
    e = latest_evaluations(evaluations).select("job_id", "score", "confidence", "recommendation")
    a = applications.select("job_id", "status", "notes")
    return (
        jobs.join(e, jobs["id"] == e["job_id"], "left").drop("job_id").join(a, jobs["id"] == a["job_id"], "left").drop("job_id")
        .withColumn("status", F.coalesce("status", F.lit("NEW"))).withColumn("notes", F.coalesce("notes", F.lit("")))
    )


def contains(c: str, needle: str):
    """Substring search without wildcards, ignoring the case of ASCII letters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.col(c), upper, lower).contains(needle.translate(str.maketrans(upper, lower)))


def find_jobs(
    view: DataFrame, sources: list[str] | None = None, company: str | None = None, search: str | None = None, seen_since=None, min_score: float | None = None, max_score: float | None = None,
    labels: list[str] | None = None, statuses: list[str] | None = None, hidden: tuple[str, ...] = ("ARCHIVED", "REJECTED"), new_since=None, sort: str = "score", limit: int = 0,
) -> DataFrame:
    """The view under the given conditions; limit 0 is none. Conditions on postings alone reach the scan."""
    x = view
    if sources:
        x = x.where(F.col("source").isin(*sources))
    if company:
        x = x.where(contains("company", company))
    if search:
        x = x.where(contains("title", search) | contains("company", search) | contains("description", search))
    if seen_since is not None:
        x = x.where(F.col("last_seen_at") >= F.lit(seen_since))
    if new_since is not None:
        x = x.where(F.col("first_seen_at") >= F.lit(new_since))
    if min_score is not None:
        x = x.where(F.col("score") >= min_score)
    if max_score is not None:
        x = x.where(F.col("score") <= max_score)
    if labels:
        x = x.where(F.col("recommendation").isin(*labels))
    x = x.where(F.col("status").isin(*statuses)) if statuses else x.where(~F.col("status").isin(*hidden))
    orders = {
        "score": [F.coalesce("score", F.lit(-1.0)).desc(), *([F.col("is_new").desc()] if "is_new" in x.columns else []), F.col("posted_at").desc_nulls_last()],
        "company": [F.collate(F.col("company"), "UNICODE").asc_nulls_last(), F.coalesce("score", F.lit(-1.0)).desc()],
        "posted": [F.col("posted_at").desc_nulls_last()],
        "first_seen": [F.col("first_seen_at").desc_nulls_last()],
    }
    x = x.orderBy(*orders[sort], F.col("id"))
    return x.limit(limit) if limit > 0 else x


def recent_jobs(jobs: DataFrame, since, limit: int = 500) -> DataFrame:
    """The postings last seen at or after ``since`` that were first seen latest, at most ``limit``, taken before any ranking; with ``is_new``."""
    x = jobs.where(F.col("last_seen_at") >= F.lit(since)).withColumn("is_new", F.col("first_seen_at") >= F.lit(since))
    return x.orderBy(F.col("first_seen_at").desc(), F.col("id")).limit(limit)


def ranking() -> list:
    """The order of a report: score, new ones, posting time (unknown last), confidence, company's name, id."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return [F.col("score").desc(), F.col("is_new").desc(), F.coalesce("posted_at", epoch).desc(), F.col("confidence").desc(), F.collate(F.col("company"), "UNICODE"), F.col("id")]


def best_matches(view: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` of the ranking but for those labelled SKIP."""
    return view.where("score is not null and recommendation != 'SKIP'").orderBy(*ranking()).limit(n)


def by_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose id is among ``ids`` (one column), however many these are."""
    return rows.join(ids.toDF(column).distinct(), column, "left_semi")


def prompt_view(jobs: DataFrame, most: int) -> DataFrame:
    """What a model is shown of each posting: unknown values named, the description cut at ``most`` characters."""
    told = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    pay = parse.format_salary(*[F.col(f"salary.{k}") for k in ("currency", "min", "max", "period", "raw")], "unknown")
    years = parse.format_experience(*[F.col(f"experience_required.{k}") for k in ("min_years", "max_years", "raw")], "unknown")
    return jobs.select("id", F.col("id").cast("string").alias("jobId"), "title", "company", told("location").alias("location"), told("remote").alias("remote"), pay.alias("salary"), years.alias("experienceRequired"), "skills", truncate_words(F.col("description"), most).alias("description"))


def prompt(view: DataFrame, template: str, profile: str, batch: Column | None = None) -> DataFrame:
    """``prompt`` of each posting, or of each ``batch`` of them: the template with ``{profile}`` and ``{jobs}``, a JSON list, filled in."""
    key = F.col("id") if batch is None else batch
    names = [c for c in view.columns if c != "id"]
    rows = view.groupBy(key.alias("id")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*names)))).alias("jobs"))
    before, after = template.replace("{profile}", profile).split("{jobs}")
    return rows.select("id", F.concat(F.lit(before), "jobs", F.lit(after)).alias("prompt"))


def label_counts(evaluations: DataFrame) -> DataFrame:
    """Latest evaluations of each label, 0 for labels without any."""
    e = latest_evaluations(evaluations).groupBy("recommendation").agg(F.count("*").alias("n"))
    wanted = evaluations.sparkSession.createDataFrame([(x,) for x in LABELS], "recommendation string")
    return wanted.join(e, "recommendation", "left").select("recommendation", F.coalesce("n", F.lit(0)).alias("n"))


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page in order; the limit is held between 1 and 100, the offset at 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), 100))


def run_view(runs: DataFrame, now, stale_hours: int = 6) -> DataFrame:
    """Runs with duration, number of errors and whether they were interrupted."""
    interrupted = (F.col("status") == "RUNNING") & (F.col("started_at") < F.lit(now) - F.expr(f"interval {stale_hours} hours"))
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("completed_at"))
    return runs.select("id", "status", seconds.alias("seconds"), F.size("errors").alias("n_errors"), interrupted.alias("interrupted"), (F.col("jobs_fetched") - F.col("jobs_deduplicated")).alias("n_duplicates"))
