"""Records of a pipeline: raw rows made into postings, and the tables that a run keeps up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from ..functions import text as fn

#: Characters of a description that are looked at for the place of work.
PLACE_WINDOW = 1500

#: Columns of the tables that a pipeline keeps.
SCHEMAS = {
    "jobs": "id bigint not null, source string not null, external_id string not null, company string not null, title string not null, description string, location string, remote string, "
    "salary struct<currency: string, min: double, max: double, period: string, raw: string>, experience_required struct<min_years: double, max_years: double, raw: string>, skills array<string>, "
    "url string, application_url string, posted_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, fingerprint string, content_hash string, raw_data string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "job_evaluations": "id bigint not null, job_id bigint not null, run_id bigint, provider string, model string, local_model string, provider_used string, score double, confidence double, recommendation string, "
    "matching_skills array<string>, missing_skills array<string>, reasons array<string>, concerns array<string>, needs_cloud boolean, escalated boolean, degraded boolean, content_hash string, created_at timestamp_ntz",
    "job_applications": "id bigint not null, job_id bigint not null, status string not null, notes string, applied_at timestamp_ntz, status_history array<struct<status: string, at: timestamp_ntz>>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "runs": "id bigint not null, started_at timestamp_ntz not null, completed_at timestamp_ntz, status string not null, jobs_fetched bigint, jobs_deduplicated bigint, jobs_filtered bigint, jobs_evaluated bigint, jobs_from_cache bigint, "
    "jobs_new bigint, local_llm_requests bigint, cloud_llm_requests bigint, estimated_cloud_cost double, errors array<string>, created_at timestamp_ntz",
}


def schema_of(name: str) -> T.StructType:
    """The columns of one of the tables of SCHEMAS."""
    return T.StructType.fromDDL(SCHEMAS[name])


def conform(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with exactly a table's columns, missing ones null, and only rows whose required columns are stated."""
    schema = schema_of(name)
    have = set(rows.columns)
    out = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    required = [F.col(f.name).isNotNull() for f in schema if not f.nullable]
    for c in required:
        out = out.where(c)
    return out


def normalized(raw: DataFrame, now: Column, at: Column | None = None) -> DataFrame:
    """Raw rows as postings, with ``error`` for those without title, company or address.

    ``raw``: source, external_id, company, title, description, location, remote,
    salary, experience, skills, url, application_url, posted_at as typed. Other
    columns stay as they are. A row without an id of its own gets one from source
    and address, so that it is the same in the next run. ``at`` replaces the
    parsed time of posting. Blank texts count as missing; nothing is invented.
    """
    have = set(raw.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    blank = lambda c: F.nullif(fn.trim_ws(col(c)), F.lit(""))
    title, company, url, location = (blank(c) for c in ("title", "company", "url", "location"))
    error = F.when(title.isNull(), "job has no title").when(company.isNull(), "job has no company").when(url.isNull(), "job has no URL")
    x = raw.select(
        *[F.col(c) for c in raw.columns if c not in ("external_id", "company", "title", "description", "location", "remote", "salary", "experience", "skills", "url", "application_url", "posted_at")],
        F.coalesce(blank("external_id"), F.substring(F.sha2(F.concat_ws("|", F.coalesce("source", F.lit("")), fn.normalize_url(col("url"))), 256), 1, 32)).alias("external_id"),
        company.alias("company"), title.alias("title"), fn.html_to_text(col("description")).alias("description"), location.alias("location"), col("remote").alias("_remote"),
        parse.salary_range(col("salary")).alias("salary"), parse.experience_range(col("experience")).alias("experience_required"),
        F.array_distinct(F.filter(F.transform(F.coalesce(F.col("skills"), F.array().cast("array<string>")), fn.trim_ws), lambda s: s != "")).alias("skills"),
        url.alias("url"), blank("application_url").alias("application_url"), (parse.posted_at(col("posted_at"), now) if at is None else at).alias("posted_at"), error.alias("error"),
    )
    place = parse.work_place(F.col("_remote"), F.col("location"), F.col("title"), F.substring("description", 1, PLACE_WINDOW))
    x = x.withColumn("remote", place).drop("_remote")
    return x.withColumns({
        "fingerprint": fn.fingerprint(F.col("company"), F.col("title"), F.col("location"), F.col("url")),
        "content_hash": fn.content_hash(F.col("title"), F.col("company"), F.col("description"), F.col("salary.raw"), F.col("experience_required.raw"), F.col("skills")),
    })


def updated_applications(stored: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """Applications after updates (job_id, status, notes, at, and ``order``, which tells updates of a job apart).

    Null status or notes leave these alone. A status enters the history only if it
    differs from the one before (or is the first ever), applied_at is set by the
    first APPLIED and never moved. Columns: job_id, status, notes, applied_at,
    status_history, updated_at.
    """
    s = stored.select("job_id", F.col("status").alias("_status"), F.col("notes").alias("_notes"), F.col("applied_at").alias("_applied"), F.col("status_history").alias("_history"), F.col("updated_at").alias("_updated"), F.lit(True).alias("_there"))
    w = W.partitionBy("job_id").orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    u = updates.join(s, "job_id", "left").withColumn("_now", F.coalesce(F.last("status", True).over(before), F.col("_status"), F.when(F.row_number().over(w) > 1, "NEW")))
    u = u.withColumn("_step", F.col("status").isNotNull() & ~F.coalesce(F.col("status") == F.col("_now"), F.lit(False)))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v"))))["v"]
    new = u.groupBy("job_id").agg(
        last("status").alias("n_status"), last("notes").alias("n_notes"), F.max("at").alias("n_at"),
        F.min(F.when(F.col("_step") & (F.col("status") == "APPLIED"), F.struct(*order, F.col("at").alias("v"))))["v"].alias("n_applied"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_step"), F.struct(*order, "status", "at")))), lambda x: F.struct(x["status"].alias("status"), x["at"].alias("at"))).alias("n_history"),
    )
    both = s.join(new, "job_id", "full_outer")
    none = F.array().cast(stored.schema["status_history"].dataType)
    return both.select(
        "job_id", F.coalesce("n_status", "_status", F.lit("NEW")).alias("status"), F.coalesce("n_notes", "_notes", F.lit("")).alias("notes"), F.coalesce("_applied", "n_applied").alias("applied_at"),
        F.concat(F.coalesce("_history", none), F.coalesce("n_history", none)).alias("status_history"), F.coalesce("n_at", "_updated").alias("updated_at"),
    )


def started_runs(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """``runs`` and a RUNNING row for each of ``starts`` (id, started_at), all else null and no errors."""
    new = starts.select(*[F.col(f.name) if f.name in ("id", "started_at") else F.lit("RUNNING").alias("status") if f.name == "status" else F.array().cast(f.dataType).alias(f.name) if f.name == "errors" else F.lit(None).cast(f.dataType).alias(f.name) for f in runs.schema])
    return runs.unionByName(new)


def closed_runs(runs: DataFrame, closings: DataFrame) -> DataFrame:
    """``runs`` after closings (id, at, error, and any measures of runs).

    A closing without error completes its run with the measures stated; one with
    an error fails it and appends the error to those already there. Closings of
    unknown runs are ignored; ids are unique on both sides.
    """
    measures = [c for c in closings.columns if c in runs.columns and c not in ("id", "errors", "status", "completed_at")]
    c = closings.select(F.col("id"), F.col("at").alias("_at"), F.col("error").alias("_error"), *[F.col(m).alias(f"_{m}") for m in measures])
    x = runs.join(c, "id", "left")
    there = F.col("_at").isNotNull()
    out = {
        "completed_at": F.coalesce("_at", "completed_at"),
        "status": F.when(there & F.col("_error").isNull(), "COMPLETED").when(there, "FAILED").otherwise(F.col("status")),
        "errors": F.when(F.col("_error").isNotNull(), F.array_append(F.coalesce("errors", F.array().cast("array<string>")), F.col("_error"))).otherwise(F.col("errors")),
        **{m: F.when(there & F.col("_error").isNull(), F.coalesce(f"_{m}", m)).otherwise(F.col(m)) for m in measures},
    }
    return x.select(*[out.get(n, F.col(n)).alias(n) for n in runs.columns])


def appended(log: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """An append-only log with ``rows`` added under the next ids, in the order of their own ids; nothing stored changes."""
    from .keyed import ranked_in_order

    base = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))  # one row
    new = ranked_in_order(rows, ["id"]).crossJoin(F.broadcast(base)).withColumn("id", F.col("base") + F.col("pos")).withColumn("created_at", at)
    return log.unionByName(new.select(*log.columns))


def checked_batches(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``batch_id, asked, told, usable``: whether a batch's answers are as many as asked for and name only jobs of it.

    ``requests`` and ``responses``: batch_id, job_id. A batch without any answer
    isn't usable. Answers that name a job twice count twice.
    """
    asked = requests.groupBy("batch_id").agg(F.count("*").alias("asked"))
    known = responses.join(requests.select("batch_id", "job_id").distinct().withColumn("known", F.lit(1)), ["batch_id", "job_id"], "left")
    told = known.groupBy("batch_id").agg(F.count("*").alias("told"), F.count("known").alias("known"))
    out = asked.join(told, "batch_id", "left").withColumn("told", F.coalesce("told", F.lit(0)))
    return out.select("batch_id", "asked", "told", ((F.col("told") == F.col("asked")) & (F.coalesce("known", F.lit(0)) == F.col("told"))).alias("usable"))


def surviving_children(children: DataFrame, parents: DataFrame, cascade: str, set_null: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Children after their parents were deleted: rows of a gone ``cascade`` parent go, a gone ``set_null`` parent becomes null.

    ``parents``: id; ``set_null``: a column and the table (id) that it refers to.
    """
    out = children.join(parents.select(F.col("id").alias(cascade)), cascade, "left_semi")
    if set_null is not None:
        column, table = set_null
        held = table.select(F.col("id").alias(column)).withColumn("_held", F.lit(True))
        out = out.join(held, column, "left").withColumn(column, F.when(F.col("_held"), F.col(column))).drop("_held")
    return out.select(*children.columns)


def stats(view: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """``kind, name, n``: all postings, those first seen in the last hours, and counts by status and by label of the latest evaluation."""
    lines = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")), F.when(F.col("first_seen_at") >= now - F.expr(f"interval {hours} hours"), F.struct(F.lit("new").alias("kind"), F.lit("").alias("name"))),
        F.struct(F.lit("status").alias("kind"), F.col("status").alias("name")), F.when(F.col("recommendation").isNotNull(), F.struct(F.lit("label").alias("kind"), F.col("recommendation").alias("name"))),
    )
    return view.select(F.explode(F.array_compact(lines)).alias("l")).groupBy("l.kind", "l.name").agg(F.count("*").alias("n"))
