import datetime as dt

from pyspark.sql import functions as F

from sievework.operators import records
from sievework.sources import sinks

def now():
    return F.lit(dt.datetime(2026, 9, 12)).cast("timestamp_ntz")


RAW = "source string, external_id string, company string, title string, description string, location string, remote string, salary string, experience string, skills array<string>, url string, application_url string, posted_at string"


def raw(spark, *rows):
    base = dict(source="test", external_id="t-1", company="Acme Corp", title="Cook", description="<p>Good food</p>", location="Pune", remote=None, salary=None, experience=None, skills=["a", " a", ""], url="https://x.example/1", application_url=None, posted_at="3 days ago")
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], RAW)


def test_normalized(spark):
    df = raw(spark, {}, {"title": " "}, {"company": None}, {"url": ""}, {"external_id": None}, {"external_id": " ", "url": "http://www.x.example/1?utm_source=z"}, {"description": "<b>Fully remote</b>", "location": None}, {"description": "x " * 800 + "remote"}, {"skills": None})
    got = records.normalized(df, now()).collect()
    assert [r.error for r in got][:4] == [None, "job has no title", "job has no company", "job has no URL"]
    assert got[4].external_id == got[5].external_id and len(got[4].external_id) == 32 and got[0].external_id == "t-1"
    assert (got[0].description, got[0].skills, got[0].posted_at.day, got[0].remote, got[0].salary, got[0].application_url) == ("Good food", ["a"], 9, None, None, None)
    assert got[6].remote == "REMOTE" and got[7].remote is None and got[8].skills == [] and len(got[0].fingerprint) == 64
    assert records.normalized(df.limit(0), now()).count() == 0
    # columns of other names stay
    assert records.normalized(df.withColumn("node", F.lit(7)), now()).first().node == 7


def test_applications(spark):
    stored = spark.createDataFrame([(1, 5, "NEW", "n", None, [], None, None)], records.schema_of("job_applications"))
    at = lambda h: dt.datetime(2026, 1, 1, h)
    ups = [(5, 1, "INTERESTED", None, at(1)), (5, 2, "APPLIED", "note", at(2)), (5, 3, "APPLIED", None, at(3)), (5, 4, "INTERVIEWING", None, at(4)), (5, 5, "APPLIED", None, at(5)), (6, 1, None, "only a note", at(1)), (6, 2, "NEW", None, at(2)), (7, 1, "APPLIED", None, at(1))]
    u = spark.createDataFrame(ups, "job_id bigint, seq int, status string, notes string, at timestamp_ntz")
    got = {r.job_id: r for r in records.updated_applications(stored, u, ["seq"]).collect()}
    assert [h.status for h in got[5].status_history] == ["INTERESTED", "APPLIED", "INTERVIEWING", "APPLIED"] and got[5].applied_at == at(2) and got[5].notes == "note"
    assert (got[6].status, got[6].status_history, got[6].notes) == ("NEW", [], "only a note")
    assert ([h.status for h in got[7].status_history], got[7].applied_at, got[7].notes) == (["APPLIED"], at(1), "")
    assert records.updated_applications(stored, u.limit(0), ["seq"]).collect()[0].status == "NEW"


def test_runs_and_logs(spark):
    runs = spark.createDataFrame([], records.schema_of("runs"))
    runs = records.started_runs(runs, spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 1, 2)), (3, dt.datetime(2026, 1, 3))], "id bigint, started_at timestamp_ntz"))
    assert {r.status for r in runs.collect()} == {"RUNNING"}
    end = dt.datetime(2026, 1, 4)
    c = spark.createDataFrame([(1, end, None, 9), (2, end, "boom", 8), (99, end, None, 1)], "id bigint, at timestamp_ntz, error string, jobs_new bigint")
    got = {r.id: r for r in records.closed_runs(records.closed_runs(runs, c), c.where("id = 2")).collect()}
    assert (got[1].status, got[1].jobs_new, got[1].completed_at) == ("COMPLETED", 9, end) and (got[2].status, got[2].errors, got[2].jobs_new) == ("FAILED", ["boom", "boom"], None) and got[3].status == "RUNNING" and len(got) == 3
    log = spark.createDataFrame([(4, "a", None)], "id bigint, v string, created_at timestamp_ntz")
    out = records.appended(log, log.union(log.selectExpr("id + 1", "'b'", "created_at")), now()).orderBy("id").collect()
    assert [(r.id, r.v) for r in out] == [(4, "a"), (5, "a"), (6, "b")]


def test_batches_and_children(spark):
    q = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4), (4, 5)], "batch_id int, job_id int")
    r = spark.createDataFrame([(1, 1), (1, 2), (2, 9), (3, 4), (3, 4)], "batch_id int, job_id int")
    assert {x.batch_id: x.usable for x in records.checked_batches(q, r).collect()} == {1: True, 2: False, 3: False, 4: False}
    kids = spark.createDataFrame([(1, 1, 7), (2, 2, None), (3, 3, 8)], "id int, job_id int, run_id int")
    left = records.surviving_children(kids, spark.createDataFrame([(1,), (3,)], "id int"), "job_id", ("run_id", spark.createDataFrame([(7,)], "id int"))).orderBy("id").collect()
    assert [tuple(x) for x in left] == [(1, 1, 7), (3, 3, None)]
    assert records.conform(kids.withColumn("status", F.lit(None).cast("string")), "job_applications").count() == 0


def test_report_text():
    text = sinks.summary_text({"b": 2, "a": 1}, {"kept": 3}, {"APPLY": 1}, {"x": 1, "y": 2}, [(88.5, "APPLY", "Acme", "Cook")], ["late"])
    assert text.index("- y: 2") < text.index("- x: 1") and "88.5  APPLY" in text and "total:" in text and "- late" in text
    assert sinks.report_name("jobs", "csv", dt.date(2026, 9, 12)) == "jobs-2026-09-12.csv" and len(sinks.REPORT) == 19
