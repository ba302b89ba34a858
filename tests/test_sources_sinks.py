import json

import pytest

from sievework.sources import readers, sinks


def test_imports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Job Title,Company Name,Skills,Link\n" Dev ",Acme,"a, b;c",http://x/1\n,,,\n')
    (tmp_path / "b.json").write_text(json.dumps({"jobs": [{"title": "T", "company": "C", "skills": ["x", " "], "url": "u"}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"role": "R", "description": None, "title": None}]))
    a = readers.read_import(spark, str(tmp_path / "a.csv")).collect()
    assert (a[0].title, a[0].company, a[0].skills, a[0].url) == ("Dev", "Acme", ["a", "b", "c"], "http://x/1")
    assert readers.read_import(spark, str(tmp_path / "b.json")).first().skills == ["x"]
    assert readers.read_import(spark, str(tmp_path / "c.json")).first().title is None  # the first alias present wins

    (tmp_path / "d.csv").write_text("role,position,ctc,workplace,published,organisation,jobid,joburl,exp,keywords,applylink\nR,P,9 LPA,Hybrid,today,O,7,u,2 years,a;b,v\n")
    d = readers.read_import(spark, str(tmp_path / "d.csv")).first()
    assert (d.title, d.salary, d.remote, d.posted_at, d.company, d.external_id, d.url, d.experience, d.skills, d.application_url) == ("R", "9 LPA", "Hybrid", "today", "O", "7", "u", "2 years", ["a", "b"], "v")
    (tmp_path / "e.json").write_text(json.dumps({"title": "one posting, no list"}))
    with pytest.raises(ValueError):
        readers.read_import(spark, str(tmp_path / "e.json"))

    def bad():
        raise OSError("gone")

    def bad_when_read():
        from pyspark.sql import functions as F

        return spark.range(3).select(F.raise_error(F.lit("broken file")).cast("string").alias("title"))

    df, errors = readers.read_all({"a": lambda: readers.read_csv(spark, str(tmp_path / "a.csv")), "bad": bad, "late": bad_when_read})
    assert errors["bad"] == "gone" and set(errors) == {"bad", "late"} and {r.source: r.n for r in readers.source_counts(df, ["a", "bad"]).collect()} == {"a": 2, "bad": 0}


def test_registry(spark):
    r = readers.Registry()
    rows = spark.createDataFrame([("Cook", "kitchen"), ("Chef", None), (None, "cooking")], "title string, description string")
    r.add("a", lambda **_: rows, "EXPERIMENTAL", "a test")
    r.add("paged", lambda max_pages=9, **_: rows.limit(max_pages))
    got, errors, unknown = r.read(["a", "paged", "nobody"], queries=["COOK"], max_pages=1)
    assert {(x.source, x.title) for x in got.collect()} == {("a", "Cook"), ("a", None), ("paged", "Cook")}
    assert errors == {} and unknown == ["nobody"]
    with pytest.raises(ValueError):
        r.add("b", lambda: rows, "GOOD")


def test_listings_and_pages(spark):
    html = '<div class="job"><h3>Cook</h3><a href="/j/1">more</a> Pune</div><div class="job"><p>no title</p></div>'
    rows = readers.listings(spark.createDataFrame([("https://x.example/jobs", html), ("https://x.example/e", None)], "url string, html string"), "job").collect()
    assert [(r.title, r.url) for r in rows] == [("Cook", "https://x.example/j/1")]
    assert readers.page_url("https://x/jobs?q=1", 2) == "https://x/jobs?q=1&page=2" and readers.page_url("https://x/jobs/", 3, "path") == "https://x/jobs/page/3" and readers.page_url("u", 1) == "u"


def test_robots(spark):
    rules = readers.robots_rules("User-agent: *\nDisallow: /\nAllow: /blog/ # c\nUser-agent: mybot\nUser-agent: other\nDisallow: /tmp$\nDisallow: /search/*/private", "MyBot/1.0")
    got = readers.robots_allowed(spark.createDataFrame([("/tmp",), ("/tmp/x",), ("/search/a/private/z",), ("/",)], "p string"), "p", rules).collect()
    assert [r.allowed for r in got] == [False, True, False, True]
    star = readers.robots_rules("User-agent: *\nDisallow: /\nAllow: /blog/", "x")
    assert [r.allowed for r in readers.robots_allowed(spark.createDataFrame([("/blog/post",), ("/jobs",)], "p string"), "p", star).collect()] == [True, False]


def test_robots_gate(spark):
    assert [readers.robots_policy(*x) for x in ((404, None), (410, ""), (500, "x"), (200, " <HTML>"), (200, None), (200, "User-agent: *"))] == ["allow", "allow", "deny", "deny", "deny", "rules"]
    assert readers.robots_delay("User-agent: *\nCrawl-delay: 2.5\nDisallow: /x", "b") == 2.5 and readers.robots_delay("User-agent: *\nCrawl-delay: soon", "b") is None
    rows = spark.createDataFrame([("https://a.example/x",), ("https://a.example",), ("https://b.example/",)], "url string")
    got = readers.robots_gate(rows, {"https://a.example": (200, "User-agent: *\nDisallow: /x")}, "b").collect()
    assert [r.allowed for r in got] == [False, True, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', ["x", "y"], True, 0.5), (2, None, None, None, None)], "id int, t string, l array<string>, new boolean, c double")
    assert sinks.write_csv_file(df.orderBy("id"), str(tmp_path / "o.csv")) == 2
    raw = (tmp_path / "o.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b'"a ""q"", b",x; y,yes,0.50' in raw and b"unknown" in raw
    sinks.write_json_file(df, str(tmp_path / "o.json"), {"n": 2})
    assert len(json.loads((tmp_path / "o.json").read_text())["jobs"]) == 2
    with pytest.raises(ValueError):
        sinks.write_csv_file(df, str(tmp_path / "p.csv"), limit=1)
    sinks.write_csv(df, str(tmp_path / "dir"))
    snaps = sinks.Snapshots(spark, f"file://{tmp_path}/snap")
    assert snaps.read() is None and snaps.write(df) == 1 and snaps.write(df.limit(1)) == 2 and snaps.read().count() == 1 and snaps.read(1).count() == 2
    # a write that broke off before its commit, and a second writer of the same version
    df.write.parquet(f"{tmp_path}/snap/v=3-broken")
    assert snaps.version() == 2
    other = sinks.Snapshots(spark, f"file://{tmp_path}/snap")
    other.version = lambda: 1
    with pytest.raises(ValueError):
        other.write(df)
    assert snaps.read().count() == 1
