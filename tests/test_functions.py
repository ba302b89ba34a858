import datetime as dt

from pyspark.sql import functions as F

from sievework.functions import jsonfn, parse
from sievework.functions import text as fn


def each(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.o for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_keys(spark):
    assert each(spark, fn.normalize_key, ["Ärzte & Co!", None, "  a--b ", "ﬁn²", "Foo™ Ⅷ"]) == ["arzte co", "", "a b", "fin2", "foo viii"]
    assert [fn.key_of(x) for x in ("Ärzte & Co!", None, "ﬁn²", "Foo™ Ⅷ")] == ["arzte co", "", "fin2", "foo viii"]
    assert each(spark, fn.normalize_company, ["Acme Technologies Pvt. Ltd.", "Global Inc"]) == ["acme", ""]
    assert each(spark, fn.normalize_title, ["Sr. Dev - Urgent Hiring", "SDE, nodejs"]) == ["senior developer", "software engineer node js"]
    assert each(spark, fn.normalize_url, ["HTTP://WWW.Example.com/Jobs/1/?utm_source=x#top", "not a url", "https://a.b/?b=2&a=1", None, "http://x.com?a=1", "http://x.com:80/?a=1", "https://x.com/p?b=2&a=9&b=1&c", "x.com/a//"]) == [
        "https://example.com/jobs/1", "not a url", "https://a.b/?a=1&b=2", "", "https://x.com/?a=1", "https://x.com/?a=1", "https://x.com/p?a=9&b=2&b=1&c=", "x.com/a",
    ]


def test_html_and_truncation(spark):
    pages = ["<p>a&nbsp;b</p><p>c &lt;d&gt;</p><script>x</script>", None, "<p>a</p>", "<section>x</section><table><tr>y &NBSP; z</table>", "<p>Hello</p><ul><li>One</li><li>Two</li></ul>", "<SCRIPT>evil()</SCRIPT><p>Safe</p>"]
    assert each(spark, fn.html_to_text, pages) == ["a b\n\nc <d>", "", "a", "x\n\ny z", "Hello\n\nOne\n\nTwo", "Safe"]
    short = each(spark, lambda c: fn.truncate_words(c, 10), ["0123456789", "012345678 abc", "01234567890123"])
    assert short == ["0123456789", "012345678\n[...description truncated...]", "0123456789\n[...description truncated...]"]


def test_similarity_and_keywords(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(fn.token_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
    assert each(spark, lambda c: fn.first_keyword(c, ["java", "night shift", "Kafka", "!"]), ["JavaScript", "Java!", "the night-shift", None, "Apache Kafka", "good night shifts"]) == [None, "java", "night shift", None, "Kafka", "night shift"]


def test_redaction_and_escape(spark):
    secrets = ["sk-or-v1-abcdefgh", "sk-" + "a" * 20, "sk-" + "a" * 19, "AIza" + "b" * 20, "AQ." + "c" * 20, "ghp_" + "d" * 20, "Bearer abcdefghijkl", "at http://u:p@h/", "mail a@b.example token=abc", None]
    assert each(spark, fn.redact, secrets) == ["[REDACTED]", "[REDACTED]", "sk-" + "a" * 19, "[REDACTED]", "[REDACTED]", "[REDACTED]", "[REDACTED]", "at [REDACTED]h/", "mail a@b.example token=abc", None]
    assert each(spark, fn.escape_like, [r"50%_\ "]) == [r"50\%\_\\ "]


def test_parsing(spark):
    assert each(spark, parse.work_place, ["Hybrid - 2 days remote", "Pune, India", "work from home", "on-site", None, "inoffice", "Fully remote", "remote-ish hybrids", "onsites"]) == ["HYBRID", None, "REMOTE", "ONSITE", None, "ONSITE", "REMOTE", "REMOTE", None]
    ranges = each(spark, parse.experience_range, ["5-9 years", "8+ years", "minimum 4 years", "Fresher", "10 years", "soon", "", None, "No experience required", "up to 3 yrs", "3 to 1 years"])
    assert [(r and (r.min_years, r.max_years)) for r in ranges] == [(5, 9), (8, None), (4, None), (0, None), (10, None), (None, None), None, None, (0, None), (None, 3), (1, 3)]
    now = F.lit(dt.datetime(2026, 9, 12))
    days = each(spark, lambda c: F.date_format(parse.posted_at(c, now), "yyyy-MM-dd"), ["3 days ago", "2 weeks ago", "recently", "yesterday", "2026-01-02"])
    assert days == ["2026-09-09", "2026-08-29", None, "2026-09-11", "2026-01-02"]
    pay = each(spark, parse.salary_range, ["\u20b935-50 LPA", "$70,000 - $95,000", "Not disclosed", "", None, "12 LPA fixed + variable", "GBP 900/month", "1.5 crore", "by skill"])
    assert [r and (r.currency, r.min, r.max, r.period) for r in pay] == [
        ("INR", 3_500_000, 5_000_000, "YEARLY"), ("USD", 70_000, 95_000, None), (None,) * 4, None, None, ("INR", 1_200_000, None, "YEARLY"), ("GBP", 900, None, "MONTHLY"), ("INR", 15_000_000, None, "YEARLY"), (None,) * 4,
    ]
    assert pay[2].raw == "Not disclosed" and pay[5].raw == "12 LPA fixed + variable"
    assert each(spark, lambda c: parse.duration_text(c.cast("double")), ["0.5", "59.6", "61", None]) == ["<1s", "1m 00s", "1m 01s", None]
    assert each(spark, parse.skills_list, ["a, b;a |c", None, " "]) == [["a", "b", "c"], [], []]


def test_json(spark):
    noisy = ['<think>{"a":0}</think>ok ```json\n{"a": 1}\n``` x', 'see {"a": "}", "b": [1]} end', "none", '{"a": ', None]
    assert each(spark, jsonfn.extract_json, noisy) == ['{"a": 1}', '{"a": "}", "b": [1]}', None, None, None]
    got = each(spark, lambda c: jsonfn.parsed(c, "a bigint"), ['x {"a": 3}', "nothing", "{a}"])
    assert [(r.value and r.value.a, r.stage) for r in got] == [(3, None), (None, "extract"), (None, "json")]
