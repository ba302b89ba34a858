"""Sources: files of raw postings, stored listing pages and robots rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import skills_list
from ..functions.text import blank_to_null
from ..session import materialise

# Headers that may stand for the fields of a raw posting, in order of preference.
ALIASES = {
    "external_id": ["externalid", "id", "job_id", "jobid"],
    "company": ["company", "company_name", "employer", "organisation", "organization"],
    "title": ["title", "job_title", "role", "position"],
    "description": ["description", "job_description", "details", "summary"],
    "location": ["location", "city", "job_location"],
    "remote": ["remote", "workplace", "work_type", "worktype"],
    "salary": ["salary", "compensation", "pay", "ctc", "salary_range"],
    "experience": ["experience", "experience_required", "years", "exp"],
    "skills": ["skills", "tags", "keywords", "technologies"],
    "url": ["url", "job_url", "link", "joburl"],
    "application_url": ["applicationurl", "apply_url", "application_link", "applylink"],
    "posted_at": ["postedat", "posted", "date_posted", "posted_date", "published"],
}


def canonical(df: DataFrame) -> DataFrame:
    """Project a file's columns to the canonical fields; the first alias present wins, blank cells are null.

    Headers ignore case and outer space; inner space counts as ``_``. The whole row
    is kept as JSON in ``raw_data``.
    """
    have = {re.sub(r"\s+", "_", c.strip().lower()): c for c in df.columns}
    kinds = dict(df.dtypes)
    out = []
    for field, names in ALIASES.items():
        actual = next((have[n] for n in names if n in have), None)
        if actual is None:
            c = F.array().cast("array<string>") if field == "skills" else F.lit(None).cast("string")
        elif field == "skills":
            q = F.col(f"`{actual}`")
            c = F.filter(F.transform(q, lambda s: F.trim(s.cast("string"))), lambda s: s != "") if kinds[actual].startswith("array") else skills_list(q.cast("string"))
        else:
            c = blank_to_null(F.col(f"`{actual}`"))
        out.append(c.alias(field))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if df.columns else F.lit("{}")
    return df.select(*out, whole.alias("raw_data"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return canonical(spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of postings, or an object whose ``jobs`` is one; anything else is refused."""
    df = spark.read.json(path, multiLine=True)
    if "jobs" in df.columns and isinstance(df.schema["jobs"].dataType, T.ArrayType):
        return canonical(df.select(F.inline("jobs")))
    begins = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"^[\s\uFEFF]*(.)", 1).alias("c")).where("c != '['").limit(1).count()
    if begins or "_corrupt_record" in df.columns:
        raise ValueError(f"{path} is neither an array nor an object with jobs")
    return canonical(df)


def read_import(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_json(spark, path)


def read_all(sources: dict[str, Callable[[], DataFrame]], limit: int | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of all sources that can be read, tagged with their name, and the errors of those that can't.

    Each source is read once, to the shared folder, so that one that breaks off
    while it is read is an error of its own and stops none of the others.
    """
    out, errors = None, {}
    for name, read in sources.items():
        try:
            df = read()
            df = materialise((df.limit(limit) if limit else df).withColumn("source", F.lit(name)), "source")
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        except Exception as e:  # one bad source must not stop the others
            errors[name] = str(e).split("\n")[0]
    return out, errors


class Registry:
    """Sources by name: reader functions that take options, with a status and a note.

    ``read`` builds only the sources asked for; unknown names come back as
    warnings. Options: queries, locations, limit, max_pages, posted_within_days;
    ``limit`` and ``queries`` (a row fits if its title or description holds any)
    are applied here, the others are the reader's.
    """

    STATUSES = ("SUPPORTED", "EXPERIMENTAL", "UNSUPPORTED")

    def __init__(self):
        self.sources: dict[str, tuple[Callable[..., DataFrame], str, str]] = {}

    def add(self, name: str, read: Callable[..., DataFrame], status: str = "SUPPORTED", notes: str = "") -> None:
        if status not in self.STATUSES:
            raise ValueError(f"status must be one of {self.STATUSES}")
        self.sources[name] = (read, status, notes)

    def read(self, names: list[str], **options) -> tuple[DataFrame | None, dict[str, str], list[str]]:
        """All rows, errors by source, and the names that no source has."""
        queries, limit = options.get("queries"), options.get("limit")

        def one(name: str) -> DataFrame:
            df = self.sources[name][0](**{k: v for k, v in options.items() if k not in ("queries", "limit")})
            return matching(df, queries) if queries else df

        known = {n: (lambda n=n: one(n)) for n in names if n in self.sources}
        rows, errors = read_all(known, limit)
        return rows, errors, [n for n in names if n not in self.sources]


def matching(rows: DataFrame, queries: list[str]) -> DataFrame:
    """Rows whose title or description holds any of the queries, ignoring case."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    return rows.where(F.exists(F.array(*[F.lit(q.lower()) for q in queries]), lambda q: text.contains(q)))


def first_addresses(rows: DataFrame, part: str, url: str, order: list[str], title: str = "title") -> DataFrame:
    """Rows with a title, the first of each address of a part in the given order."""
    rows = rows.where(F.trim(title) != "")
    first = rows.groupBy(part, url).agg(F.min(F.struct(*order)).alias("_m")).select(part, url, "_m.*")
    return rows.join(first, [part, url, *order], "left_semi")


def source_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of each named source, 0 for those without any."""
    wanted = rows.sparkSession.createDataFrame([(n,) for n in names], "source string")
    return wanted.join(rows.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


class _Listing(HTMLParser):
    """Elements of a class as records: title (of class or heading), link and text."""

    def __init__(self, item_class: str):
        super().__init__()
        self.item, self.depth, self.rows, self.heading = item_class, 0, [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.depth:
            self.depth += tag not in ("br", "img", "hr", "input", "meta", "link")
            if tag == "a" and a.get("href") and self.rows[-1]["link"] is None:
                self.rows[-1]["link"] = a["href"]
            self.heading += tag in ("h1", "h2", "h3", "h4")
        elif self.item in (a.get("class") or "").split():
            self.depth = 1
            self.rows.append({"title": "", "link": a.get("href"), "text": ""})

    def handle_endtag(self, tag):
        if self.depth and tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.depth -= 1
            self.heading -= tag in ("h1", "h2", "h3", "h4") and self.heading > 0

    def handle_data(self, data):
        if self.depth:
            self.rows[-1]["text"] += data
            if self.heading:
                self.rows[-1]["title"] += data


def listings(pages: DataFrame, item_class: str, url: str = "url", html: str = "html") -> DataFrame:
    """``page_url, no, title, url, text`` of every listing element of stored pages; titles are required."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, text in zip(pdf["page_url"], pdf["html"], strict=True):
                p = _Listing(item_class)
                p.feed(text or "")
                out += [(page, k, " ".join(r["title"].split()), urljoin(page, r["link"]) if r["link"] else page, " ".join(r["text"].split())) for k, r in enumerate(p.rows)]
            df = pd.DataFrame(out, columns=["page_url", "no", "title", "url", "text"])
            yield df[df["title"] != ""]

    return pages.select(F.col(url).alias("page_url"), F.col(html).alias("html")).mapInPandas(parse, "page_url string, no int, title string, url string, text string")


def page_url(base: str, n: int, style: str = "query", param: str = "page", start: int = 1) -> str:
    """The address of the n-th page of a listing; the start page is the listing itself."""
    if n == start:
        return base
    if style == "path":
        return f"{base.rstrip('/')}/{param}/{n}"
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    u = urlsplit(base)
    return urlunsplit(u._replace(query=urlencode([(k, v) for k, v in parse_qsl(u.query) if k != param] + [(param, str(n))])))


def robots_policy(status: int, body: str | None) -> str:
    """What the answer to a request for robots.txt means: ``allow`` all, ``deny`` all, or ``rules`` to be read; unclear answers deny."""
    if status in (404, 410):
        return "allow"
    if status != 200 or body is None or re.match(r"\s*<(?:!doctype|html)", body, re.I):
        return "deny"
    return "rules"


def robots_delay(text: str, agent: str) -> float | None:
    """Seconds to wait between requests that the group for an agent asks for."""
    found = [float(v) for k, v in robots_rules(text, agent, ("crawl-delay",)) if re.fullmatch(r"\d+(?:\.\d+)?", v)]
    return max(found) if found else None


def robots_gate(requests: DataFrame, answers: dict[str, tuple[int, str | None]], agent: str, url: str = "url") -> DataFrame:
    """``requests`` with ``allowed``: by the robots.txt answer (status, body) of each origin; origins without an answer are denied."""
    origin, path = F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1), F.regexp_replace(url, r"^[a-z]+://[^/?#]+", "")
    out = requests.withColumn("_path", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    allowed = F.lit(False)
    for name, (status, body) in answers.items():
        policy = robots_policy(status, body)
        fits = rule_allows("_path", robots_rules(body, agent)) if policy == "rules" else F.lit(policy == "allow")
        allowed = F.when(origin == name, fits).otherwise(allowed)
    return out.withColumn("allowed", allowed).drop("_path")


def robots_rules(text: str, agent: str, kinds: tuple[str, ...] = ("allow", "disallow")) -> list[tuple[str, str]]:
    """(allow|disallow, pattern) of the group for an agent: the longest name contained in it, else ``*``."""
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    open_ = False
    for line in text.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            open_ = True
        elif key in ("allow", "disallow", "crawl-delay") and groups:
            open_ = False
            if value and key in kinds:
                groups[-1][1].append((key, value))
    fits = [(len(a), rules) for agents, rules in groups for a in agents if a != "*" and a in agent.lower()]
    best = [r for n, r in fits if n == max(f[0] for f in fits)] if fits else [r for agents, r in groups if "*" in agents]
    return [x for r in best for x in r]


def rule_allows(path: str, rules: list[tuple[str, str]]) -> Column:
    """The longest matching rule decides, allow wins ties, none allows."""

    def pattern(p: str) -> str:
        body = "".join(".*" if c == "*" else re.escape(c) for c in p.removesuffix("$"))
        return "^" + body + ("$" if p.endswith("$") else "")

    def longest(kind: str) -> Column:
        return F.greatest(F.lit(-1), F.lit(-1), *[F.when(F.col(path).rlike(pattern(p)), len(p)).otherwise(-1) for k, p in rules if k == kind])

    return longest("allow") >= longest("disallow")


def robots_allowed(paths: DataFrame, path: str, rules: list[tuple[str, str]]) -> DataFrame:
    """``paths`` with ``allowed``, see :func:`rule_allows`."""
    return paths.withColumn("allowed", rule_allows(path, rules))
