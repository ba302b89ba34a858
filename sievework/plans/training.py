"""Queries of the general data problems (1 and 2) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import snapshot_changes
from ..operators.units import annual_pay, number_words
from ..session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys added, removed or changed in each delivery of each source."""
    found = snapshot_changes(table(spark, sf_dir, "job_snapshots"))
    return found.select(F.col("part").alias("source"), F.col("key").alias("external_id"), F.col("snapshot").alias("snapshot_no"), F.col("kind").alias("change_kind"))


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each kind per source and delivery."""
    return p1_found(spark, sf_dir).groupBy("source", "snapshot_no", "change_kind").agg(F.count("*").alias("n_keys"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base pay of each posting in whole rupees per year."""
    t = lambda name: table(spark, sf_dir, name)
    return annual_pay(t("jobs"), t("boards"), t("fx_rates"), t("pay_periods")).select("id", "inr_min", "inr_max")


def p2_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings of each source have pay, and its mean range."""
    jobs = table(spark, sf_dir, "jobs").select("id", "source")
    return (
        jobs.join(p2_found(spark, sf_dir), "id", "left").groupBy("source")
        .agg(F.count("*").alias("n_jobs"), F.count("inr_min").alias("n_paid"), F.sum("inr_min").alias("sum_min"), F.sum("inr_max").alias("sum_max"))
    )


QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary, "p2_found": p2_found, "p2_by_source": p2_by_source}

_P1 = r"""
WITH norm AS (
  SELECT source, upper(regexp_replace(external_id, '^\s+|\s+$', '', 'g')) AS k, snapshot_no,
         nullif(lower(regexp_replace(content_hash, '^\s+|\s+$', '', 'g')), '') AS h, last_seen_at FROM job_snapshots),
cur AS (
  SELECT source, k, snapshot_no, h FROM (
    SELECT *, row_number() OVER (PARTITION BY source, k, snapshot_no ORDER BY last_seen_at DESC NULLS LAST, h IS NULL, h DESC) AS rn
    FROM norm WHERE k IS NOT NULL AND k <> '') t WHERE rn = 1),
given AS (SELECT source, snapshot_no, row_number() OVER (PARTITION BY source ORDER BY snapshot_no) AS d FROM (SELECT DISTINCT source, snapshot_no FROM job_snapshots) t),
r AS (SELECT cur.source, k, d, h, d - row_number() OVER (PARTITION BY cur.source, k ORDER BY d) AS island FROM cur JOIN given USING (source, snapshot_no)),
e AS (SELECT source, k, d, island, last_value(h IGNORE NULLS) OVER (PARTITION BY source, k, island ORDER BY d) AS e FROM r),
l AS (SELECT *, lag(d) OVER w AS pd, lag(e) OVER w AS pe, lead(d) OVER w AS nd FROM e WINDOW w AS (PARTITION BY source, k ORDER BY d)),
last AS (SELECT source, max(d) AS last_d FROM given GROUP BY source),
ch AS (
  SELECT source, k, d, CASE WHEN pd IS NULL OR pd <> d - 1 THEN 'added' WHEN pe <> e THEN 'changed' END AS kind FROM l WHERE d > 1
  UNION ALL
  SELECT l.source, k, d + 1, 'removed' FROM l JOIN last USING (source) WHERE d < last_d AND (nd IS NULL OR nd <> d + 1)),
found AS (SELECT ch.source, k AS external_id, snapshot_no, kind AS change_kind FROM ch JOIN given USING (source, d) WHERE kind IS NOT NULL)
"""

_WORDS = ", ".join(f"'{w}': '{v:g}'" for w, v in number_words())
_CUR = r"us\$|s\$|\$|₹|£|€|rs\.?|inr|usd|sgd|gbp|eur|aed|dhs?\.?|rupees?"
_SCALE = "lpa|lakhs?|lacs?|crores?|cr|mn|k|l|m"
_EACH = "CASE WHEN regexp_matches({0}, '^(us\\$|\\$|usd)') THEN 'USD' WHEN regexp_matches({0}, '^(s\\$|sgd)') THEN 'SGD' WHEN regexp_matches({0}, '^(£|gbp)') THEN 'GBP' WHEN regexp_matches({0}, '^(€|eur)') THEN 'EUR' WHEN regexp_matches({0}, '^(aed|dh)') THEN 'AED' WHEN regexp_matches({0}, '^(₹|rs|inr|rup|l|cr)') THEN 'INR' END"
_TIMES = "CASE WHEN regexp_matches({0}, '^(lpa|la|l$)') THEN 1e5 WHEN starts_with({0}, 'cr') THEN 1e7 WHEN {0} = 'k' THEN 1e3 WHEN starts_with({0}, 'm') THEN 1e6 END"
_FIGURE = """CASE WHEN {0} = '' THEN NULL WHEN contains({0}, ',') AND contains({0}, '.') THEN CASE WHEN instr(reverse({0}), ',') < instr(reverse({0}), '.') THEN replace(replace({0}, '.', ''), ',', '.') ELSE replace({0}, ',', '') END
 WHEN len({0}) - len(replace(replace({0}, ',', ''), '.', '')) = 1 AND (NOT regexp_matches({0}, '[.,][0-9]{{3}}$') OR ({1} IS NOT NULL AND contains({0}, '.'))) THEN replace({0}, ',', '.') ELSE replace(replace({0}, ',', ''), '.', '') END::DOUBLE"""
_P2 = rf"""
WITH a AS (SELECT id, source, salary AS f, regexp_replace(lower(regexp_replace(salary.raw, '[\s\x{{00a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{feff}}\x{{00ad}}]+', ' ', 'g')), '\s*(\+ |plus |\(|, ?[0-9]+ (days|weeks)|, *[^0-9 ]|,$|incl|&).*$', '') AS s FROM jobs),
w AS (SELECT *, array_to_string(list_transform(string_split(s, ' '), lambda x: coalesce(MAP {{{_WORDS}}}[x], x)), ' ') AS t FROM a),
g AS (SELECT *, regexp_extract(t, '^[^0-9]*?(?:({_CUR}) ?)?([0-9][0-9.,]*[0-9]|[0-9]) ?(?:({_SCALE})\b)?(?: ?(?:-|–|—|to|bis|and) ?(?:(?:{_CUR}) ?)?([0-9][0-9.,]*[0-9]|[0-9]) ?(?:({_SCALE})\b)?)?(.*)$', ['c', 'n1', 's1', 'n2', 's2', 'rest']) AS g FROM w),
h AS (SELECT *, coalesce(nullif(g.s2, ''), nullif(g.s1, '')) AS sc, regexp_extract(g.rest, '(?:^|[^a-z])(p\. ?a|pa|annum|annually|annual|yearly|year|yr|jahr|jährlich|j|p\. ?m|pm|month|monthly|mth|mo|monat|monatlich|week|weekly|wk|day|daily|tag|hour|hourly|hr|ph|std|stunde)(?:[^a-z]|$)', 1) AS p FROM g),
u AS (SELECT *, {_TIMES.format('sc')} AS k, {_TIMES.format("nullif(g.s1, '')")} AS k1, coalesce({_EACH.format("nullif(g.c, '')")}, {_EACH.format(f"nullif(regexp_extract(g.rest, '(?:^|[^a-z])({_CUR})(?:[^a-z$]|$)', 1), '')")}, {_EACH.format('sc')}) AS cur,
 CASE WHEN p = '' THEN CASE WHEN sc IS NOT NULL THEN 'YEARLY' END WHEN regexp_matches(p, '^(p\. ?a|pa|ann|y|j)') THEN 'YEARLY' WHEN regexp_matches(p, '^(p\. ?m|pm|mo|mt)') THEN 'MONTHLY' WHEN p[1] = 'w' THEN 'WEEKLY' WHEN regexp_matches(p, '^(d|t)') THEN 'DAILY' ELSE 'HOURLY' END AS per,
 {_FIGURE.format('g.n1', 'sc')} AS x, {_FIGURE.format('g.n2', 'sc')} AS y FROM h),
b AS (SELECT source, default_currency, CASE WHEN contains(pay_note, 'lakh rupees per year') THEN 'YEARLY' WHEN contains(pay_note, 'thousands of dollars per year') THEN 'YEARLY' WHEN contains(pay_note, 'per hour') THEN 'HOURLY' WHEN contains(pay_note, 'per month') THEN 'MONTHLY' WHEN starts_with(pay_note, 'Yearly') THEN 'YEARLY' END AS note,
 CASE WHEN contains(pay_note, 'lakh') THEN 1e5 WHEN contains(pay_note, 'thousands') THEN 1e3 ELSE 1 END AS scale FROM boards),
v AS (SELECT u.*, b.*, coalesce(x > 0 AND coalesce(y, 1) > 0 AND (cur IS NOT NULL OR per IS NOT NULL OR note IS NOT NULL OR f.period IS NOT NULL OR f.currency IS NOT NULL) AND NOT regexp_matches(t, '\b(grade|level|band|see|ref)\b'), false) AS told FROM u LEFT JOIN b ON u.source = b.source),
z AS (SELECT id, v.source, CASE WHEN told THEN x * coalesce(k1, k, 1) ELSE coalesce(f.min, f.max) END AS lo, CASE WHEN told THEN coalesce(y * coalesce(k, 1), x * coalesce(k1, k, 1)) ELSE coalesce(f.max, f.min) END AS hi,
 coalesce(CASE WHEN told THEN cur END, f.currency, default_currency) AS currency, coalesce(CASE WHEN told THEN per END, upper(f.period), note) AS period_code, CASE WHEN NOT (told AND (cur IS NOT NULL OR per IS NOT NULL OR k IS NOT NULL)) THEN scale ELSE 1 END AS scale FROM v),
found AS (SELECT id, z.source, round(least(lo, hi) * m)::BIGINT AS inr_min, round(greatest(lo, hi) * m)::BIGINT AS inr_max FROM (SELECT z.*, CASE WHEN greatest(lo, hi) < 1000 THEN coalesce(scale, 1) ELSE 1 END * inr_per_unit * per_year AS m FROM z JOIN fx_rates USING (currency) JOIN pay_periods USING (period_code)) z WHERE lo > 0 AND hi > 0)
"""

ORACLES = {
    "p2_found": _P2 + "SELECT id, inr_min, inr_max FROM found",
    "p2_by_source": _P2 + "SELECT j.source, count(*) AS n_jobs, count(inr_min) AS n_paid, sum(inr_min)::BIGINT AS sum_min, sum(inr_max)::BIGINT AS sum_max FROM jobs j LEFT JOIN found USING (id) GROUP BY j.source",
    "p1_found": _P1 + "SELECT source, external_id, snapshot_no, change_kind FROM found",
    "p1_summary": _P1 + "SELECT source, snapshot_no, change_kind, count(*) AS n_keys FROM found GROUP BY ALL",
}
