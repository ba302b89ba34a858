"""Queries of the problems in this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.units import annual_pay
from ..plans.training import _P2
from ..session import table
from .canonical import canonical_fields
from .fusion import fused_values, posting_claims, survivors
from .incremental import known_rows
from .leaks import decontaminated, leaks
from .mixing import mixture
from .names import name_variants, variant_pairs
from .neardup import near_duplicate_groups, near_duplicate_pairs
from .reading import reading_levels


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of company spellings that name the same employer."""
    return variant_pairs(name_variants(table(spark, sf_dir, "jobs")))


def p4_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company spelling, its rows and its employer's cluster."""
    return name_variants(table(spark, sf_dir, "jobs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference entry meant by each typed title and location, 0 if there is none."""
    t = lambda name: table(spark, sf_dir, name)
    return canonical_fields(t("jobs"), t("ref_titles"), t("ref_locations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of postings that are largely the same in spite of edits."""
    return near_duplicate_pairs(table(spark, sf_dir, "jobs"), "id", ["title", "company", "description"], similarity=0.6, width=3, least_words=20).select("id_a", "id_b")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of each posting and the number of its links."""
    return near_duplicate_groups(table(spark, sf_dir, "jobs"), "id", ["title", "company", "description"], similarity=0.6, width=3, least_words=20)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming postings that jobs or earlier accepted postings already hold."""
    jobs, new = table(spark, sf_dir, "jobs"), table(spark, sf_dir, "incoming_jobs")
    return known_rows(jobs, new, "id", "incoming_id", similarity=0.6, width=3, least_words=20).select(F.col("id").alias("incoming_id"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a run of an evaluation item, with the item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with leaks: dropped, or with the leaked words cut out."""
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How demanding each English document is to read, in three bands."""
    return reading_levels(table(spark, sf_dir, "documents")).select("doc_id", "band")


def _pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual_pay(*[table(spark, sf_dir, name) for name in ("jobs", "boards", "fx_rates", "pay_periods")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that supply description, pay and posting time of each fingerprint."""
    return survivors(table(spark, sf_dir, "jobs"), _pay(spark, sf_dir), table(spark, sf_dir, "boards"))


def p6_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable value of each field of each fingerprint, copied votes discounted."""
    values, _ = fused_values(posting_claims(table(spark, sf_dir, "jobs"), _pay(spark, sf_dir)))
    return values.select(F.col("g.x").alias("group_hash"), F.col("field").alias("field_name"), F.col("id").alias("row_id"), "probability", "n_claims")


def p6_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated accuracy of each source and the source on which it depends most."""
    _, learned = fused_values(posting_claims(table(spark, sf_dir, "jobs"), _pay(spark, sf_dir)))
    return spark.createDataFrame(learned, "source string, accuracy double, copied_from string, dependence double")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    import public_tokenizers  # where this machine keeps vocabularies; the operator takes any

    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, for which source and how often each is used."""
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source of the mixture."""
    return _mixture(spark, sf_dir)[1]


QUERIES = {"p6_found": p6_found, "p6_fused": p6_fused, "p6_sources": p6_sources, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p8_found": p8_found, "p8_cleaned": p8_cleaned, "p10_found": p10_found, "p7_found": p7_found, "p3_found": p3_found, "p3_groups": p3_groups, "p5_found": p5_found, "p4_found": p4_found, "p4_employers": p4_employers}



def _words(c: str) -> str:
    clean = rf"regexp_replace(regexp_replace({c}, '<[^>]*>|&[#A-Za-z0-9]{{1,10}};', ' ', 'g'), '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{00AD}}]', '', 'g')"
    return rf"coalesce(regexp_extract_all(lower({clean}), '[\p{{L}}\p{{N}}]+'), [])"


_P6_WORDS = _words("description")

# The others have none: they rest on fitted or learned values (4, 5, 6's fusion, 10) or on a flow (9).
# They are tested against brute force and fixtures.
ORACLES: dict[str, str] = {
    "p3_found": f"""
WITH w AS (SELECT id, list_concat(list_concat({_words('title')}, {_words('company')}), {_words('description')}) AS w, len({_words('description')}) AS n FROM jobs),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE n >= 20) t),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM o JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE o * 10 >= 6 * (a.n + b.n - o)""",
    "p3_groups": f"""
WITH RECURSIVE w AS (SELECT id, list_concat(list_concat({_words('title')}, {_words('company')}), {_words('description')}) AS w, len({_words('description')}) AS n FROM jobs),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE n >= 20) t),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
p AS MATERIALIZED (SELECT id_a, id_b FROM o JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE o * 10 >= 6 * (a.n + b.n - o)),
r AS (SELECT id, id AS root FROM c UNION SELECT p.id_b, r.root FROM r JOIN p ON p.id_a = r.id)
SELECT r.id, min(root) AS group_id, (SELECT count(*) FROM p WHERE p.id_a = r.id) AS n_links FROM r GROUP BY r.id""",
    "p7_found": f"""
WITH RECURSIVE x AS (SELECT -id AS id, title, company, description, fingerprint, content_hash FROM jobs WHERE id IS NOT NULL UNION ALL SELECT incoming_id, title, company, description, fingerprint, content_hash FROM incoming_jobs WHERE incoming_id IS NOT NULL),
w AS (SELECT id, list_concat(list_concat({_words('title')}, {_words('company')}), {_words('description')}) AS w, len({_words('description')}) AS n FROM x),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE n >= 20) t),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.id > b.id AND a.id > 0 GROUP BY ALL),
e AS (SELECT id, k, nullif(lower(regexp_replace(CASE k WHEN 1 THEN fingerprint ELSE content_hash END, '^\\s+|\\s+$', '', 'g')), '') AS v FROM x, (VALUES (1), (2)) k(k)),
p AS (SELECT a, b FROM o JOIN c m ON m.id = a JOIN c n ON n.id = b WHERE o * 10 >= 6 * (m.n + n.n - o) UNION SELECT m.id, n.id FROM e m JOIN e n ON m.k = n.k AND m.v = n.v AND m.id > n.id AND m.id > 0),
l AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS rn, coalesce((SELECT bool_or(b < 0) FROM p WHERE a = id), false) AS held, coalesce((SELECT list(b) FROM p WHERE a = id AND b > 0), []) AS before FROM x WHERE id > 0),
-- row after row: a row is new unless jobs or an accepted row before it holds it
r AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS accepted UNION ALL SELECT l.rn, CASE WHEN held OR list_has_any(before, accepted) THEN accepted ELSE list_append(accepted, id) END FROM r JOIN l ON l.rn = r.rn + 1)
SELECT id AS incoming_id FROM l WHERE NOT list_contains((SELECT accepted FROM r ORDER BY rn DESC LIMIT 1), id)""",
    "p6_found": _P2 + f""", j AS (SELECT *, lower(regexp_replace(fingerprint, '^\\s+|\\s+$', '', 'g')) AS k, len({_P6_WORDS}) AS n_words FROM jobs),
x AS (SELECT j.*, p.id IS NOT NULL AS paid, coalesce(b.trust_rank, 2147483647) AS r, coalesce(posted_at > TIMESTAMP '1970-01-01' AND posted_at <= last_seen_at, false) AS dated FROM j LEFT JOIN found p USING (id) LEFT JOIN boards b ON b.source = j.source WHERE k <> ''),
m AS (SELECT k, min(id) AS group_id, count(*) AS n FROM x GROUP BY k HAVING count(*) > 1)
SELECT group_id, (SELECT id FROM x WHERE x.k = m.k ORDER BY n_words DESC, id LIMIT 1) AS description_id, coalesce((SELECT id FROM x WHERE x.k = m.k AND paid ORDER BY r, id LIMIT 1), 0) AS salary_id,
 coalesce((SELECT id FROM x WHERE x.k = m.k AND dated ORDER BY posted_at DESC, id LIMIT 1), 0) AS posted_id FROM m""",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), i AS (SELECT item_id, {_words('text')} AS w FROM eval_items),
g AS (SELECT item_id, least(12, len(w)) AS n, array_to_string(w[k:k + least(12, len(w)) - 1], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS k FROM i WHERE len(w) > 0) t),
n AS (SELECT DISTINCT n FROM g),
h AS (SELECT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN n WHERE len(w) >= n) t)
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (n, run)""",
}
