"""Mapping typed values to the entries of a reference list.

Each distinct word of the typed values is repaired once: it is joined to the
reference vocabulary on deletion neighbourhoods (all words within one edit or
transposition meet there), on beginnings and on consonant skeletons. The
repaired words are then combined with soft TF-IDF to rank complete entries.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, merged
from .names import folded

# Short forms that neither edit distance nor a beginning explains.
TITLE_ALIASES = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "ld": "lead", "prin": "principal", "princ": "principal", "engg": "engineer", "eng": "engineer", "engr": "engineer",
    "ml": "machine learning", "sre": "site reliability engineer", "swe": "software engineer", "db": "database", "dba": "database administrator", "mgr": "manager", "dev": "developer", "pm": "product manager",
}
COUNTRY_ALIASES = {
    "us": "unitedstates", "usa": "unitedstates", "uk": "unitedkingdom", "gb": "unitedkingdom", "england": "unitedkingdom", "scotland": "unitedkingdom", "britain": "unitedkingdom", "uae": "unitedarabemirates",
    "in": "india", "ind": "india", "bharat": "india", "de": "germany", "deutschland": "germany", "at": "austria", "osterreich": "austria", "ie": "ireland", "pt": "portugal", "sg": "singapore",
}
#: Office hours are no country.
NOT_PLACES = r"\b(?:\d+ )?days? (?:a|per) week\b|\b(?:\d+ days? )?in (?:the )?office\b"
#: Letters for each edit that is taken for a slip, and of a word that may have any.
PER_EDIT, LEAST_EDITED = 5, 4
LEVELS = ("junior", "senior", "lead", "principal")


def words(text: str, ignore: str | None = None) -> list[str]:
    text = folded(re.sub(r"<[^>]*>|&[^;\s]{1,9};", " ", text))
    return re.findall(r"[^\W_]+", re.sub(ignore, " ", text) if ignore else text)


def deletions(word: str) -> list[str]:
    """The word with up to two letters left out (none below three letters, one below seven)."""
    out = {word}
    for _ in range(0 if len(word) < 3 else 1 if len(word) < 7 else 2):
        out |= {w[:k] + w[k + 1 :] for w in out for k in range(len(w))}
    return sorted(out)


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


class Reference:
    """A reference list, read from a small table, as entries of words.

    ``entries``: (ref_id, required words, qualifying words). The number of entries
    is bounded by ``limit``; a larger list is refused rather than collected.
    """

    def __init__(self, entries: list[tuple[int, list[str], list[str]]], aliases: dict[str, str], beginnings: bool, ignore: str | None = None):
        self.entries, self.aliases, self.beginnings, self.ignore = entries, aliases, beginnings, ignore
        seen: dict[str, set[int]] = {}
        for ref, need, qual in entries:
            for w in need + qual:
                seen.setdefault(w, set()).add(ref)
        n = max(1, len({e[0] for e in entries}))
        self.idf = {w: math.log(1 + n / len(s)) for w, s in seen.items()}
        #: run-together neighbours, each standing for its words
        self.vocabulary = {w: [w] for w in self.idf}
        for _, need, _ in entries:
            for a, b in zip(need, need[1:]):
                self.vocabulary.setdefault(a + b, [a, b])
        for short, full in aliases.items():
            if all(w in self.idf for w in full.split()):
                self.vocabulary[short] = full.split()


def _collect(table: DataFrame, limit: int) -> list:
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a reference list has more than {limit} entries")
    return rows


def title_reference(ref_titles: DataFrame, limit: int = 20_000) -> Reference:
    out = []
    for r in _collect(ref_titles.select("ref_id", "title").where("title is not null"), limit):
        w = words(r.title)
        out.append((r.ref_id, [x for x in w if x not in LEVELS], [x for x in w if x in LEVELS]))
    return Reference(out, TITLE_ALIASES, beginnings=True)


def location_reference(ref_locations: DataFrame, limit: int = 20_000) -> Reference:
    out = []
    for r in _collect(ref_locations.select("ref_id", "city", "country", "also_known_as").where("city is not null"), limit):
        for name in [r.city, *(r.also_known_as or [])]:
            out.append((r.ref_id, ["".join(words(name))], ["".join(words(r.country or ""))] if r.country else []))
    return Reference(out, COUNTRY_ALIASES, beginnings=False, ignore=NOT_PLACES)


def repaired(tokens: DataFrame, ref: Reference) -> DataFrame:
    """``token, word, sim``: the vocabulary's most similar words, of which each distinct token may mean any."""
    spark = tokens.sparkSession
    vocab = [(v, w, ref.vocabulary[v]) for v in ref.vocabulary for w in deletions(v)]
    near = _rows(spark, vocab, "v string, variant string, stands array<string>")

    @F.pandas_udf("array<string>")
    def variants(s: pd.Series) -> pd.Series:
        return s.map(deletions)

    # leaving out letters is work for the CPU: spread by token, however little there is to read
    spread = tokens.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("token"))
    # a token becomes as many rows as letters can be left out of it
    hit = merged(spread.select("token", F.explode(variants("token")).alias("variant"))).join(merged(near), "variant").select("token", "v", "stands").distinct()
    lev = F.levenshtein("token", "v")
    letters = lambda c: F.array_sort(F.split(c, ""))
    swapped = (lev == 2) & (F.length("token") == F.length("v")) & (letters(F.col("token")) == letters(F.col("v")))
    longest = F.greatest(F.length("token"), F.length("v"))
    edits = F.when(swapped, 1).when((lev == 3) & (F.length("token") == F.length("v")), 2).otherwise(lev)  # a transposition is one edit
    # one edit, and another for every further PER_EDIT letters; very short words have no room for any
    allowed = F.when(longest < LEAST_EDITED, 0).otherwise(F.greatest(F.lit(1), F.floor(longest / PER_EDIT)))
    hit = hit.where(edits <= allowed).select("token", "stands", (1 - edits / longest).alias("sim"))
    if ref.beginnings:
        plain = [w for w in ref.idf if len(w) > 3]
        starts = _rows(spark, [(w[:k], w) for w in plain for k in range(3, len(w))], "token string, w string")
        hit = hit.union(tokens.join(starts, "token").select("token", F.array("w"), F.lit(0.9)))
        firsts = _rows(spark, [(w[0], w) for w in plain], "first string, w string")
        bare = tokens.where("length(token) between 3 and 12 and token rlike '^[a-z]+$'").withColumn("first", F.substring("token", 1, 1))
        # letters left out: no vowel but the first letter remains, or most of the word does
        skeleton = F.expr("w rlike concat('^', regexp_replace(token, '(.)', '$1.*'), '$')")
        ends = F.substring("w", -1, 1) == F.substring("token", -1, 1)
        short = F.expr("not substring(token, 2) rlike '[aeiou]'")
        hit = hit.union(bare.join(firsts, "first").where(skeleton & (short | (ends & (F.length("token") >= 0.6 * F.length("w"))))).select("token", F.array("w"), F.when(ends, 0.9).otherwise(0.85)))
    best = hit.groupBy("token").agg(F.max("sim").alias("best"))
    hit = hit.join(best, "token").where("sim >= best - 1e-9")
    return hit.select("token", F.explode("stands").alias("word"), "sim").groupBy("token", "word").agg(F.max("sim").alias("sim"))


def map_values(values: DataFrame, ref: Reference, least: float = 0.7) -> DataFrame:
    """``value, ref_id, score`` of every distinct non-null value; ref_id 0 if none fits.

    - An entry fits if each of its required words is met with similarity of at
      least ``least`` by a word of the value (or by two or three run together),
      and if no qualifier of the value speaks against all of the entry's.
    - Of fitting entries the highest soft TF-IDF cosine wins, ties the smallest id.
    - Further words of a value (advertising, shifts, remarks) are ignored; blank
      values and values without a fitting entry get 0.
    """
    spark = values.sparkSession
    quals = {w for _, _, q in ref.entries for w in q}

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = [words(v, ref.ignore) for v in pdf["value"]]
            yield pd.DataFrame({"value": pdf["value"], "tokens": [sorted({"".join(x[i : i + k]) for k in (1, 2, 3) for i in range(len(x) - k + 1)}) for x in w]})

    distinct = values.where("value is not null").select("value").distinct()
    typed = materialise(distinct.mapInPandas(split, "value string, tokens array<string>"), "typed")
    held = typed.select("value", F.explode("tokens").alias("token"))
    fixed = repaired(held.select("token").distinct(), ref)
    weights = _rows(spark, list(ref.idf.items()), "word string, idf double")
    met = merged(held).join(merged(fixed), "token").groupBy("value", "word").agg(F.max("sim").alias("sim")).join(F.broadcast(weights), "word")
    met = materialise(met, "met")
    need = _rows(spark, [(k, ref_id, w, len(set(req)), sorted(set(q))) for k, (ref_id, req, q) in enumerate(ref.entries) for w in sorted(set(req))], "entry int, ref_id bigint, word string, n_req int, quals array<string>")
    cover = met.where(F.col("sim") >= least).join(F.broadcast(need), "word").groupBy("value", "entry", "ref_id", "n_req", "quals").agg(F.count("*").alias("n"), F.sum(F.col("sim") * F.col("idf") ** 2).alias("dot"), F.sum(F.col("idf") ** 2).alias("norm")).where("n = n_req")
    of_value = met.groupBy("value").agg(
        F.sum(F.col("sim") ** 2 * F.col("idf") ** 2).alias("v_norm"),
        F.map_from_entries(F.collect_list(F.when(F.col("word").isin(*sorted(quals)) if quals else F.lit(False), F.struct("word", F.struct("sim", "idf"))))).alias("said"),
    )
    idf = F.create_map(*[F.lit(x) for w in sorted(quals) for x in (w, ref.idf[w])]) if quals else F.create_map(F.lit(""), F.lit(0.0))
    scored = merged(cover).join(merged(of_value), "value")
    against = (F.size("said") > 0) & (F.size("quals") > 0) & ~F.arrays_overlap(F.map_keys("said"), "quals")
    zero = F.lit(0.0)
    q_dot = F.aggregate("quals", zero, lambda s, w: s + F.coalesce(F.try_element_at("said", w)["sim"], zero) * F.try_element_at(idf, w) ** 2)
    q_norm = F.aggregate("quals", zero, lambda s, w: s + F.try_element_at(idf, w) ** 2)
    scored = scored.where(~against).withColumn("score", (F.col("dot") + q_dot) / F.sqrt(F.col("v_norm") * (F.col("norm") + q_norm)))
    best = scored.groupBy("value").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("ref_id")).alias("r"))).alias("m"))
    return typed.select("value").join(merged(best), "value", "left").select("value", F.coalesce(-F.col("m.r"), F.lit(0)).cast("bigint").alias("ref_id"), F.coalesce("m.score", zero).alias("score"))


def canonical_fields(jobs: DataFrame, ref_titles: DataFrame, ref_locations: DataFrame) -> DataFrame:
    """``id, field_name, ref_id`` of each non-null title or location that isn't an entry as stored."""
    jobs = jobs.select("id", "title", "location")
    parts = []
    for field, ref, stored in (("title", title_reference(ref_titles), ref_titles.select(F.col("title").alias("value"))), ("location", location_reference(ref_locations), ref_locations.select(F.col("label").alias("value")))):
        open_ = jobs.select("id", F.col(field).alias("value")).where("value is not null").join(stored.where("value is not null").distinct(), "value", "left_anti")
        parts.append(merged(open_).join(merged(map_values(open_, ref)), "value").select("id", F.lit(field).alias("field_name"), "ref_id"))
    return parts[0].union(parts[1])
