"""Variant spellings of names typed by people.

MinHash banding over padded q-grams finds candidates, Monge-Elkan similarity
verifies them, star clustering groups them. Bands are chosen from the collision
curve for the wanted recall.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, merged

# Legal forms, and words around hiring, which tell no names apart. Further such words are found by their frequency.
LEGAL = "ltd limited inc incorporated llc llp corp corporation co company gmbh ag plc pvt private pte sa the and"
HIRING = "hr careers career hiring team jobs recruitment recruiting india"
#: Letters that an abbreviation of a word keeps at least.
LEAST_KEPT = 5


def folded(name: str) -> str:
    """Lower case without accents or invisible characters."""
    flat = unicodedata.normalize("NFKD", name.replace("ß", "ss").replace("ø", "o").replace("Ø", "O"))
    return "".join(c for c in flat if not unicodedata.combining(c) and c not in "​‌‍⁠﻿­").lower()


def words_in(name: str) -> list[str]:
    """The words of a name: run-together capitals cut, brackets and markup left out, letters that marks keep apart joined (S.W., s/w)."""
    apart = re.sub(r"(?<=[^\W\d_A-Z]{4})(?=[A-Z][^\W\d_A-Z]{4})", " ", name)  # TwoNames
    text = re.sub(r"\([^)]*\)|<[^>]*>|&[a-z]+;", " ", folded(apart))
    text = re.sub(r"\b[^\W\d_](?:\s*[/.&]\s*[^\W\d_])+\b", lambda m: re.sub(r"[\s/.&]", "", m[0]), text)
    return re.findall(r"[^\W_]+", text)


def clips(short: str, full: str) -> bool:
    """Whether a word is a clipping of another: it begins alike and its letters follow one another in the other, or it is begun by it."""
    if len(short) > len(full):
        return len(full) >= LEAST_KEPT and short.startswith(full)
    if len(short) < 2 or short[0] != full[0] or len(short) == len(full):
        return False
    left = iter(full)
    return all(c in left for c in short)


class Generic:
    """Words that tell no names apart: given ones, and frequent ones with their clippings."""

    def __init__(self, given: frozenset[str], frequent: frozenset[str]):
        self.given, self.frequent = given, frequent - given
        self.known: dict[str, list[str]] = {}

    def lines(self, word: str) -> list[str]:
        """The frequent words that a word is or clips; none for given words."""
        if word in self.given:
            return []
        if word in self.frequent:
            return [word]
        if word not in self.known:
            if len(self.known) > 1 << 17:
                self.known.clear()
            self.known[word] = sorted(g for g in self.frequent if clips(word, g))
        return self.known[word]

    def __contains__(self, word: str) -> bool:
        return word in self.given or bool(self.lines(word))


def proper_words(words: list[str], generic: Generic) -> list[str]:
    """The words of a name that tell the entity apart; all words if none does."""
    return [w for w in words if w not in generic] or words


def _damerau(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


@lru_cache(maxsize=1 << 17)
def word_similarity(a: str, b: str) -> float:
    """1 for equal words, 0.95 if one abbreviates the other, else from edit distance."""
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) >= LEAST_KEPT and long.startswith(short):
        return 0.95
    most = 1
    best = 0.0
    d = _damerau(a, b, most)
    if d <= most:
        best = 1 - d / len(long)
    if LEAST_KEPT <= len(short) < len(long):  # an abbreviation with a slip
        d = min(_damerau(short, long[: len(short) + k], 1) for k in (-1, 0, 1))
        if d <= 1:
            best = max(best, 0.95 - 1 / len(long))
    return best


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The lower of both directions' mean of each word's best similarity."""
    if not a or not b:
        return 0.0
    s = [[word_similarity(x, y) for y in b] for x in a]
    there = sum(max(r) for r in s) / len(a)
    back = sum(max(r[k] for r in s) for k in range(len(b))) / len(b)
    return min(there, back)


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of so many rows after which pairs of this similarity collide with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def qgrams(words: list[str], q: int = 3) -> list[str]:
    """Q-grams of each whole word, padded at its beginning only, since abbreviations leave out the end."""
    return sorted({p[i : i + q] for w in words for p in ["^" * (q - 1) + w] for i in range(len(p) - q + 1)})


def _signature_fn(bands: int, rows: int, seed: int = 11):
    rng = np.random.default_rng(seed)
    n = bands * rows
    mul, add = rng.integers(1, 2**31, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**61, n, dtype=np.uint64)

    def keys(words: list[str]) -> list[int]:
        g = np.array([int.from_bytes(x.encode()[:8], "little") for x in qgrams(words)], dtype=np.uint64)
        if not len(g):
            return []
        h = (g * np.uint64(0x9E3779B97F4A7C15)) ^ (g >> np.uint64(7))
        m = ((h[None, :] * mul[:, None] + add[:, None]) >> np.uint64(16)).min(axis=1).reshape(bands, rows)
        out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
        for k in range(rows):
            out = (out ^ m[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(29)
        return out.astype(np.int64).tolist()

    return keys


def frequent_words(names: DataFrame, share: float, least: int = 8) -> frozenset[str]:
    """Words that at least this share of all distinct names hold; of these there are at most (words in a name) / share."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"w": [w for x in pdf["name"] for w in sorted(set(words_in(x)))]})

    total = names.count()
    counts = names.select("name").mapInPandas(split, "w string").groupBy("w").agg(F.count("*").alias("n"))
    return frozenset(r.w for r in counts.where(F.col("n") >= max(least, share * total)).collect())


def words_of(names: DataFrame, generic: Generic) -> DataFrame:
    """``name, n, words, lines`` with run-together names cut where both parts begin known names."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = [words_in(x) for x in pdf["name"]]
            yield pdf.assign(words=[proper_words(x, generic) for x in w], lines=[sorted({g for y in x for g in generic.lines(y)}) for x in w])

    typed = names.mapInPandas(split, "name string, n bigint, words array<string>, lines array<string>")
    key = lambda c: F.substring(c, 1, LEAST_KEPT + 1)  # noqa: E731  # the letters by which a part of a run-together name is looked up
    stems = typed.where("size(words) > 1").select(F.explode("words").alias("w")).where(F.length("w") > LEAST_KEPT).groupBy(key("w").alias("stem")).agg(F.count("*").alias("n_stem"))
    glued = typed.where((F.size("words") == 1) & (F.length(F.col("words")[0]) >= 2 * LEAST_KEPT)).select("name", F.col("words")[0].alias("w"))
    cuts = glued.select("name", "w", F.explode(F.sequence(F.lit(LEAST_KEPT), F.length("w") - LEAST_KEPT)).alias("at"))
    cuts = cuts.select("name", F.expr("substring(w, 1, at)").alias("l"), F.expr("substring(w, at + 1)").alias("r"))
    for side in ("l", "r"):
        cuts = cuts.join(stems.select(F.col("stem").alias(f"{side}_stem"), F.col("n_stem").alias(f"{side}_n")), key(F.col(side)) == F.col(f"{side}_stem"), "left")
    rank = F.struct(
        (F.col("l_n").isNotNull().cast("int") + F.col("r_n").isNotNull().cast("int")).alias("known"),
        (-F.abs(F.length("l") - F.length("r"))).alias("even"), F.col("l"), F.col("r"),
    )
    best = cuts.groupBy("name").agg(F.max(rank).alias("best")).where(f"best.known > 0 or length(best.l) + length(best.r) > {2 * LEAST_KEPT + 2}").select("name", F.array("best.l", "best.r").alias("parts"))
    return typed.join(merged(best), "name", "left").select("name", "n", "lines", F.array_sort(F.array_distinct(F.coalesce("parts", "words"))).alias("words"))


def candidate_pairs(cores: DataFrame, recall: float, similarity: float, rows: int) -> DataFrame:
    """``a, b`` of cores that share a band; hot buckets are joined, never collected."""
    keys = _signature_fn(bands_for(similarity, recall, rows), rows)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = [keys(list(w)) for w in pdf["words"]]
            yield pd.DataFrame({"core": np.repeat(pdf["core"].to_numpy(), [len(x) for x in k]), "band": [y for x in k for y in x]})

    # signing is work for the CPU: spread by core, however little there is to read
    signed = cores.select("core", "words").repartition(int(cores.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("core")).mapInPandas(sign, "core string, band bigint")
    # a core of a few letters becomes as many rows as there are bands
    return merged(signed.select(F.col("core").alias("a"), "band")).join(merged(signed.select(F.col("core").alias("b"), "band")), "band").where("a < b").select("a", "b").distinct()


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``v, center``: star clustering in order of priority.

    ``nodes``: v, prio (a unique, comparable value). ``edges``: a, b, sim, each pair once.
    In each round every unmarked node that outranks its unmarked neighbours
    becomes a star's center and its unmarked neighbours become satellites, of the
    most similar such center. The result equals the sequential algorithm's.
    """
    both = materialise(edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "sim").union(edges.select("b", "a", "sim")), "edges")
    linked = both.select("v").distinct()
    done = nodes.join(merged(linked), "v", "left_anti").select("v", F.col("v").alias("center"))
    open_ = materialise(nodes.join(merged(linked), "v", "left_semi").select("v", "prio"), "open")
    parts = [done]
    while open_.limit(1).count():
        live = both.join(merged(open_.select(F.col("v").alias("u"), F.col("prio").alias("u_prio"))), "u").join(merged(open_), "v")
        top = open_.join(merged(live.groupBy("v").agg(F.max("u_prio").alias("best"))), "v", "left")
        centers = top.where(F.col("best").isNull() | (F.col("prio") > F.col("best"))).select("v", "prio")
        sats = (
            live.join(merged(centers.select(F.col("v").alias("u"))), "u").groupBy("v").agg(F.max(F.struct("sim", "u_prio", "u")).alias("m")).select("v", F.col("m.u").alias("center"))
        )
        marked = materialise(centers.select("v", F.col("v").alias("center")).union(sats), "marked")
        parts.append(marked)
        open_ = materialise(open_.join(merged(marked.select("v")), "v", "left_anti"), "open")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def name_variants(
    rows: DataFrame, name: str = "company", threshold: float = 0.85, recall: float = 0.97, similarity: float = 0.4, band_rows: int = 3, stop: str = f"{LEGAL} {HIRING}", frequent: float = 0.01
) -> DataFrame:
    """``name, n, cluster``: every distinct spelling, its rows and its cluster.

    - Spellings whose proper words are the same set are one node (any order,
      accents, case, legal form or line of business).
    - Nodes that share a MinHash band are compared by Monge-Elkan similarity;
      at least ``threshold`` links them. ``recall`` is the wanted chance that a
      pair with Jaccard ``similarity`` of q-grams becomes a candidate.
    - ``stop`` words and words in at least ``frequent`` of the distinct names (lines
      of business and the like, and what clips them) tell no names apart; names that
      state different frequent words are no near spellings of each other.
    - Null and blank names are in no cluster. Names without any letter or digit
      are nodes of their own. Ties of priority go to the smaller spelling.
    - An empty table gives an empty result; repeated rows raise ``n`` only.
    """
    names = rows.select(F.col(name).alias("name")).where(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("n"))
    names = materialise(names, "spellings")
    generic = Generic(frozenset(stop.split()), frequent_words(names, frequent))
    typed = materialise(words_of(names, generic).withColumn("core", F.when(F.size("words") > 0, F.array_join("words", " ")).otherwise(F.concat(F.lit("\u0001"), "name"))), "names")
    cores = typed.groupBy("core").agg(F.sum("n").alias("n"), F.first("words").alias("words"), F.array_distinct(F.flatten(F.collect_set("lines"))).alias("lines"))
    words = cores.select("core", "words", "lines")
    pairs = candidate_pairs(cores, recall, similarity, band_rows)
    # how large words and pairs get isn't known beforehand: neither is sent to all
    pairs = pairs.join(merged(words.toDF("a", "a_words", "a_lines")), "a").join(merged(words.toDF("b", "b_words", "b_lines")), "b")
    # two different lines of business speak against near spellings
    pairs = pairs.where((F.size("a_lines") == 0) | (F.size("b_lines") == 0) | F.arrays_overlap("a_lines", "b_lines"))

    @F.pandas_udf("double")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([monge_elkan(list(p), list(q)) if len(p) == len(q) else 0.9 * monge_elkan(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    edges = materialise(pairs.withColumn("sim", similar("a_words", "b_words")).where(F.col("sim") >= threshold).select("a", "b", "sim"), "links")
    nodes = cores.select(F.col("core").alias("v"), F.struct("n", F.col("core").alias("k")).alias("prio"))
    stars = star_clusters(nodes, edges)
    return merged(typed).join(merged(stars.select(F.col("v").alias("core"), F.col("center").alias("cluster"))), "core").select("name", "n", "cluster")


def variant_pairs(variants: DataFrame) -> DataFrame:
    """``name_a, name_b``: each two spellings of a cluster, smaller first by UTF-8 bytes."""
    v = materialise(variants.select("name", "cluster"), "variants")
    return merged(v.select(F.col("name").alias("name_a"), "cluster")).join(merged(v.select(F.col("name").alias("name_b"), "cluster")), "cluster").where("name_a < name_b").select("name_a", "name_b")
