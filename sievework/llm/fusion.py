"""Best representative of each duplicate group.

``fused_values`` is Bayesian fusion with copy detection: sources' accuracies and
their dependence are estimated from the values they share, copied votes are
discounted, and the value of greatest posterior survives. ``survivors`` applies
a stated order of preference to each field; where the wanted survivor is fixed
by rule, votes can't decide it, so that is a way of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.snapshots import canonical_hash
from ..session import materialise
from .shingles import word_array


#: Hashes in the sketch of a text.
SKETCH = 64


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``g``, the 128-bit hash of a stated key; unstated keys are left out."""
    k = canonical_hash(F.col(key))
    return rows.where(k.isNotNull()).withColumn("g", F.struct(F.xxhash64(k).alias("x"), F.xxhash64(k, F.lit(1)).alias("y")))


def survivors(rows: DataFrame, pay_ids: DataFrame, trust: DataFrame, key: str = "fingerprint") -> DataFrame:
    """``group_id, description_id, salary_id, posted_id`` of each key held by two or more rows.

    - The key ignores case and outer white space; null and blank keys are no group.
    - description: most words (a null text has none); salary: a row of ``pay_ids``
      (id) from the source of least ``trust_rank`` (``trust``: source, trust_rank;
      unknown sources come last), 0 if none; posted_at: the latest after
      1970-01-01 and not after the row's last_seen_at, 0 if none.
    - Ties go to the smallest id. Every choice is a partial aggregate, so a group
      may hold any share of the rows.
    """
    paid = pay_ids.select("id").distinct().withColumn("paid", F.lit(True))
    x = rows.select("id", "source", key, F.size(word_array(F.col("description"))).alias("n_words"), "posted_at", "last_seen_at")
    x = grouped(x, key).join(paid, "id", "left").join(trust.select("source", "trust_rank").dropDuplicates(["source"]), "source", "left")
    dated = (F.col("posted_at") > F.lit("1970-01-01").cast("timestamp_ntz")) & (F.col("posted_at") <= F.col("last_seen_at"))
    back = -F.col("id")
    out = x.groupBy("g").agg(
        F.count("*").alias("n"), F.min("id").alias("group_id"),
        F.max(F.struct("n_words", back.alias("k"))).alias("d"),
        F.min(F.when(F.col("paid"), F.struct(F.coalesce("trust_rank", F.lit(2**31 - 1)).alias("r"), F.col("id").alias("k")))).alias("s"),
        F.max(F.when(dated, F.struct("posted_at", back.alias("k")))).alias("p"),
    )
    zero = F.lit(0)
    return out.where("n > 1").select("group_id", (-F.col("d.k")).alias("description_id"), F.coalesce("s.k", zero).cast("bigint").alias("salary_id"), F.coalesce(-F.col("p.k"), zero).cast("bigint").alias("posted_id"))


def _merged(claims: list, alike: float) -> list[int]:
    """The value of each claim, near-equal values taken for one: that of the first claim of a value that is like them.

    ``claims``: source, value, id, sketch; the longest sketches come first. Values
    without sketch are alike only if equal.
    """
    first: list[tuple[int, set]] = []
    out = [0] * len(claims)
    for k in sorted(range(len(claims)), key=lambda k: (-len(claims[k][3]), claims[k][2])):
        value, sketch = claims[k][1], set(claims[k][3])
        for v, s in first:
            if v == value or (sketch and len(sketch & s) >= alike * len(sketch)):
                out[k] = v
                break
        else:
            first.append((value, sketch))
            out[k] = value
    return out


def _posterior(claims: list, accuracy: np.ndarray, copies: np.ndarray, wrong_values: float, copy_rate: float) -> dict[int, float]:
    """Probability of each claimed value of one field of one group.

    ``copies[s, o]``: the chance that s copies o. Of the claimants of a value,
    those that copy least count first, then the more accurate; each later one by
    the chance that it is independent of those before.
    """
    by: dict[int, list[int]] = {}
    for source, value, *_ in claims:
        by.setdefault(value, []).append(source)
    score = {}
    for value, sources in by.items():
        total, counted = 0.0, []
        for s in sorted(sources, key=lambda k: (sum(copies[k, o] for o in sources), -accuracy[k], k)):
            alone = 1.0
            for o in counted:
                alone *= 1 - copy_rate * min(1.0, copies[s, o] + copies[o, s])
            a = min(max(accuracy[s], 0.01), 0.99)
            total += alone * math.log(wrong_values * a / (1 - a))
            counted.append(s)
        score[value] = total
    top = max(score.values())
    e = {v: math.exp(x - top) for v, x in score.items()}
    rest = max(0.0, wrong_values + 1 - len(e)) * math.exp(-top)  # values that nobody states
    norm = sum(e.values()) + rest
    return {v: x / norm for v, x in e.items()}


def _dependence(same_true: float, same_false: float, different: float, a: float, b: float, wrong_values: float, copy_rate: float, prior: float) -> float:
    """Chance that one of two sources copies the other, from shared true, shared false and different values."""
    a, b = (min(max(x, 0.01), 0.99) for x in (a, b))
    t, f = a * b, (1 - a) * (1 - b) / wrong_values
    d = max(1 - t - f, 1e-9)
    m = (a + b) / 2
    ct, cf, cd = copy_rate * m + (1 - copy_rate) * t, copy_rate * (1 - m) + (1 - copy_rate) * f, (1 - copy_rate) * d
    log = same_true * math.log(t / ct) + same_false * math.log(f / cf) + different * math.log(d / cd) + math.log((1 - prior) / prior)
    return 1 / (1 + math.exp(min(max(log, -500), 500)))


def _direction(first_a: float, first_b: float, a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> float:
    """Chance that, of two dependent sources, a is the one that copies.

    ``first_a``, ``first_b``: shared values that a or b stated first. ``a``, ``b``:
    right and all of a source's values shared with the other, right and all of its
    others. Who copies tends to be later, and is as right on shared values as
    the other source, not as it is elsewhere.
    """

    def differs(right: float, n: float, right_else: float, n_else: float) -> float:
        p, q = (right + 1) / (n + 2), (right_else + 1) / (n_else + 2)
        spread = p * (1 - p) / (n + 2) + q * (1 - q) / (n_else + 2)
        return (p - q) ** 2 / spread / 2

    log = math.log(9) * (first_b - first_a) + differs(*a) - differs(*b)
    return 1 / (1 + math.exp(min(max(-log, -500), 500)))


def fused_values(
    claims: DataFrame, wrong_values: float = 20.0, copy_rate: float = 0.8, prior: float = 0.1, rounds: int = 4, most_sources: int = 1000, alike: float = 0.7
) -> tuple[DataFrame, pd.DataFrame]:
    """Fused values and what was learned about the sources.

    ``claims``: g, field, source, value (bigint), id, and maybe sketch (array of
    bigint: values whose sketches have ``alike`` of the smaller in common are one
    fact) and at (a comparable bigint, when it was claimed; else the id). Of
    several claims of a source for a field of a group the one of the most rows
    counts, ties the smallest id; so a field has at most as many claims as there
    are sources, whatever the size of the group. Result: ``g, field, id, value,
    probability, n_claims`` per group and field, id being the smallest of the rows
    with that value, and a table source, accuracy, copied_from, dependence, where
    copied_from is the source that it copies with a chance of more than a half.
    Null values claim nothing; groups with a single source keep its value.
    """
    have = set(claims.columns)
    sketch = F.coalesce("sketch", F.array().cast("array<bigint>")) if "sketch" in have else F.array().cast("array<bigint>")
    at = F.coalesce(F.col("at"), F.lit((1 << 63) - 1)) if "at" in have else F.col("id")
    one = claims.where("value is not null and source is not null").groupBy("g", "field", "source", "value").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min(at).alias("at"), F.max(sketch).alias("sketch"))
    one = one.groupBy("g", "field", "source").agg(F.max(F.struct("n", (-F.col("id")).alias("k"), "value", "at", "sketch")).alias("m"))
    names = [r.source for r in one.select("source").distinct().orderBy("source").limit(most_sources + 1).collect()]
    if len(names) > most_sources:
        raise ValueError(f"more than {most_sources} sources: their dependence can't be held on the driver")
    index = claims.sparkSession.createDataFrame([(s, k) for k, s in enumerate(names)], "source string, s int")
    claim = F.struct("s", F.col("m.value").alias("value"), (-F.col("m.k")).alias("id"), F.col("m.at").alias("at"), F.col("m.sketch").alias("sketch"))
    sets = one.join(index, "source").groupBy("g", "field").agg(F.sort_array(F.collect_list(claim)).alias("c"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            merged = [_merged([(r["s"], r["value"], r["id"], list(r["sketch"])) for r in c], alike) for c in pdf["c"]]
            yield pdf.assign(c=[[{"s": r["s"], "value": v, "id": r["id"], "at": r["at"]} for r, v in zip(c, m)] for c, m in zip(pdf["c"], merged)])

    flat = sets.select("g.x", "g.y", "field", "c").mapInPandas(merge, "x bigint, y bigint, field string, c array<struct<s: int, value: bigint, id: bigint, at: bigint>>")
    sets = materialise(flat, "claims")
    n = len(names)
    accuracy, copies = np.full(n, 0.8), np.zeros((n, n))

    def statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # by source: expected right values, values; by pair (s, o): values shared and right, shared, different, right of s where different, s before o
        own, pair = np.zeros((n, 2)), np.zeros((n, n, 5))
        for pdf in batches:
            for c in pdf["c"]:
                c = [(r["s"], r["value"], r["at"]) for r in c]
                if len(c) < 2:
                    continue
                p = _posterior(c, accuracy, copies, wrong_values, copy_rate)
                for s, v, t in c:
                    own[s] += p[v], 1
                    for o, w, u in c:
                        if s != o:
                            pair[s, o] += (p[v], 1, 0, 0, t < u) if v == w else (0, 0, 1, p[v], 0)
        a, b = np.nonzero(pair[:, :, 1] + pair[:, :, 2])
        out = np.concatenate([np.column_stack([np.arange(n), np.full(n, -1), own, np.zeros((n, 3))]), np.column_stack([a, b, pair[a, b]])])
        yield pd.DataFrame(out, columns=["a", "b", "v0", "v1", "v2", "v3", "v4"]).astype({"a": int, "b": int})

    for k in range(rounds):
        sums = [F.sum(f"v{j}").alias(f"v{j}") for j in range(5)]
        got = sets.select("c").mapInPandas(statistics, "a int, b int, v0 double, v1 double, v2 double, v3 double, v4 double").groupBy("a", "b").agg(*sums).collect()  # a row per pair of sources
        by = {(r.a, r.b): r[2:] for r in got}
        # dependence first, under the accuracies so far: sources that always agree mustn't make each other right
        for (a, b), (right, shared, different, right_a, first_a) in by.items():
            if a < b:
                _, _, _, right_b, first_b = by[b, a]
                true, false = (right, shared - right) if k else (shared, 0.0)  # at first nothing is known to be false
                both = _dependence(true, false, different, accuracy[a], accuracy[b], wrong_values, copy_rate, prior)
                a_copies = _direction(first_a, first_b, (right, shared, right_a, different), (right, shared, right_b, different))
                copies[a, b], copies[b, a] = both * a_copies, both * (1 - a_copies)
        if k:
            for (a, b), (right, stated, *_) in by.items():
                if b < 0 and stated:
                    accuracy[a] = (right + 0.8) / (stated + 1)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c in pdf["c"]:
                c = [(r["s"], r["value"], r["id"]) for r in c]
                p = _posterior(c, accuracy, copies, wrong_values, copy_rate)
                ids: dict[int, int] = {}
                for _, v, k in c:
                    ids[v] = min(k, ids.get(v, k))
                best = max(p, key=lambda v: (round(p[v], 9), -ids[v]))
                out.append((ids[best], best, round(p[best], 6), len(c)))
            yield pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "field": pdf["field"]}).assign(**{k: [o[j] for o in out] for j, k in enumerate(("id", "value", "probability", "n_claims"))})

    chosen = sets.mapInPandas(choose, "x bigint, y bigint, field string, id bigint, value bigint, probability double, n_claims int")
    learned = pd.DataFrame(
        {"source": names, "accuracy": np.round(accuracy, 6), "copied_from": [names[int(np.argmax(copies[k]))] if n > 1 and copies[k].max() > 0.5 else None for k in range(n)], "dependence": np.round(copies.max(axis=1), 6) if n else []}
    )
    return chosen.select(F.struct("x", "y").alias("g"), "field", "id", "value", "probability", "n_claims"), learned


def posting_claims(jobs: DataFrame, pay: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Claims of postings with the same key: text (with a sketch), pay per year and day of posting; earlier seen rows claim earlier."""
    x = grouped(jobs.select("id", "source", key, "description", "posted_at", "first_seen_at", "last_seen_at"), key)
    many = x.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    x = x.join(pay.select("id", "inr_min", "inr_max"), "id", "left").join(many, "g", "left_semi")
    words = word_array(F.col("description"))
    dated = (F.col("posted_at") > F.lit("1970-01-01").cast("timestamp_ntz")) & (F.col("posted_at") <= F.col("last_seen_at"))
    values = {
        "description": F.when(F.size(words) > 0, F.xxhash64(F.array_join(words, " "))),
        "salary": F.when(F.col("inr_min").isNotNull(), F.xxhash64("inr_min", "inr_max")),
        "posted_at": F.when(dated, F.unix_date(F.col("posted_at").cast("date")).cast("bigint")),
    }
    # the least hashes of a text's runs of three words tell how much two texts have in common
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda k: F.xxhash64(F.slice(words, k, F.lit(3))))
    sketch = F.when(F.size(words) > 2, F.slice(F.array_sort(F.array_distinct(runs)), 1, SKETCH))
    none = F.array().cast("array<bigint>")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value"), (F.coalesce(sketch, none) if k == "description" else none).alias("sketch")) for k, v in values.items()]))
    x = x.withColumn("at", F.unix_micros(F.col("first_seen_at").cast("timestamp")))
    return x.select("g", "source", "id", "at", each.alias("e")).select("g", "e.field", "source", "e.value", "id", "at", "e.sketch").where("value is not null")
