"""Reading level of each document.

Graded texts (a table, or the corpus's own texts graded by the Flesch-Kincaid
formula) fix each known word's acquisition grade: the grades by which, averaged
over the words of a text and together with the length of its sentences, the
grades of all graded texts are met best. A document's level is the average of
the quantile function of its known words' grades, calibrated by that fit, plus
what its sentences add; the cuts between bands lie where levels are rarest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .shingles import word_array

# Frequent English function words, by whose share English is told.
ENGLISH = "the a an of to and in is you for that with will be are your we at on or not they as it this can have by from which who when what if but do".split()
#: Years of schooling between which the cuts to band 2 and to band 3 are sought, and where they lie if there are no texts.
CUTS = ((5.0, 8.0, 7.0), (10.5, 13.5, 12.0))
#: Steps of the histogram of levels, in years, and the levels that it covers.
STEP, LOWEST, HIGHEST = 0.1, -10.0, 60.0
#: Pieces of at most so many words (headings, parts of addresses) are no sentences.
FRAGMENT_WORDS = 3
#: Numbers of a vector that are summed together.
PIECE = 1 << 14
#: Words whose grades are solved for together, and texts that are laid out at once for that.
BLOCK, TEXTS = 1022, 2048


def pieces(text: Column) -> Column:
    """The words of each line, list item, block and sentence."""
    t = F.when(text.contains("<"), F.regexp_replace(text, r"(?i)</?(p|li|h\d|ul|ol|div|br|tr|td)\b[^>]*>", "\n")).otherwise(text)
    return F.transform(F.split(t, r"(?<=[.!?])\s+|\n+"), word_array)


def formula_grade(words: Column, n_sentences: Column) -> Column:
    """Flesch-Kincaid grade; vowel groups are syllables, but for an e at the end other than after l."""
    joined = F.array_join(words, " ")
    n = F.size(words)
    syllables = F.regexp_count(joined, F.lit("[aeiouy]+")) - F.regexp_count(joined, F.lit("[aeiouy][^aeiouy ]*[^aeiouyl ]e(?= |$)"))
    return 0.39 * n / F.greatest(n_sentences, F.lit(1)) + 11.8 * F.greatest(syllables, n) / n - 15.59


def _flat(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    off = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]] if len(words) else np.empty(0, np.int64)
    return flat, off - off[0]


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values)])
    return c[off[1:]] - c[off[:-1]]


def english_words(documents: DataFrame, doc_id: str, text: str, least_words: int, least_share: float, grade: str | None = None) -> DataFrame:
    """``id, words, length, formula``: English texts with enough words, the mean length of their sentences and their grade.

    Words outside sentences (fragments) count for the number of words only. The
    grade is that of the column ``grade``, or the formula's.
    """
    told = [F.col(grade).cast("double").alias("_told")] if grade else []
    kept = ["id", *(["_told"] if grade else [])]
    once = lambda *c: F.inline(F.array(F.struct(*c)))  # noqa: E731  # evaluated once, filters stay above
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), *told, once(pieces(F.col(text)).alias("p")))
    docs = docs.select(*kept, once(F.filter("p", lambda w: F.size(w) > FRAGMENT_WORDS).alias("s"), F.aggregate("p", F.lit(0), lambda n, w: n + F.size(w)).alias("n_all")))
    docs = docs.where((F.col("n_all") >= least_words) & (F.size("s") > 0)).select(*kept, F.size("s").alias("n"), once(F.flatten("s").alias("w")))
    docs = docs.where(F.size(F.filter("w", lambda w: w.isin(*ENGLISH))) >= least_share * F.size("w"))
    told = F.col("_told") if grade else formula_grade(F.col("w"), F.col("n"))
    return docs.select("id", F.transform("w", lambda w: F.xxhash64(w)).alias("words"), (F.size("w") / F.col("n")).alias("length"), told.alias("formula"))


def known_words(words: DataFrame, least_count: int, least_share: float) -> np.ndarray:
    """Sorted hashes of the words that occur ``least_count`` times and make up ``least_share`` of all: at most 1 / least_share, however large the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n = np.unique(_flat(b.column("words"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n.astype(np.int64))], ["w", "n"])

    counts = materialise(words.select("words").mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.where((F.col("n") >= least_count) & (F.col("n") >= least_share * total)).select("w").toPandas()
    return np.sort(known["w"].to_numpy(np.int64))


def _coded(vocabulary: np.ndarray):
    """Texts as places of their known words in the vocabulary."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = _flat(b.column("words"))
            at = np.minimum(np.searchsorted(vocabulary, flat), max(0, len(vocabulary) - 1))
            known = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(_sums(known.astype(np.int64), off))])
            codes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[known].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([codes, b.column("length"), b.column("formula")], ["codes", "length", "formula"])

    return code


def _gram(chosen: np.ndarray | None, n: int):
    """Products of the columns of chosen words (all if none), sentence length and constant, and of each with the grades: upper triangles in a row."""
    place = np.full(n + 2, -1)
    place[np.arange(n + 2) if chosen is None else chosen] = np.arange(n + 2 if chosen is None else len(chosen))
    k = int(place.max()) + 1

    def products(at: np.ndarray, off: np.ndarray, b: pa.RecordBatch) -> list[np.ndarray]:
        total, back = np.zeros((k, k)), np.zeros(k)
        lengths, grades = b.column("length").to_numpy(), b.column("formula").to_numpy()
        for first in range(0, len(off) - 1, TEXTS):
            o = off[first : first + TEXTS + 1]
            held = np.diff(o)
            used = held > 0
            col, share = place[at[o[0] : o[-1]]], np.repeat(1.0 / np.maximum(held, 1), held)
            text = np.repeat(np.arange(len(held)), held)
            ok = col >= 0
            x = np.bincount(text[ok] * k + col[ok], weights=share[ok], minlength=len(held) * k).reshape(len(held), k)
            x[:, place[n]] = np.where(used, lengths[first : first + TEXTS] / 10, 0.0)
            x[:, place[n + 1]] = used
            total += x.T @ x
            back += np.where(used, grades[first : first + TEXTS], 0.0) @ x
        return [total[np.triu_indices(k)], back]

    return products, k


def _totals(coded: DataFrame, n: int, vectors: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], list[np.ndarray]], k: int) -> np.ndarray:
    """Sums over all texts of k vectors of n numbers, added up in pieces: no worker and not the driver gathers more than a piece of each partition."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = np.zeros(k * n)
        for b in batches:
            out += np.concatenate(vectors(*_flat(b.column("codes")), b))
        rows = np.arange(-(-k * n // PIECE), dtype=np.int32)
        where = np.full(len(rows), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(where), pa.array([out[r * PIECE : (r + 1) * PIECE].tobytes() for r in rows], pa.binary())], ["piece", "part", "v"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in pdf.sort_values("part")["v"]], axis=0)
        return pdf.head(1)[["piece"]].assign(v=[total.tobytes()])

    total = np.zeros(k * n)
    for r in coded.mapInArrow(part, "piece int, part int, v binary").groupBy("piece").applyInPandas(summed, "piece int, v binary").collect():
        total[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.v)
    return total.reshape(k, n)


def fitted_grades(coded: DataFrame, n: int, rounds: int = 60, ridge: float = 1e-3, close: float = 1e-10) -> tuple[np.ndarray, float, float]:
    """The grade of each of n known words, what a word more in each sentence adds, and a constant: least squares over all graded texts.

    ``coded``: codes, length, formula. Conjugate gradients on the normal
    equations, each round one pass over the texts, until the squared residual has
    fallen to ``close`` of its first; texts without any known word don't count.
    The equations of the ``BLOCK`` words with the largest diagonals, of sentence
    length and of the constant are summed whole in one pass and solved directly:
    where these are all, that is the fit, else each round begins from it.
    """
    if not n:
        return np.zeros(n), 0.39, 0.0

    def laid(at: np.ndarray, off: np.ndarray, b: pa.RecordBatch):
        held = np.diff(off)
        used = held > 0
        return np.repeat(np.arange(len(held)), held), 1.0 / np.maximum(held, 1), used.astype(float), np.where(used, b.column("length").to_numpy() / 10, 0.0)

    def first(at: np.ndarray, off: np.ndarray, b: pa.RecordBatch) -> list[np.ndarray]:
        text, share, one, length = laid(at, off, b)
        y = np.where(one > 0, b.column("formula").to_numpy(), 0.0)
        back = np.concatenate([np.bincount(at, weights=(y * share)[text], minlength=n), [y @ length, y.sum()]])
        return [back, np.concatenate([np.bincount(at, weights=(share**2)[text], minlength=n), [length @ length, one.sum()]])]

    def normal(v: np.ndarray) -> np.ndarray:
        def there_and_back(at: np.ndarray, off: np.ndarray, b: pa.RecordBatch) -> list[np.ndarray]:
            text, share, one, length = laid(at, off, b)
            r = _sums(v[at], off) * share + v[n] * length + v[n + 1] * one
            return [np.concatenate([np.bincount(at, weights=(r * share)[text], minlength=n), [r @ length, r @ one]])]

        return _totals(coded, n + 2, there_and_back, 1)[0]

    def together(chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        products, k = _gram(chosen, n)
        sums = _totals(coded, k * (k + 1) // 2 + k, lambda at, off, b: [np.concatenate(products(at, off, b))], 1)[0]
        upper = np.zeros((k, k))
        upper[np.triu_indices(k)] = sums[:-k]
        return upper + np.triu(upper, 1).T, sums[-k:]

    if n <= BLOCK:
        whole, back = together(None)
        if not whole[n + 1, n + 1]:
            return np.zeros(n), 0.39, 0.0
        v = np.linalg.solve(whole + ridge * np.eye(n + 2), back)
        return v[:n], v[n] / 10, v[n + 1]
    back, diagonal = _totals(coded, n + 2, first, 2)
    if not diagonal[n + 1]:
        return np.zeros(n), 0.39, 0.0
    chosen = np.sort(np.concatenate([np.argsort(-diagonal[:n], kind="stable")[:BLOCK], [n, n + 1]]))
    inverse = np.linalg.inv(together(chosen)[0] + ridge * np.eye(len(chosen)))

    def nearly(r: np.ndarray) -> np.ndarray:
        z = r / (diagonal + ridge)
        z[chosen] = inverse @ r[chosen]
        return z

    v, r = np.zeros(n + 2), back
    z = nearly(r)
    p, rz = z, r @ z
    enough = close * rz
    for _ in range(rounds):
        if rz <= enough:
            break
        q = normal(p) + ridge * p
        a = rz / (p @ q)
        v, r = v + a * p, r - a * q
        z = nearly(r)
        before, rz = rz, r @ z
        p = z + rz / before * p
    return v[:n], v[n] / 10, v[n + 1]


def rarest(levels: np.ndarray, between: tuple[float, float, float]) -> float:
    """The middle of the rarest stretch of levels, weighed over half a year, between two levels; the default if there are too few texts."""
    low, high, default = between
    bins = LOWEST + STEP * (np.arange(len(levels)) + 0.5)
    inside = (bins >= low) & (bins <= high)
    if not levels[bins < low].sum() or not levels[bins > high].sum():
        return default
    width = int(round(0.5 / STEP))
    smooth = np.convolve(levels.astype(float), np.hanning(2 * width + 1), mode="same")[inside]
    best = np.flatnonzero(smooth <= smooth.min() + 1e-9)
    return float(bins[inside][best[len(best) // 2]])


def reading_levels(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 40, english_share: float = 0.12, least_count: int = 5, least_share: float = 2e-6,
    graded: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, band, grade``: English documents with at least ``least_words`` words.

    - ``grade`` is the level in years of schooling; band 1, 2 or 3 by cuts that lie
      where levels are rarest between the years of CUTS.
    - ``graded``: text, grade; without it the corpus's texts are graded by formula.
      The words' grades are fitted on all graded texts; known words, levels and
      cuts come from all documents.
    - Null, short, empty and non-English texts give no row; where no word is known
      or nothing is graded, sentence length alone tells. Repeated rows give a row each.
    """
    words = materialise(english_words(documents, doc_id, text, least_words, english_share), "words")
    vocabulary = known_words(words, least_count, least_share)
    if graded is None:
        lessons = words
    else:
        lessons = english_words(graded.select(F.xxhash64("text").alias("id"), "text", "grade").where("grade is not null"), "id", "text", 1, 0.0, "grade")
    coded = materialise(lessons.select("words", "length", "formula").mapInArrow(_coded(vocabulary), "codes array<int>, length double, formula double"), "coded")
    grades, per_word, constant = fitted_grades(coded, len(vocabulary))
    unknown = len(vocabulary) == 0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = _flat(b.column("words"))
            if unknown:
                g, known = np.zeros(len(flat)), np.zeros(len(flat), bool)
            else:
                at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
                known, g = vocabulary[at] == flat, grades[at]
            mean = _sums(np.where(known, g, 0.0), off) / np.maximum(_sums(known.astype(np.int64), off), 1)
            level = mean + per_word * b.column("length").to_numpy() + constant
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(level)], ["id", "level"])

    weighed = materialise(words.select("id", "words", "length").mapInArrow(weigh, "id bigint, level double"), "weighed")
    steps = int((HIGHEST - LOWEST) / STEP)
    at = F.least(F.greatest(F.floor((F.col("level") - LOWEST) / STEP), F.lit(0)), F.lit(steps - 1))
    levels = np.zeros(steps, np.int64)
    for r in weighed.groupBy(at.cast("int").alias("k")).agg(F.count("*").alias("n")).collect():  # a row per step
        levels[r.k] = r.n
    cuts = [rarest(levels, between) for between in CUTS]
    band = F.when(F.col("level") >= cuts[1], 3).when(F.col("level") >= cuts[0], 2).otherwise(1)
    return weighed.select(F.col("id").alias("doc_id"), band.cast("int").alias("band"), F.round("level", 4).alias("grade"))
