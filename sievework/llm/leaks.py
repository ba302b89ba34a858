"""Evaluation texts leaking into training text.

The normalised n-grams of the evaluation items are a small hash set that goes to
every worker; each training text is scanned once, window by window; a hit is
verified word by word against the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .shingles import mixed, word_array, word_hashes

_M1 = np.uint64(0x9E3779B97F4A7C15)
_INVISIBLE = "​‌‍⁠﻿­"
_TOKEN = re.compile(rf"<[^>]*>|&[#A-Za-z0-9]{{1,10}};|([^\W_](?:[{_INVISIBLE}]*[^\W_])*)")


def windows(flat: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words; shorter than ``flat`` by n - 1."""
    m = max(0, len(flat) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = mixed(h * _M1 + flat[k : k + m])
    return h


class Items:
    """Windows of all items by length; at most ``limit`` words in all, else an error."""

    def __init__(self, items: DataFrame, id_col: str, text: str, run: int, limit: int):
        rows = word_hashes(items.where(F.col(id_col).isNotNull()), id_col, [text], 1)
        total = rows.agg(F.sum(F.size("words"))).first()[0] or 0
        if total > limit:
            raise ValueError(f"the evaluation items have {total} words, more than the {limit} that may be sent to every worker")
        self.words = {r.id: np.array(r.words, np.int64).view(np.uint64) for r in rows.collect()}
        by: dict[int, list[tuple[int, int, int]]] = {}
        for item, w in self.words.items():
            n = min(run, len(w))
            by.setdefault(n, []).extend((int(h), item, at) for at, h in enumerate(windows(w, n)))
        self.by = {}
        for n, found in by.items():
            found.sort()
            self.by[n] = (np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64))

    def hits(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``row, item, at, length`` of every verified window of the batch."""
        off = words.offsets.to_numpy().astype(np.int64)
        flat = words.values.to_numpy(zero_copy_only=False).view(np.uint64)[off[0] : off[-1]] if len(words) else np.empty(0, np.uint64)
        off = off - off[0]
        out = [[], [], [], []]
        for n, (hashes, items, places) in self.by.items():
            h = windows(flat, n)
            # a quarter-million-bit filter first: almost no window is an item's
            bits = np.zeros(1 << 18, bool)
            bits[hashes & np.uint64((1 << 18) - 1)] = True
            at = np.flatnonzero(bits[h & np.uint64((1 << 18) - 1)])
            row = np.searchsorted(off, at, side="right") - 1
            inside = at + n <= off[row + 1]
            at, row = at[inside], row[inside]
            first, last = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            for k in np.flatnonzero(last > first):
                for j in range(first[k], last[k]):
                    if np.array_equal(flat[at[k] : at[k] + n], self.words[int(items[j])][places[j] : places[j] + n]):
                        for o, v in zip(out, (row[k], items[j], at[k] - off[row[k]], n)):
                            o.append(v)
        return tuple(np.array(o, np.int64) for o in out)


def leak_windows(documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", run: int = 12, limit: int = 2_000_000) -> DataFrame:
    """``doc_id, item_id, at, n``: every window of ``run`` words (or whole shorter item) of an item in a document.

    - Words as in :func:`word_array`. Null or wordless texts hit nothing; items
      without words are no items. Null ids are left out; repeated rows hit alike.
    - Whole texts are scanned, in Arrow batches; windows never cross documents.
    """
    held = Items(items, item_id, text, run, limit)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, item, at, n = held.hits(b.column("words"))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(item), pa.array(at), pa.array(n)], ["doc_id", "item_id", "at", "n"])

    docs = word_hashes(documents.where(F.col(doc_id).isNotNull()), doc_id, [text], 1)
    return docs.mapInArrow(scan, "doc_id bigint, item_id bigint, at bigint, n bigint")


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = 12) -> DataFrame:
    """``doc_id, item_id``: each document with each item of which it holds a run."""
    return leak_windows(documents, items, doc_id, item_id, text, run).select("doc_id", "item_id").distinct()


def without_spans(text: str, spans: list[tuple[int, int]], mark: str = " ") -> str:
    """The text without the words from start to end (exclusive) of each span, whatever stands between them."""
    at = [m.span(1) for m in _TOKEN.finditer(text) if m.group(1)]
    out, last, done = [], 0, -1
    for a, b in sorted(spans):
        if max(a, done) < b <= len(at):
            if a > done:  # else it goes on where the last one ended
                out += [text[last : at[a][0]], mark]
            last, done = at[b - 1][1], b
    return "".join([*out, text[last:]])


def decontaminated(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = 12, drop_share: float = 0.5) -> DataFrame:
    """``doc_id, n_words, n_leaked, action, text`` of each document that holds a run of an item.

    Documents of which at least ``drop_share`` of the words leaked are to be
    dropped (action ``drop``, null text), of others the leaked words are cut out
    (action ``cut``).
    """
    hit = materialise(leak_windows(documents, items, doc_id, item_id, text, run), "hits")
    spans = hit.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("to")))).alias("spans"))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.size(word_array(F.col(text))).alias("n_words")).join(spans, "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gone, cleaned = [], []
            for t, s in zip(pdf["text"], pdf["spans"], strict=True):
                pairs = [(x["at"], x["to"]) for x in s]
                gone.append(len({k for a, b in pairs for k in range(a, b)}))
                cleaned.append(without_spans(t, pairs))
            drop = np.array(gone) >= drop_share * pdf["n_words"].to_numpy()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": pdf["n_words"], "n_leaked": gone, "action": np.where(drop, "drop", "cut"), "text": [None if d else c for d, c in zip(drop, cleaned)]})

    return docs.mapInPandas(cut, "doc_id bigint, n_words int, n_leaked int, action string, text string")
