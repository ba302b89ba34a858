"""Mixing sources to target weights.

Texts are grouped by membership pattern, the set of sources that hold them. A
min-cost flow routes each pattern's tokens to the sources' quotas, the k-th use
of a text costing k - 1. Texts are then laid on a tape in seeded order, once for
each use, and each source takes a stretch of the tape.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

#: Parts of the seeded order within which texts are summed up exactly.
BUCKETS = 4096


def token_counts(texts: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``texts`` with ``tokens``, by a byte-level BPE whose ranks lie in the file ``vocabulary`` and whose ``pattern`` cuts texts into pieces.

    The file is read here and sent to the workers, which need not have it.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    sent = texts.sparkSession.sparkContext.broadcast(data)  # one vocabulary file, of fixed size

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pdf.drop(columns="text").assign(tokens=[len(enc.encode_ordinary(t)) for t in pdf["text"]])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInPandas(count, f"{kept}, tokens bigint")


class Flow:
    """Min-cost flow by successive shortest paths on a small graph with integer capacities."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = []  # to, capacity, cost
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.edges))
            self.edges.append([y, c, w])
        return len(self.edges) - 2

    def run(self, s: int, t: int) -> int:
        total, n = 0, len(self.out)
        potential = [0] * n
        while True:
            dist, by = [float("inf")] * n, [-1] * n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > dist[v]:
                    continue
                for e in self.out[v]:
                    to, c, w = self.edges[e]
                    nd = d + w + potential[v] - potential[to]
                    if c > 0 and nd < dist[to]:
                        dist[to], by[to] = nd, e
                        heapq.heappush(heap, (nd, to))
            if by[t] < 0:
                return total
            for v in range(n):
                if dist[v] < float("inf"):
                    potential[v] += dist[v]
            push, v = None, t
            while v != s:
                c = self.edges[by[v]][1]
                push = c if push is None else min(push, c)
                v = self.edges[by[v] ^ 1][0]
            v = t
            while v != s:
                self.edges[by[v]][1] -= push
                self.edges[by[v] ^ 1][1] += push
                v = self.edges[by[v] ^ 1][0]
            total += push


def plan(patterns: list[tuple[tuple[str, ...], int]], targets: list[tuple[str, float, int]], total: int | None) -> tuple[int, dict[tuple[int, str], int]]:
    """The mixture's size and the tokens that each pattern gives each source.

    Without ``total`` it is the largest size at which every source that has any
    text reaches its share; sources without text are left unfilled.
    """
    repeats = {s: max(0, r) for s, _, r in targets}
    names = [s for s, share, r in targets if share > 0 and r > 0 and any(s in p and n for p, n in patterns)]
    share = {s: x for s, x, _ in targets}

    def route(size: int) -> tuple[bool, dict[tuple[int, str], int]]:
        source = {s: 2 + len(patterns) + k for k, s in enumerate(names)}
        flow = Flow(2 + len(patterns) + len(names))
        arcs = {}
        for k, (p, n) in enumerate(patterns):
            held = [s for s in p if s in source]
            for use in range(max((repeats[s] for s in held), default=0)):
                flow.add(0, 2 + k, n, use)
            for s in held:
                arcs[k, s] = flow.add(2 + k, source[s], n * repeats[s], 0)
        want = {s: int(size * share[s]) for s in names}
        for s in names:
            flow.add(source[s], 1, want[s], 0)
        got = flow.run(0, 1)
        return got == sum(want.values()), {a: flow.edges[e ^ 1][1] for a, e in arcs.items() if flow.edges[e ^ 1][1]}

    if total is not None:
        return total, route(total)[1]
    low, high = 0, 1
    if names:
        high = int(sum(n * max([repeats[s] for s in p if s in share], default=0) for p, n in patterns) / min(share[s] for s in names)) + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if route(middle)[0] else (low, middle)
    return low, route(low)[1]


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str, pattern: str, seed: int = 17, total: int | None = None, id_col: str = "doc_id", most_patterns: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The mixture and the shares that it reaches.

    ``doc_id, source, tokens, copies``: the documents used, for which source and
    how often; ``source, target_share, supply_tokens, mixed_tokens,
    reached_share``: a row per target.

    - Equal texts are one text, held by all its sources and used for a source at
      most its max_repeats times; the smallest id of the source stands for it.
    - Documents of sources without a target aren't used; null texts, texts
      without tokens and null sources aren't either. A target without documents
      is reported with 0, and the shares of the others stand as they are.
    - The order of texts depends on the seed and the text alone.
    """
    spark = documents.sparkSession
    goal = [(r.source, float(r.target_share), int(r.max_repeats)) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").orderBy("source").collect()]  # a row per source
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), "source", "text").where("text != ''").where(F.col("source").isin(*[s for s, _, _ in goal]))
    docs = docs.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(seed)).alias("h2"), "text")
    counted = materialise(token_counts(docs, vocabulary, pattern), "counted")
    per_source = counted.groupBy("h2", "h1", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = per_source.groupBy("h2", "h1").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.max("tokens").alias("tokens")).where("tokens > 0")
    texts = materialise(texts.withColumn("bucket", F.shiftrightunsigned("h2", 64 - BUCKETS.bit_length() + 1)), "texts")
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).orderBy("pattern").limit(most_patterns + 1).collect()
    if len(sums) > most_patterns:
        raise ValueError(f"the sources overlap in more than {most_patterns} ways")
    patterns = [(tuple(r.pattern), r.n) for r in sums]
    size, flows = plan(patterns, goal, total)
    stretches, at = [], {}
    for (k, s), n in sorted(flows.items()):
        start = at.get(k, 0)
        stretches.append((list(patterns[k][0]), patterns[k][1], s, start, start + n))
        at[k] = start + n
    parts = spark.createDataFrame(stretches, "pattern array<string>, tape bigint, source string, start bigint, stop bigint")
    # place of each text in the seeded order of its pattern: of its bucket, then in it
    place = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n")).select("pattern", "bucket", (F.sum("n").over(W.partitionBy("pattern").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = F.sum("tokens").over(W.partitionBy("pattern", "bucket").orderBy("h2", "h1").rowsBetween(W.unboundedPreceding, -1))
    laid = texts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(place, ["pattern", "bucket"]).withColumn("c", F.col("base") + F.col("inside"))
    before = lambda x: F.floor((F.col(x) - 1 - F.col("c")) / F.col("tape"))
    used = laid.join(parts, "pattern").withColumn("copies", before("stop") - before("start")).where("copies > 0")
    mixed = used.join(per_source.select("h2", "h1", "source", "doc_id"), ["h2", "h1", "source"]).select("doc_id", "source", "tokens", F.col("copies").cast("int").alias("copies"))
    mixed = materialise(mixed, "mixture")
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    supply = counted.groupBy("source").agg(F.sum("tokens").alias("supply_tokens"))
    all_ = reached.agg(F.sum("mixed_tokens").alias("all_tokens"))
    zero = F.lit(0).cast("bigint")
    shares = targets.where("source is not null").select("source", "target_share", "max_repeats").join(supply, "source", "left").join(reached, "source", "left").crossJoin(F.broadcast(all_))  # all_ is one row
    return mixed, shares.select(
        "source", "target_share", "max_repeats", F.coalesce("supply_tokens", zero).alias("supply_tokens"), F.coalesce("mixed_tokens", zero).alias("mixed_tokens"),
        F.round(F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"),
    )
