"""Near-duplicate records with small edits: a self join on Jaccard similarity.

Vertical partitioning: hashes put n-grams into groups, and those that two sets
share within a group make a fragment (see :func:`shingles.fragment_keys`). Sets
that hold the same fragment have a partial overlap; these are counted separately
and summed per pair, and pairs whose sum no similar pair falls short of are
candidates (see :func:`shingles.partial_overlap`). Their overlap is then
bounded by the sum of the least counts over ``RANGES`` ranges of the order, and
at last counted exactly, each of ``SEGMENTS`` segments on its own, and summed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .shingles import PER_SET, SLOT_BITS, TURNS, UNIT, fragment_keys, information, mixed, own_gain, packed, partial_overlap, set_identity, shares, shingle_sets, slots, told_by, unpacked, word_hashes

#: Ranges of the global order over which overlaps are bounded, and segments in which they are counted.
RANGES, SEGMENTS = 64, 4
#: A fragment held by more sets is joined in blocks of SALTS x SALTS instead of in one task.
HOT, SALTS = 16384, 16
#: The bit of an info that tells whether the set is asked for.
ASKED = 12
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the map of nodes whose n-grams are wanted.
NODE_BITS = 22
#: Fragments that a worker gathers before it hands them on, and pairs of which it gathers the partial overlaps.
GATHER, BATCH = 1 << 22, 1 << 22


def wanted_bits(nodes: DataFrame) -> np.ndarray:
    """A bitmap over the low bits of nodes, of fixed size: 128 pieces come to the driver, whatever the number of nodes."""

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << (NODE_BITS - 7), bool)
        bits[pdf["bit"].to_numpy() & ((1 << (NODE_BITS - 7)) - 1)] = True
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    low = nodes.select(F.col("node").bitwiseAND((1 << NODE_BITS) - 1).cast("int").alias("bit")).distinct()
    got = low.select(F.shiftright("bit", NODE_BITS - 7).alias("piece"), "bit").groupBy("piece").applyInPandas(piece, "piece int, bits binary").collect()
    out = np.zeros((128, 1 << (NODE_BITS - 7)), bool)
    for r in got:
        out[r.piece] = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return out.ravel()


def set_table(words: DataFrame, width: int) -> DataFrame:
    """``id, x, y, n, parts``: identity (128 bits), size and counts per range of each row's set; rows without any n-gram are left out."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h = shingle_sets(b.column("words"), width)
            x, y, size = set_identity(doc, h, b.num_rows)
            cell = np.bincount(doc * RANGES + (h >> np.uint64(34)).astype(np.int64), minlength=b.num_rows * RANGES).reshape(b.num_rows, RANGES)
            parts, ok = np.minimum(cell, 255).astype(np.uint8), np.flatnonzero(size)
            columns = [b.column("id").take(pa.array(ok)), pa.array(x[ok].astype(np.int64)), pa.array(y[ok].astype(np.int64)), pa.array(size[ok].astype(np.int32)), pa.array([parts[k].tobytes() for k in ok], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "y", "n", "parts"])

    return words.select("id", "words").mapInArrow(sets, "id bigint, x bigint, y bigint, n int, parts binary")


def segment_table(words: DataFrame, width: int, wanted: np.ndarray | None = None) -> DataFrame:
    """``node, f, grams``: the n-grams of each set by segment of the global order; wanted, if given, is a bitmap of nodes."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if wanted is not None:
                b = b.filter(pa.array(wanted[b.column("id").to_numpy() & ((1 << NODE_BITS) - 1)]))
            doc, h = shingle_sets(b.column("words"), width)
            cell = doc * SEGMENTS + (h >> np.uint64(38)).astype(np.int64)
            at, count = np.unique(cell, return_counts=True)
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array((h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at // SEGMENTS)), pa.array((at % SEGMENTS).astype(np.int8)), grams], ["node", "f", "grams"])

    return words.select("id", "words").mapInArrow(segments, "node bigint, f tinyint, grams array<int>")


def shingle_information(words: DataFrame, width: int, sets: int) -> np.ndarray:
    """The information of each slot of n-grams (see :func:`shingles.information`), counted over all sets.

    A partition sends one table of fixed size in 64 pieces; pieces are summed by
    groups of 256 partitions, then at last, so no task gathers more.
    """
    piece = (1 << SLOT_BITS) // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            total += np.bincount(slots(shingle_sets(b.column("words"), width)[1]), minlength=1 << SLOT_BITS)
        rows = np.arange(64, dtype=np.int32)
        group = np.full(64, TaskContext.get().partitionId() // 256, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(group), pa.array([total[k * piece : (k + 1) * piece].astype(np.uint32).tobytes() for k in rows], pa.binary())], ["piece", "part", "n"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.uint32) for x in pdf["n"]], axis=0, dtype=np.int64)
        return pdf.head(1).assign(n=[np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()])

    tables = words.select("words").mapInArrow(count, "piece int, part int, n binary")
    for keys in (["piece", "part"], ["piece"]):
        tables = tables.groupBy(*keys).applyInPandas(summed, "piece int, part int, n binary")
    total = np.zeros((64, piece), np.int64)
    for r in tables.collect():  # 64 rows of fixed size
        total[r.piece] = np.frombuffer(r.n, np.uint32)
    return information(total.ravel(), sets)


def key_table(words: DataFrame, width: int, weight: np.ndarray, sets: int, similarity: float) -> DataFrame:
    """``key, node, info``: the fragments of each set as rows, for sets that are kept."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h = shingle_sets(b.column("words"), width)
            d, k, info = fragment_keys(doc, h, np.bincount(doc, minlength=b.num_rows), weight, sets, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), b.column("id").take(pa.array(d)), pa.array(info)], ["key", "node", "info"])

    return words.select("id", "words").mapInArrow(keys, "key bigint, node bigint, info bigint")


def overlap_of(similarity: float):
    """A function of two columns of infos: what the fragment in common counts (see :func:`shingles.partial_overlap`)."""

    @F.pandas_udf("int")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(partial_overlap(a.to_numpy(), b.to_numpy(), similarity).astype(np.int32))

    return overlap


def _packed_keys(width: int, weight: np.ndarray, sets: int, similarity: float, buckets: int, turn: int):
    """Rows of a bucket of keys each: sorted keys as packed differences, nodes and infos (with a bit for sets asked for), all of a worker's batches together.

    Keys are cut to as many bits as leave few fragments equal by chance.
    """
    cut = np.uint64(40 - min(40, max(32, (sets * PER_SET).bit_length() + 6)))

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        key, node, info = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        key, node, info = key[order], node[order], info[order]
        bucket = (key >> np.uint64(8)) * np.uint64(buckets) >> np.uint64(32)
        key >>= cut
        at = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
        rows = []
        for k in np.flatnonzero(np.diff(at)):
            part, nodes = key[at[k] : at[k + 1]], node[at[k] : at[k + 1]]
            base = nodes.min()
            steps = np.concatenate([part[:1] * np.uint64(0), np.diff(part)])
            rows.append((int(k), int(part[0]), packed(steps), int(base), packed((nodes - base).astype(np.uint64)), packed(info[at[k] : at[k + 1]])))
        names = ["bucket", "first", "steps", "base", "nodes", "infos"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            doc, h = shingle_sets(b.column("words"), width)
            d, k, info = fragment_keys(doc, h, np.bincount(doc, minlength=b.num_rows), weight, sets, similarity, turn)
            asked = b.column("asked").to_numpy(zero_copy_only=False).astype(np.int64)[d]
            held.append((k, b.column("id").to_numpy()[d], info | asked << ASKED))
            n += len(d)
            if n >= GATHER:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return keys


OVERLAPS = "bucket int, base bigint, steps binary, beside binary, overlaps binary, key bigint, node bigint, info bigint"


def _packed_overlaps(a: np.ndarray, b: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket of pairs each, pairs in order."""
    low = min(int(a.min()), int(b.min())) if len(a) else 0
    bucket = mixed(mixed(a.view(np.uint64) * MIX + b.view(np.uint64)) * MIX) % np.uint64(buckets)
    order = np.lexsort((b, a, bucket))
    a, b, n, bucket = a[order], b[order], n[order], bucket[order]
    at = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
    rows = []
    for k in np.flatnonzero(np.diff(at)):
        x, y = a[at[k] : at[k + 1]] - low, b[at[k] : at[k + 1]] - low
        rows.append((int(k), low, packed(np.diff(x, prepend=0).astype(np.uint64)), packed(y.astype(np.uint64)), packed(n[at[k] : at[k + 1]].astype(np.uint64)), None, None, None))
    if rows:
        yield overlap_rows(*zip(*rows))


def overlap_rows(*columns) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    size = next(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in OVERLAPS.split(", ")])


def _packed_pairs(buckets: int):
    """``a, b, n`` as packed rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _packed_overlaps(*(b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("a", "b", "n")), buckets)

    return pack


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` of the pairs whose partial overlaps, summed over all rows of their bucket, come to UNIT."""
    a, b, n = [], [], []
    for batch in batches:
        marks = batch.column("mark")
        if pc.any(marks).as_py():  # some fragment is in very many sets
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([True])], ["a", "b", "mark"])
        batch = batch.filter(pc.invert(marks))
        for base, steps, beside, overlaps in zip(*(batch.column(c).to_pylist() for c in ("base", "steps", "beside", "overlaps"))):
            a.append(np.cumsum(unpacked(steps)).astype(np.int64) + base)
            b.append(unpacked(beside).astype(np.int64) + base)
            n.append(unpacked(overlaps).astype(np.int64))
    if a:
        a, b, n = (np.concatenate(x) for x in (a, b, n))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        ok = first[np.add.reduceat(n, first) >= UNIT]
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(np.zeros(len(ok), bool))], ["a", "b", "mark"])


def _matched(similarity: float, split_hot: bool, buckets: int):
    """Partial overlaps of a bucket's pairs as packed rows; of a fragment in more than HOT sets a mark (no bucket, no key), or with ``split_hot`` its sets (key, node, info)."""

    def pairs(first: np.ndarray, many: np.ndarray, info: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of code, with what they count: each position with the ``many`` ones from ``first`` on."""
        told, pair, count, held = told_by(info, similarity), [], [], 0
        at, k = np.flatnonzero(many), 0
        while len(at):
            i, j = at, first[at] + k
            gain = own_gain(tuple(x[i] for x in told[:3]), tuple(x[j] for x in told[:3]), similarity)
            ok = np.flatnonzero((gain >= 0) & (code[i] != code[j]))
            i, j = i[ok], j[ok]
            n = shares(gain[ok], tuple(x[i] for x in told), tuple(x[j] for x in told), similarity)
            ok = np.flatnonzero(n)
            i, j = code[i[ok]], code[j[ok]]
            pair.append(np.minimum(i, j) << 32 | np.maximum(i, j))
            count.append(n[ok])
            held, k = held + len(ok), k + 1
            at = at[many[at] > k]
            if held >= BATCH or not len(at):
                once, where = np.unique(np.concatenate(pair), return_inverse=True)
                yield once, np.minimum(np.bincount(where, weights=np.concatenate(count), minlength=len(once)), UNIT).astype(np.int32)
                pair, count, held = [], [], 0

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, infos = [], [], []
        for b in batches:
            for first, steps, base, node, info in zip(*(b.column(c).to_pylist() for c in ("first", "steps", "base", "nodes", "infos"))):
                keys.append(np.cumsum(unpacked(steps)) + np.uint64(first))
                nodes.append(unpacked(node).astype(np.int64) + base)
                infos.append(unpacked(info).astype(np.int64))
        if not keys:
            return
        key, node, info = np.concatenate(keys), np.concatenate(nodes), np.concatenate(infos)
        del keys, nodes, infos
        asked = info >> ASKED & 1
        order = np.argsort(key << np.uint64(1) | (1 - asked).astype(np.uint64))  # sets asked for come first
        key, node, info, asked = key[order], node[order], info[order], asked[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size, first_asked = np.diff(np.concatenate([starts, [len(key)]])), np.add.reduceat(asked, starts)
        use = (size > 1) & (first_asked > 0)  # fragments of one set only, or of none asked for, match nothing
        many = np.repeat(use, size)
        key, node, info, size, first_asked = key[many], node[many], info[many], size[use], first_asked[use]
        starts = np.cumsum(size) - size
        ids, code = np.unique(node, return_inverse=True)
        first = np.repeat(starts, size)
        before = np.minimum(np.arange(len(key)) - first, np.repeat(first_asked, size))
        hot = np.repeat(size > HOT, size)
        if hot.any():
            yield overlap_rows(*[None] * 5, key[hot].astype(np.int64), node[hot], info[hot]) if split_hot else overlap_rows(*[None] * 7, [0])
        for once, total in pairs(first, np.where(hot, 0, before), info, code):
            yield from _packed_overlaps(ids[once >> 32], ids[once & 0xFFFFFFFF], total, buckets)

    return match


def least_overlap(a: Column, b: Column, similarity: float) -> Column:
    """The overlap that sets of these sizes need for the similarity."""
    return F.ceil(similarity / (1 + similarity) * (a + b) - F.lit(1e-9)).cast("int")


def bounded(pairs: DataFrame, sets_a: DataFrame, sets_b: DataFrame, similarity: float) -> DataFrame:
    """``a, b, need, total`` of the pairs that sizes and counts per range (node, n, parts) don't rule out."""

    @F.pandas_udf("int")
    def most_overlap(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, RANGES) for s in (x, y))
        full = ((p == 255) & (q == 255)).any(axis=1)  # counts above 255 aren't known
        return pd.Series(np.where(full, 1 << 30, np.minimum(p, q).sum(axis=1, dtype=np.int64)).astype(np.int32))

    pairs = pairs.join(sets_a.toDF("a", "n_a", "p_a"), "a").join(sets_b.toDF("b", "n_b", "p_b"), "b")
    pairs = pairs.withColumn("need", least_overlap(F.col("n_a"), F.col("n_b"), similarity)).where(F.least("n_a", "n_b") >= F.col("need"))
    return pairs.where(most_overlap("p_a", "p_b") >= F.col("need")).select("a", "b", "need", (F.col("n_a") + F.col("n_b")).alias("total"))


def verified(near: DataFrame, segments_a: DataFrame, segments_b: DataFrame) -> DataFrame:
    """``a, b, similarity`` of the pairs (a, b, need, total) that are similar enough: overlaps are counted segment by segment and summed."""
    both = near.join(segments_a.toDF("a", "f", "g_a"), "a").join(segments_b.toDF("b", "f", "g_b"), ["b", "f"])
    summed = both.select("a", "b", "need", "total", F.size(F.array_intersect("g_a", "g_b")).alias("o")).groupBy("a", "b", "need", "total").agg(F.sum("o").alias("o"))
    return summed.where("o >= need").select("a", "b", (F.col("o") / (F.col("total") - F.col("o"))).alias("similarity"))


class NearDuplicates:
    """Sets of word shingles of texts, and the pairs of them that are similar.

    ``words``: id, words (see :func:`word_hashes`); ids are unique. Rows with equal
    sets (by 128 bits) are one node, named by their smallest id, so a group of
    copies of any size costs one node. ``queries``, a condition on id, asks only
    for pairs of which at least one row fulfils it.
    """

    def __init__(self, words: DataFrame, similarity: float, width: int = 5, queries: Column | None = None):
        self.similarity, self.width = similarity, width
        words = materialise(words, "words")
        self.sets = materialise(set_table(words, width), "sets")
        once = self.sets.groupBy("x", "y").agg(F.min("id").alias("node"), F.count("*").alias("k")).where("k > 1").select("x", "y", "node")
        #: id, node of the rows whose set a smaller id has
        self.copies = materialise(self.sets.select("id", "x", "y").join(once, ["x", "y"]).where("id != node").select("id", "node"), "copies")
        asked = F.lit(True) if queries is None else queries
        unique = words.join(self.copies.select("id"), "id", "left_anti").withColumn("asked", asked)
        if queries is not None:  # a set that was asked for by a copy only
            by_copy = self.copies.where(asked).select(F.col("node").alias("id")).distinct().withColumn("by_copy", F.lit(True))
            unique = unique.join(by_copy, "id", "left").withColumn("asked", F.col("asked") | F.col("by_copy").isNotNull()).drop("by_copy")
        #: id, words, asked of one row of each set
        self.unique = unique
        self.n_sets = self.sets.count() - self.copies.count()

    @property
    def members(self) -> DataFrame:
        """``id, node`` of all rows that have a set."""
        return self.sets.select("id").join(self.copies, "id", "left").select("id", F.coalesce("node", "id").alias("node"))

    def _summed(self, weight: np.ndarray, turn: int, split_hot: bool) -> DataFrame:
        spark = self.unique.sparkSession
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n_sets * PER_SET // GATHER))
        keys = self.unique.mapInArrow(_packed_keys(self.width, weight, self.n_sets, self.similarity, buckets, turn), "bucket int, first bigint, steps binary, base bigint, nodes binary, infos binary")
        found = keys.repartitionById(buckets, "bucket").mapInArrow(_matched(self.similarity, split_hot, buckets), OVERLAPS)
        if split_hot:
            found = materialise(found, "overlaps", clear=True)
            held = found.where("bucket is null").select("key", "node", "info", F.pmod(F.hash("node"), F.lit(SALTS)).alias("own"))
            every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            left = held.select("key", F.col("node").alias("a"), F.col("info").alias("ia"), F.col("own").alias("l"), every.alias("r"))
            right = held.select("key", F.col("node").alias("b"), F.col("info").alias("ib"), every.alias("l"), F.col("own").alias("r"))
            asked = F.col("ia").bitwiseOR(F.col("ib")).bitwiseAND(1 << ASKED) > 0
            hits = left.join(right, ["key", "l", "r"]).where((F.col("a") < F.col("b")) & asked).select("a", "b", overlap_of(self.similarity)("ia", "ib").alias("n")).where("n > 0")
            found = found.where("bucket is not null").union(hits.groupBy("a", "b").agg(F.sum("n").alias("n")).mapInArrow(_packed_pairs(buckets), OVERLAPS))
        # marks go to bucket 0 and stay marks
        sent = found.select(F.coalesce("bucket", F.lit(0)).alias("bucket"), "base", "steps", "beside", "overlaps", F.col("bucket").isNull().alias("mark"))
        return sent.repartitionById(buckets, "bucket").mapInArrow(_enough, "a bigint, b bigint, mark boolean")

    def candidates(self) -> DataFrame:
        """``a, b``: nodes whose partial overlaps are enough for a similar pair, a < b; one share of the groups after the other."""
        weight = shingle_information(self.unique, self.width, self.n_sets)
        turns = []
        for turn in range(TURNS):
            found = materialise(self._summed(weight, turn, False), "candidates", clear=True)
            if found.where("mark").limit(1).count():
                found = materialise(self._summed(weight, turn, True), "candidates", clear=True)
            turns.append(found.select("a", "b"))
        return functools.reduce(DataFrame.union, turns).repartition("a").distinct()

    def node_pairs(self) -> DataFrame:
        """``a, b, similarity`` of the different sets that are similar enough."""
        sets = self.sets.select("id", "n", "parts")
        near = materialise(bounded(self.candidates(), sets, sets, self.similarity), "near")
        segments = segment_table(self.unique, self.width, wanted_bits(near.select(F.explode(F.array("a", "b")).alias("node"))))
        return verified(near, segments, segments)

    def pairs(self) -> DataFrame:
        """``id_a, id_b, similarity``: all pairs of similar rows, copies included, id_a < id_b."""
        m = materialise(self.members, "members")
        nodes = materialise(self.node_pairs(), "pairs")
        l, r = m.toDF("l", "a"), m.toDF("r", "b")
        across = nodes.join(l, "a").join(r, "b").select("l", "r", "similarity")
        copies = l.join(m.toDF("r", "a"), "a").where("l < r").select("l", "r", F.lit(1.0).alias("similarity"))
        return across.union(copies).select(F.least("l", "r").alias("id_a"), F.greatest("l", "r").alias("id_b"), "similarity")

    def groups(self) -> DataFrame:
        """``id, group_id, n_links``: each row's class and the number of rows that it is similar to (classes follow links of links)."""
        m = materialise(self.members, "members")
        nodes = materialise(self.node_pairs().select("a", "b"), "pairs")
        held = m.groupBy("node").agg(F.count("*").alias("rows"))
        both = nodes.union(nodes.select("b", "a")).toDF("node", "beside")
        links = both.join(held.toDF("beside", "rows"), "beside").groupBy("node").agg(F.sum("rows").alias("links"))
        label = components(nodes)
        out = m.join(held, "node").join(links, "node", "left").join(label, "node", "left")
        return out.select("id", F.coalesce("label", "node").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of the component of each node that has an edge (a, b).

    Each round gives nodes the least label beside them and then that label's own
    label, so the number of rounds is about the logarithm of the longest chain.
    """
    both = materialise(edges.union(edges.select("b", "a")).toDF("node", "beside").distinct(), "edges")
    label = materialise(both.groupBy("node").agg(F.least(F.min("beside"), F.col("node")).alias("label")), "labels")
    while True:
        least = both.join(label.toDF("beside", "other"), "beside").groupBy("node").agg(F.min("other").alias("other"))
        nearer = label.join(least, "node").select("node", F.least("label", "other").alias("label"), F.col("label").alias("old"))
        jumped = nearer.join(label.toDF("label", "up"), "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old")
        told = materialise(jumped, "labels")
        if not told.where("label != old").limit(1).count():
            return told.select("node", "label")
        label = told.select("node", "label")


def near_duplicates(rows: DataFrame, id_col: str, texts: list[str], similarity: float = 0.8, width: int = 5, least_words: int = 0) -> NearDuplicates:
    """Near-duplicates of rows by their sets of word runs.

    - Words of ``texts`` in that order; only rows whose last text has at least
      ``least_words`` words take part. Null texts have no words.
    - Rows with fewer than ``width`` words in all have no run and are in no pair.
    - Ids must be unique; rows with a null id are left out; an empty table gives an
      empty result.
    """
    return NearDuplicates(word_hashes(rows.where(F.col(id_col).isNotNull()), id_col, texts, least_words), similarity, width)


def near_duplicate_pairs(rows: DataFrame, id_col: str, texts: list[str], similarity: float = 0.8, width: int = 5, least_words: int = 0) -> DataFrame:
    """``id_a, id_b, similarity``: pairs of rows whose sets of word runs are similar (see :func:`near_duplicates`)."""
    return near_duplicates(rows, id_col, texts, similarity, width, least_words).pairs()


def near_duplicate_groups(rows: DataFrame, id_col: str, texts: list[str], similarity: float = 0.8, width: int = 5, least_words: int = 0) -> DataFrame:
    """``id, group_id, n_links``: the class of each row and the number of its links (see :func:`near_duplicates`)."""
    return near_duplicates(rows, id_col, texts, similarity, width, least_words).groups()
