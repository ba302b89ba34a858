"""What changed between consecutive full snapshots of a keyed table.

Each snapshot is split by key hash, sorted by key and cut into content-defined
chunks: a key whose hash is divisible by ``chunk`` begins a new chunk, so an
inserted or deleted row moves no boundary but its own. Chunks whose digest is
the same in two consecutive deliveries are discarded whole; rows of unmatched
chunks meet under their key, which tells what became of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

#: Unicode white space and invisible characters at the ends of a value.
_ENDS = r"^[\s\p{Z}​﻿]+|[\s\p{Z}​﻿]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def canonical_hash(c: Column) -> Column:
    """Hash texts ignoring case and outer white space; blank says as little as null."""
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def _boundary(row_key: Column, chunk: int) -> Column:
    return F.pmod(F.xxhash64(row_key, F.lit(7)), F.lit(chunk)) == 0


def _stated(rows: DataFrame, part: str, key: str, snapshot: str, seen: str, state: str) -> DataFrame:
    """``part, key, snapshot, v`` of rows that can be compared; v is when it was seen, and its state."""
    state_hash = canonical_hash(F.col(state))
    v = F.struct(F.col(seen).alias("seen"), state_hash.isNotNull().alias("said"), F.xxhash64(state_hash).alias("h"))
    x = rows.select(F.col(part).alias("part"), F.upper(trimmed(F.col(key))).alias("key"), F.col(snapshot).alias("snapshot"), v.alias("v"))
    return x.where("part is not null and key is not null and key != '' and snapshot is not null")


def snapshot_changes(
    rows: DataFrame,
    part: str = "source",
    key: str = "external_id",
    snapshot: str = "snapshot_no",
    seen: str = "last_seen_at",
    state: str = "content_hash",
    chunk: int = 8,
    buckets: int | None = None,
) -> DataFrame:
    """Added, removed and changed keys of every delivery of every part.

    Result: ``part, key, snapshot, kind`` (kind: added, removed, changed).

    - A part's delivery is compared with the delivery before it of that part, be
      their numbers adjacent or not; a part's first delivery gives no row.
    - Keys are trimmed and upper-cased; rows with a null or blank key, part or
      snapshot can't be compared and give no row.
    - Of several rows of a key in a snapshot the one seen last counts.
    - A null or blank state says nothing: the last state stated since the key was
      (re-)added stands. A first statement after nulls is no change.
    - An empty table gives an empty result; further columns are ignored.
    States are compared by 64-bit hashes. Rows move twice, once combined by key and
    snapshot and once to ``buckets`` of keys (four for each shuffle partition); the
    rest happens where they lie, so a part of any size is spread over its buckets.
    """
    spark = rows.sparkSession
    buckets = buckets or max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # deliveries: a row per part and snapshot, whatever the size of the snapshots; written, so that their size is known before they are joined
    given = rows.where(F.col(part).isNotNull() & F.col(snapshot).isNotNull()).groupBy(F.col(part).alias("part"), F.col(snapshot).alias("snapshot")).agg(F.lit(1).alias("one"))
    given = given.withColumn("d", F.row_number().over(W.partitionBy("part").orderBy("snapshot"))).select("part", "snapshot", "d", F.max("d").over(W.partitionBy("part")).alias("last_d"))
    given = materialise(given, "deliveries")
    # repeated rows of a key are combined before they move
    cur = _stated(rows, part, key, snapshot, seen, state).groupBy("part", "key", "snapshot").agg(F.max("v").alias("v"))
    cur = cur.select("part", F.pmod(F.xxhash64("part", "key"), F.lit(buckets)).alias("b"), "key", "snapshot", F.when(F.col("v.said"), F.col("v.h")).alias("h"))
    # the only further shuffle of all rows: every later group and window lies inside (part, b)
    cur = cur.repartition("part", "b")
    cur = cur.join(given, ["part", "snapshot"])
    cur = cur.withColumn("island", F.col("d") - F.row_number().over(W.partitionBy("part", "b", "key").orderBy("d")))
    cur = cur.withColumn("e", F.last("h", ignorenulls=True).over(W.partitionBy("part", "b", "key", "island").orderBy("d")))
    # chunks of a key-sorted delivery begin at keys that the keys themselves choose
    start = F.last(F.when(_boundary(F.col("key"), chunk), F.col("key")), ignorenulls=True)
    cur = cur.withColumn("c", F.coalesce(start.over(W.partitionBy("part", "b", "d").orderBy("key").rowsBetween(W.unboundedPreceding, 0)), F.lit("")))
    of_chunk, over_time = W.partitionBy("part", "b", "c", "d"), W.partitionBy("part", "b", "c").orderBy("d")
    row = F.xxhash64("key", "e", F.col("e").isNull())
    digest = F.struct(F.bit_xor(row).over(of_chunk).alias("x"), F.bit_xor(F.xxhash64(row, F.lit(1))).over(of_chunk).alias("y"))
    cur = cur.withColumn("dg", digest)
    same = lambda k: F.coalesce(F.max("dg").over(over_time.rangeBetween(k, k)) == F.col("dg"), F.lit(False))
    cur = cur.withColumn("as_before", same(-1)).withColumn("as_after", same(1))
    # rows of chunks without an equal one beside them meet under their key and the later delivery
    side = lambda d, new: F.struct(d.alias("d"), F.lit(new).alias("new"), F.col("e"))
    sides = F.array(F.when(~F.col("as_before") & (F.col("d") > 1), side(F.col("d"), True)), F.when(~F.col("as_after") & (F.col("d") < F.col("last_d")), side(F.col("d") + 1, False)))
    met = cur.where("not (as_before and as_after)").select("part", "b", "key", F.explode(F.array_compact(sides)).alias("s"))
    is_new, e = F.col("s.new"), F.col("s.e")
    met = met.groupBy("part", "b", "key", F.col("s.d").alias("d")).agg(
        F.bool_or(is_new).alias("n"), F.bool_or(~is_new).alias("o"), F.max(F.when(is_new, e)).alias("e_new"), F.max(F.when(~is_new, e)).alias("e_old")
    )
    kind = F.when(~F.col("o"), "added").when(~F.col("n"), "removed").when(F.col("e_new") != F.col("e_old"), "changed")
    found = met.withColumn("kind", kind).where("kind is not null")
    return found.join(given.select("part", "d", "snapshot"), ["part", "d"]).select("part", "key", "snapshot", "kind")
