"""Keyed operators: latest row, first row, upsert with change detection, caches, budgets and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` columns.

    A partial aggregate of structs, so a hot key is reduced before the shuffle.
    Order columns must tell rows of a key apart, else any of the equals is taken
    by its other columns. Null order values come first of all.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    m = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return m.select(*keys, "m.*").select(*rows.columns)


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, ascending, nulls first.

    A partial aggregate, so a hot key is reduced before the shuffle; rows of equal
    order are taken at random.
    """
    rest = [c for c in rows.columns if c not in keys]
    m = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m"))
    return m.select(*keys, "_m.*").select(*rows.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], state: str, keep: list[str]) -> DataFrame:
    """The new snapshot of a table, with ``change``: NEW, CHANGED, UNCHANGED or KEPT.

    Incoming rows replace stored ones but for the columns ``keep``, which stay as
    first stored. Stored rows without an incoming one are kept. Keys must be
    unique on both sides; a null key matches nothing; states compare null-safe.
    """
    s = stored.select(*[F.col(c).alias(f"s_{c}") for c in stored.columns], F.lit(True).alias("s_"))
    i = incoming.select(*stored.columns, F.lit(True).alias("i_"))
    j = i.join(s, [F.col(k) == F.col(f"s_{k}") for k in keys], "full_outer")
    change = F.when(F.col("i_").isNull(), "KEPT").when(F.col("s_").isNull(), "NEW").when(~F.col(state).eqNullSafe(F.col(f"s_{state}")), "CHANGED").otherwise("UNCHANGED")
    cols = [F.when(F.col("i_").isNull() | (F.col("s_").isNotNull() if c in keep else F.lit(False)), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in stored.columns]
    return j.select(*cols, change.alias("change"))


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key isn't stored yet, one per key."""
    return incoming.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)


def cache_split(inputs: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs with ``hit``: whether the cache holds their key. Cache keys need not be unique."""
    held = cache.select(*keys).distinct().withColumn("hit", F.lit(True))
    return inputs.join(held, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def ranked_in_order(rows: DataFrame, order: list[str], parts: int = 0) -> DataFrame:
    """``rows`` with ``pos``, 1 for the first row in order, without gathering them in one task.

    Rows are range-partitioned; each partition's offset is the number of rows in
    the partitions before it. ``order`` must tell all rows apart.
    """
    from ..session import materialise

    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))  # a row per partition
    local = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_r", local).join(sizes.select("_p", F.coalesce("base", F.lit(0)).alias("base")), "_p").withColumn("pos", F.col("base") + F.col("_r")).drop("_p", "_r", "base")


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``pos`` and ``batch_id``: batches of ``size`` rows in order."""
    return ranked_in_order(rows, order).withColumn("batch_id", F.floor((F.col("pos") - 1) / size))


def within_budget(rows: DataFrame, wanted: Column, order: list[str], budget: int) -> DataFrame:
    """``rows`` with ``granted``: whether a wanting row is among the first ``budget`` ones in order."""
    first = rows.where(wanted).orderBy(*order).limit(budget).select(*order).withColumn("granted", F.lit(True))
    return rows.join(first, order, "left").withColumn("granted", F.coalesce("granted", F.lit(False)))


def page_stops(pages: DataFrame, part: str, no: str, signature: str, n_rows: str) -> DataFrame:
    """Pages that a paginated scan would read: up to an empty, repeated or (inclusive) shorter page."""
    w = W.partitionBy(part).orderBy(no)
    stop = (F.col(n_rows) == 0) | F.coalesce(F.col(signature) == F.lag(signature).over(w), F.lit(False))
    short = F.coalesce(F.col(n_rows) < F.lag(n_rows).over(w), F.lit(False))
    x = pages.withColumn("_stop", stop.cast("int")).withColumn("_short", short.cast("int"))
    before = F.coalesce(F.sum("_short").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("_past", F.sum("_stop").over(w) + before).where("_past = 0").drop("_stop", "_short", "_past")
