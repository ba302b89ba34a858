"""Session defaults, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that every session of this library should have.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

#: Whether a query's shuffle files are deleted when it ends.
CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 4, memory: str = "4g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    return builder.config("spark.sql.shuffle.partitions", str(cores)).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where the cluster names none (tests, local mode) a local folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialise(df: DataFrame, label: str = "t", clear: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage like a reliable checkpoint (an executor may be lost at
    any time), but computes ``df`` once and keeps it columnar and compressed.
    ``clear`` deletes what was shuffled for it at once, not when the driver next
    collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEARED, "false")
    spark.conf.set(CLEARED, "true" if clear else kept)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEARED, kept)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df``, to be joined by sorting and merging, never sent whole to the driver and to every worker.

    Spark measures a side of a join by files or shuffled bytes: far too little
    where rows are packed there and unpacked, or made many of, before the join.
    """
    return df.hint("shuffle_merge")


def release() -> None:
    """Delete everything that :func:`materialise` wrote in this process."""
    while _made:
        spark, path = _made.pop()
        try:
            sc = spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            pass


atexit.register(release)
