import time

from pyspark import InheritableThread

from sievework.sources.sinks import Snapshots
from sievework.streaming import control
from sievework.streaming.ingest import first_seen_stream, latest_events, replay, upsert_stream, windowed_counts

SCHEMA = "seq bigint, k string, h string, at timestamp"


def test_upserts_and_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select 1L seq, 'a' k, 'x' h, timestamp'2026-01-01 00:05:00' at union all select 2L, 'a', 'y', timestamp'2026-01-01 01:05:00' union all select 3L, 'b', 'z', timestamp'2026-01-01 01:10:00'").write.parquet(src)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    q = upsert_stream(stream(), f"file://{tmp_path}/t", ["k"], "h", ["at"], ["seq"], str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.sql("select 4L seq, 'b' k, 'w' h, timestamp'2026-01-02 00:00:00' at").write.mode("append").parquet(src)
    q = upsert_stream(stream(), f"file://{tmp_path}/t", ["k"], "h", ["at"], ["seq"], str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.k: (r.h, r.at.day) for r in Snapshots(spark, f"file://{tmp_path}/t").read().collect()}
    assert got == {"a": ("y", 1), "b": ("w", 1)}
    assert sorted(r.n for r in windowed_counts(spark.read.parquet(src), "at", "k").collect()) == [1, 1, 1, 1]
    q = first_seen_stream(stream(), ["k"], "at").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2
    assert [r.seq for r in replay(spark.read.parquet(src), "seq", 1).collect()] == [2, 3, 4]
    assert [r.seq for r in latest_events(spark.read.parquet(src), "seq", 2).collect()] == [4, 3]


def test_resumable_runs_and_progress(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda a, b: spark.range(a, b).write.mode("append").parquet(src)
    listener = control.Progress()
    spark.streams.addListener(listener)
    writer = lambda: spark.readStream.schema("id bigint").parquet(src).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
    rows(0, 5)
    control.run_available(writer())
    assert spark.read.parquet(out).count() == 5
    rows(5, 7)
    control.run_available(writer(), timeout=60)  # begins where the last run ended
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(7))
    query = control.run_every(writer(), "1 hour")
    query.stop()
    deadline = time.time() + 20
    while sum(r[2] for r in listener.reports) < 7 and time.time() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert sum(r[2] for r in listener.reports) == 7


def test_stages_and_cancelling(spark):
    seen, ran = [], []
    stages = [(n, lambda n=n: ran.append(n)) for n in "abc"]
    assert control.in_stages(stages, stopped=lambda: len(ran) == 2, report=lambda *x: seen.append(x)) == ["a", "b"] and seen == [("a", 1, 3), ("b", 2, 3)]
    assert control.in_stages(stages) == ["a", "b", "c"]
    failed = []

    def nap(batches):
        for b in batches:
            time.sleep(0.3)
            yield b

    def slow():
        with control.cancellable(spark, "slow"):
            try:
                spark.range(0, 1000, 1, 1000).mapInPandas(nap, "id bigint").count()
            except Exception as e:
                failed.append(e)

    t = InheritableThread(target=slow)
    began = time.time()
    t.start()
    while t.is_alive() and time.time() - began < 40:
        time.sleep(0.5)
        control.cancel(spark, "slow")
    t.join(60)
    assert failed and time.time() - began < 40
