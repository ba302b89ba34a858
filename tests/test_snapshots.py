import datetime as dt
import random

from sievework.operators.snapshots import snapshot_changes

SCHEMA = "source string, external_id string, snapshot_no int, content_hash string, last_seen_at timestamp_ntz, key string, b int"
T = dt.datetime(2026, 1, 1)


def changes(spark, rows, **kw):
    df = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in snapshot_changes(df, **kw).select("part", "key", "snapshot", "kind").collect())


def brute(rows):
    cur = {}
    for s, k, n, h, t in rows:
        if s is None or k is None or not k.strip() or n is None:
            continue
        h = (h or "").strip().lower() or None
        key = (s, k.strip().upper(), n)
        rank = (t is not None, t or T, h is not None, 0)
        if key not in cur or rank > cur[key][0]:
            cur[key] = (rank, h)
    given = {}
    for s, _, n, *_ in rows:
        if s is not None and n is not None:
            given.setdefault(s, set()).add(n)
    out = []
    for s, ns in given.items():
        ns, said = sorted(ns), {}
        for d, n in enumerate(ns):
            here = {k for (x, k, m) in cur if x == s and m == n}
            before = {k for (x, k, m) in cur if x == s and d and m == ns[d - 1]}
            for k in here | before:
                if k not in here:
                    out.append((s, k, n, "removed"))
                    said.pop(k, None)
                    continue
                h = cur[s, k, n][1]
                if k not in before:
                    said.pop(k, None)
                    if d:
                        out.append((s, k, n, "added"))
                elif h and said.get(k) and h != said[k]:
                    out.append((s, k, n, "changed"))
                if h:
                    said[k] = h
    return sorted(out)


def test_random_deliveries_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for n in (1, 2, 4, 5):
        for k in range(60):
            if r.random() < 0.8:
                for _ in range(r.choice([1, 1, 2])):
                    h = r.choice(["aa", "AA ", "bb", None, ""]) if k % 3 else "cc"
                    rows.append((r.choice("xy") if k % 9 == 0 else "x", f" k{k:03} " if r.random() < 0.5 else f"K{k:03}", n, h, T + dt.timedelta(seconds=len(rows))))
    assert changes(spark, rows, chunk=4) == brute(rows)


def test_edges(spark):
    assert changes(spark, []) == []
    rows = [(None, "a", 1, "h", T), ("s", None, 1, "h", T), ("s", " ", 2, "h", T), ("s", "a", 1, None, None), ("s", "a", 2, "h", None), ("s", "b", 2, "x" * 100_000, T)]
    assert changes(spark, rows) == [("s", "A", 2, "added")] or changes(spark, rows) == [("s", "B", 2, "added")]


def test_one_key_repeated(spark):
    rows = [("s", "a", 1, "h", T)] * 500 + [("s", "a", 2, "i", T)] * 500
    assert changes(spark, rows) == [("s", "A", 2, "changed")]
