import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_queries_run_and_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from sievework.plans import lifecycle, reference, training

    assert entry.entry(spark).columns == ["source", "external_id", "snapshot_no", "change_kind"]
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    for module in (training, reference, lifecycle):
        for name, f in module.QUERIES.items():
            df = f(spark, SF)
            cols = sorted(df.columns)
            rows = df.select(*[f"`{c}`" for c in cols]).collect()
            if name in module.ORACLES:
                want = con.execute(f"select {', '.join(f'"{c}"' for c in cols)} from ({module.ORACLES[name]}) q").fetchall()
                show = lambda x: sorted(repr(tuple(list(v) if isinstance(v, list) else v for v in r)) for r in x)
                assert show(rows) == show(want), name
