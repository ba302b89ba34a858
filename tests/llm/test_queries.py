import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_queries_run(spark):
    from sievework.llm.queries import QUERIES

    columns = {
        "p3_found": ["id_a", "id_b"], "p4_found": ["name_a", "name_b"], "p5_found": ["id", "field_name", "ref_id"], "p6_found": ["group_id", "description_id", "salary_id", "posted_id"],
        "p7_found": ["incoming_id"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "band"],
    }
    for name, f in QUERIES.items():
        df = f(spark, SF)
        assert df.count() >= 0
        assert name not in columns or df.columns == columns[name]
