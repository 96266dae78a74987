"""Every query of the text operators, against its SQL where there is one."""

import pytest

from skeinlake.llm import queries as Q

from ..test_queries import duck, rows_of  # noqa: F401

COLUMNS = {
    "p2_found": {"row_no": "bigint", "field": "string", "kind": "string", "value": "string"},
    "p3_found": {"tab": "string", "id": "bigint", "seg": "bigint", "lang": "string"},
    "p6_found": {"session_uuid": "string", "reason": "string"},
    "p7_found": {"row_no": "bigint", "copy_row_no": "bigint"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p10_found": {"doc_id": "bigint", "other_doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, duck, name):  # noqa: F811
    df = Q.QUERIES[name](spark, data)
    assert name not in COLUMNS or dict(df.dtypes) == COLUMNS[name]
    got = df.collect()
    assert got
    if name in Q.SQL:
        found = duck.execute(Q.SQL[name])
        assert rows_of(df.columns, got) == rows_of([c[0] for c in found.description], found.fetchall())
