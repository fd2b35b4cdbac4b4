from __future__ import annotations

from pathlib import Path

import pytest

from colloquy.llm import queries

SF = Path("/root/testdata/sf0.001")

COLUMNS = {
    "p1_found": {"record_kind": "string", "record_id": "string"},
    "p3_found": {"origin": "string", "record_id": "string", "turn_no": "int", "speaker_no": "int", "n_words": "int"},
    "p4_found": {"profile": "string", "uniq_id": "string", "turn_index": "int"},
    "p7_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p9_found": {"doc_id": "bigint"},
}


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(SF))
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    assert df.count() >= 0
