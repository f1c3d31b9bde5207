"""The driver's contract, and queries against their SQL."""

from collections import Counter

import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def test_contract():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["detect_all_raw", "sanitize_hybrid", "eval_by_doc_strict", "eval_by_doc_relaxed", "similarity_tf", "person_candidates_documents", "sample_compare", "notes_batch", "medicaid_batch", "sample_clients", "session_places", "eval_stored_strict", "attach_stored", "sample_counts"])
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    a, b = e.queries()[name](spark, SF).toArrow(), con.execute(e.oracle_sql()[name]).to_arrow_table()
    assert sorted(a.column_names) == sorted(b.column_names)
    bag = lambda t: Counter(zip(*[t[c].to_pylist() for c in sorted(t.column_names)], strict=True))
    assert bag(a) == bag(b) and a.num_rows
