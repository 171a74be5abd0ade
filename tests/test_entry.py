from __future__ import annotations

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50


def test_sql_parses():
    import duckdb

    with duckdb.connect() as db:
        for name, sql in entry.oracle_sql().items():
            assert db.extract_statements(sql), name


def test_core_queries_without_a_library_of_the_others(monkeypatch):
    """If what the training-data operators need can't be imported, the other queries are still there."""
    import sys

    for name in [m for m in sys.modules if m.startswith("sourceweave.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    names = entry.queries()
    assert "corroboration_by_label" in names and not any(n.startswith("op4_") for n in names) and set(entry.oracle_sql()) <= set(names)
