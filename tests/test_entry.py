from __future__ import annotations

import __spark_entry__ as e


def test_registered():
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p1_found", "p2_found", "marker_stats"} <= set(queries)
