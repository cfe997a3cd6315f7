"""Problems 6 and 7 over the given tables: how near the containers come to their bound and the sources to their targets."""

from __future__ import annotations

from pathlib import Path

import pytest
from strandloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are absent")


def test_containers_near_their_bound(spark):
    rows = QUERIES["p6_fill"](spark, FOLDER).collect()
    assert len(rows) == 3
    for r in rows:
        assert r["at_least"] <= r["containers"] <= 1.005 * r["at_least"] + 1


def test_shares_near_their_targets(spark):
    rows = QUERIES["p7_shares"](spark, FOLDER).collect()
    assert len(rows) == 7 and abs(sum(r["actual_share"] for r in rows) - 1) < 1e-6
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.01 for r in rows)
