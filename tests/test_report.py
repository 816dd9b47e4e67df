import json
import os

import pytest

from quorumcast.catalog.kpi_queries import scores
from quorumcast.operators import report
from quorumcast.sources.event_bridge import EventTables

FOLDER = "/root/testdata/sf0.001"


def test_report_as_json(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    t = EventTables(spark, FOLDER)
    full = report.monthly_report(scores(t), t.submissions(), t.forecasts(), t.measurements(), t.participation(), ["2024-01-20"])
    rows = report.report_as_json(full).collect()
    assert len(rows) == 5 * 2 * 14
    for r in rows:
        days = json.loads(r["daily_scores_json"])
        assert "2024-01-20" not in {d["target_day"] for d in days}
        assert sum(d["is_penalty"] for d in days) == r["n_days_w_penalties"]
        assert len(json.loads(r["daily_ranks_json"])) == r["days_with_submissions"]
        assert set(json.loads(r["league_thresholds_json"])) == {"elite", "challenger", "runner_up"}
        ranks = json.loads(r["rank_distribution_json"])
        assert sum(ranks.values()) == r["days_with_submissions"]
        if r["track"] == "deterministic":
            assert len(json.loads(r["residual_distribution_json"])) == 19 and len(json.loads(r["boxplot_by_power_json"])) == 8
        else:
            assert r["residual_distribution_json"] is None
