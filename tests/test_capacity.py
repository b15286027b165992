"""Turning points of capacity where weeks lose alike, against whole numbers."""

import pytest

from rippleflow.plans import catalog
from rippleflow.sources.adapter import Network

NAMES = ["C21_fastest_decline", "C23_capacity_metrics"]


def made(run):
    """Hundredths: the same values over and over, some zeros, at last zeros."""
    return [(7 * run * i * i + 13 * i) % 2903 if i % 5 else 2927 for i in range(1, 40)] + [0] * (run % 3) if run else [3, 0, 0]


@pytest.mark.parametrize("name", NAMES)
def test_equal_losses_go_to_the_first_week(spark, tmp_path, name):
    rows = [(r * 1000 + i, r, f"2024-01-01 00:{i:02d}:00", v / 100) for r in range(60) for i, v in enumerate(made(r))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").selectExpr("event_id", "user_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "value")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["run_id"]: r for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    for run in range(60):
        v = made(run)
        s = [sum(v[: i + 1]) for i in range(len(v))]
        fast = max(range(1, len(v)), key=lambda i: (v[i], -i))
        if name == NAMES[0]:
            share = (s[fast] - s[0]) / (s[-1] - s[0]) if s[-1] > s[0] else 0
            assert (got[run].week, got[run].progress) == (fast, pytest.approx(share, abs=1e-6))
        else:
            half = next(i for i in range(len(v)) if 2 * (s[i] - s[0]) >= s[-1] - s[0])
            assert (got[run].t_fast, got[run].t50c, got[run].t_min, got[run].rises) == (fast, half, s.index(s[-1]), 0)
            assert (got[run].max_weekly, got[run].loss) == (pytest.approx(v[fast] / 1000), pytest.approx((s[-1] - s[0]) / 1000))


def test_types_are_those_of_the_templates(spark):
    from rippleflow.plans import analytics

    for name in NAMES:
        n = Network(spark, "/root/testdata/sf0.001")
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").dtypes == n.sql(analytics.SQL[name]).dtypes


def test_suppliers_are_found_without_links(spark):
    """No aggregate of J7's plan groups by both ends of a link."""
    plan = catalog.queries()["J7_semi_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "Aggregate" in line]
    assert groups and not any("dst" in line for line in groups)
