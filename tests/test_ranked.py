"""Chunks of run records, and p-values, against plain restatements."""

import math
import os

import pytest

from rippleflow.functions import statistics
from rippleflow.sources import sinks

SCHEMA = "task_id long, error string, x double"


def chunks(spark, path, kind):
    if not os.path.isdir(f"{path}/{kind}") or not any(n.startswith("tasks=") for n in os.listdir(f"{path}/{kind}")):
        return {}
    out = {}
    for r in spark.read.json(f"{path}/{kind}").collect():
        out.setdefault(r.tasks, []).append(r.task_id)
    return {k: sorted(v) for k, v in out.items()}


def test_chunks_are_named_by_their_tasks_and_written_once(spark, tmp_path):
    path = str(tmp_path)
    rows = [(i, "broken" if i in (3, 14) else None, i / 2) for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for _ in range(2):  # a job that is started anew
        sinks.write_chunks(df, path, 10)
        assert chunks(spark, path, "runs") == {"0-9": [i for i in range(10) if i != 3], "10-19": [i for i in range(10, 20) if i != 14], "20-29": list(range(20, 25))}
        assert chunks(spark, path, "errors") == {"0-9": [3], "10-19": [14]}
    sinks.write_chunks(spark.createDataFrame([(i, None, 0.0) for i in range(10)], SCHEMA), path, 10)  # the failed task runs at last
    assert chunks(spark, path, "runs")["0-9"] == list(range(10)) and chunks(spark, path, "runs")["20-29"] == list(range(20, 25))
    assert chunks(spark, path, "errors") == {"10-19": [14]}
    sinks.write_chunks(spark.createDataFrame([(10, "all", 0.0)], SCHEMA), path, 10)
    assert "10-19" in chunks(spark, path, "errors")


@pytest.mark.parametrize(("r", "n"), [(0.3, 12), (-0.55, 30), (0.05, 200)])
def test_p_values_by_numeric_integration(r, n):
    df, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    steps = 200000
    h = t / steps
    inner = sum(c * (1 + ((i + 0.5) * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(steps)) * h
    assert statistics.correlation_p_value(r, n) == pytest.approx(1 - 2 * inner, abs=1e-6)
