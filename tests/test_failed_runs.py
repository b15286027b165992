"""A failed run fails the queries that don't show runs' errors."""

import pytest

from rippleflow.plans import campaign, simulate
from rippleflow.sources.adapter import Network

WORLD = simulate.World(size={1: 1, 2: 1}, k={1: 1.0, 2: 1.0}, cap={1: 1, 2: 1}, edges={(1, 2): {7: 1}})


@pytest.mark.parametrize("query", [campaign.struck_firms, campaign.consistency])
@pytest.mark.parametrize("seeds", [[1], None])
def test_failures_are_no_results(spark, monkeypatch, query, seeds):
    runs = spark.createDataFrame([(1, [1], "overlap", 4, 1, 0.1), (2, seeds, "overlap", 4, 1, 0.1)], simulate.CONFIG)
    monkeypatch.setattr(campaign, "configs", lambda n: runs)
    monkeypatch.setattr(campaign, "_world", lambda n: WORLD)
    out = query(Network(spark, "/nowhere"))
    if seeds:
        assert out.collect() and out.columns[-1] != "error"
        return
    with pytest.raises(Exception, match="run 2: "):
        out.collect()
