"""A world's lists in arrays: any number of capabilities, in slices, the same cascades."""

import pytest

from rippleflow.plans import campaign, simulate
from rippleflow.sources.adapter import Network


@pytest.mark.parametrize("big", [0, 1 << 40])
def test_lists_of_a_network(spark, monkeypatch, big):
    monkeypatch.setattr(simulate, "SLICE", 3)
    can = [(big + 1, 7), (big + 1, 5), (big + 1, 7), (big + 3, 7), (big + 2, 6)]
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    w = simulate.load_world(
        t([(big + f, 1, 1.0, 1) for f in (1, 2, 3)], "firm_id long, size long, k double, cap long"),
        t([(big + 2, big + 3, 9, 4)], "src long, dst long, product long, amount long"),
        t([(big + 2, big + 3, 5)], "src long, dst long, max_trials long"),
        t(can, "firm_id long, product long"),
        t([], "product long, alt long, score double"),
    )
    assert dict(w.portfolio) == {big + 1: [5, 7], big + 2: [6, 9], big + 3: [7]}
    assert dict(w.offers) == {5: [big + 1], 6: [big + 2], 7: [big + 1, big + 3], 9: [big + 2]}
    assert w.portfolio.get(99, ()) == () and w.offers.get(8, ()) == ()


def test_more_capabilities_than_a_set_would_bear(spark, monkeypatch):
    """The limit is on arrays: 20 M rows, which failed, are some 160 MB twice."""
    assert simulate.MOST_CAPABILITIES >= 60 * 600_000
    n = Network(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(simulate, "LARGE", 10)  # few tasks
    runs = simulate.simulate(campaign.configs(n), campaign._world(n))
    assert runs.rdd.getNumPartitions() <= max(1, spark.sparkContext.defaultParallelism // 4) and runs.where("violations > 0 OR error IS NOT NULL").count() == 0


def test_tasks_need_not_import_the_repository(spark):
    from pyspark import cloudpickle

    n = Network(spark, "/root/testdata/sf0.001")
    simulate.simulate(campaign.configs(n), simulate.World(size={1: 1}))
    assert b"removed_edges" in cloudpickle.dumps(simulate.Run)  # its code, not its name only
