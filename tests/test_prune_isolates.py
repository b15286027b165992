"""F13 by firms: the rows of its SQL template, without a row a pair of firms or an offer."""

import re
from pathlib import Path

import pytest
from rippleflow.plans import catalog, relational
from rippleflow.sources.adapter import Network

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_no_pair_is_kept(spark):
    n = Network(spark, SF)
    got = catalog.queries()["F13_prune_isolates"](spark, SF)
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in n.sql(relational.SQL["F13_prune_isolates"]).collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    keys = [k.split(",") for k in re.findall(r"Aggregate \[([^\]]*)\]", plan)]
    assert keys and all(len(k) == 1 for k in keys)
