import numpy as np
import pytest
from helpers import documents, empty, odd_rows

from rippleflow.llm import sharding


def test_matrix_has_exact_margins_and_the_right_mean():
    cells = np.stack([sharding.communication_matrix([30, 50, 20], [40, 60], s) for s in range(2000)])
    assert (cells.sum(axis=2) == [30, 50, 20]).all() and (cells.sum(axis=1) == [40, 60]).all()
    assert abs(cells[:, 1, 0].mean() - 50 * 0.4) < 0.3
    var = 50 * 0.4 * 0.6 * (100 - 50) / 99
    assert abs(cells[:, 1, 0].var() / var - 1) < 0.15
    with pytest.raises(ValueError):
        sharding.communication_matrix([1], [2], 0)


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, n = 3_000_000_000, 2_000_000_000, 1_000_000
    got = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(400)])
    assert abs(got.mean() - n * 0.6) < 5 * np.sqrt(n * 0.24 / 400) and 0.7 < got.var() / (n * 0.24) < 1.4


def test_shards_are_exact_and_gapless(spark):
    out = sharding.digest(documents(spark, [(i, f"text {i % 7}", None, None, None) for i in range(1000)])).collect()
    assert sorted(r.doc_id for r in out) == list(range(1000))
    for s in range(24):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (41, 42)
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


def test_pieces_of_a_shard_join_without_gaps(spark):
    out = sharding.shard(documents(spark, [(i, str(i), None, None, None) for i in range(500)]), shards=3, rows_per_block=20).collect()
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (166, 167)
    first = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(first, range(500))[0, 1]) < 0.15


def test_same_result_for_any_partitioning(spark):
    docs = documents(spark, [(i, str(i), None, None, None) for i in range(300)])
    one, two = (sorted(map(tuple, sharding.digest(d).select("doc_id", "shard", "slot").collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two


def test_odd_rows_and_clashing_names(spark):
    rows = odd_rows()
    out = sharding.digest(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sorted(r.size for r in out) == sorted(8 + len((t or "").encode()) for _, t, *_ in rows)
    clash = documents(spark, rows).withColumnRenamed("lang", "shard").withColumnRenamed("source", "__h")
    got = sharding.shard(clash, 4)
    assert got.columns == [*clash.columns, "_shard", "slot"] and got.count() == len(rows)
    assert sharding.digest(empty(spark)).count() == 0


def test_the_query_tells_where_the_operator_puts_whole_documents(spark):
    docs = documents(spark, [(i, f"text {i % 7}", None, "s", None) for i in range(200)])
    of = lambda df: sorted(map(tuple, df.select("doc_id", "shard", "slot").collect()))
    assert of(sharding.digest(docs)) == of(sharding.shard(docs, 24))
    assert sharding.digest(docs.withColumnRenamed("lang", "shard")).where("shard is null").count() == 0
