"""The whole pipeline against its stages' rules on a small corpus with planted cases."""

import random
from pathlib import Path

import pytest
from helpers import documents, odd_rows, prose

from rippleflow.llm import pieces

pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not Path(pieces.DEFAULT_MODEL).exists(), reason="no model file")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    item = prose(4242, 40)
    rows = [(i, prose(i, 80), "en", "s", None) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s", None), (101, rows[1][1] + " tail", "en", "s", None), (102, prose(60, 30) + " " + item + " " + prose(61, 30), "en", "s", None)]
    rows += [(103, prose(62, 60) + " mail a.b@c.de now", "en", "s", None), (104, None, "en", "s", None), (105, "1234 5678", "en", "s", None), (106, prose(63, 50), None, "s", None)]
    documents(spark, rows).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_planted_cases(spark, folder):
    out = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    assert set(out) == {*range(40), 103, 106}
    assert all(r.round_trip for r in out.values()) and all(out[i].text == prose(i, 80) for i in range(40))
    assert out[103].text == prose(62, 60) + " mail <EMAIL> now" and out[106].lang == "en"
    model = pieces.Pieces(pieces.load())
    assert all(model.decode(r.ids) == r.text and len(r.ids) == r.n_pieces for r in out.values())


def test_stages_keep_the_columns_and_take_odd_rows(spark, folder):
    docs = documents(spark, [(i, prose(random.Random(i).randrange(999), 30), "en", "s", None) for i in range(20)] + odd_rows())
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() > 0
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
