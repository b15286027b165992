import random

from helpers import documents, empty, odd_rows, prose
from pyspark.sql import functions as F

from rippleflow.llm import langid

VOCAB = {"en": "the of and to in is that was for with this from".split(), "de": "der die und das ist nicht ein zu mit für sich den".split(), "es": "de la que el en los se del las por con para".split()}


def corpus(n=300):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(VOCAB))
        rows.append((i, " ".join(rng.choices(VOCAB[lang], k=rng.randint(8, 40))), lang, "x", None))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in langid.digest(documents(spark, rows)).collect()}
    held = [(i, lang) for i, _, lang, *_ in rows if got[i].held_out]
    assert held and sum(got[i].lang_pred == lang for i, lang in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    import zlib

    rows = corpus()
    spoilt = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s, n) for i, t, lang, s, n in rows]
    a, b = (sorted(map(tuple, langid.digest(documents(spark, r)).collect())) for r in (rows, spoilt))
    assert a == b


def test_sample_is_bounded_and_the_same_for_any_partitioning(spark):
    docs = documents(spark, corpus()).select("doc_id", "text", "lang")
    one, two = (langid.train(d, max_docs=100) for d in (docs.coalesce(1), docs.repartition(5)))
    assert one.langs == two.langs and (one.logp == two.logp).all()


def test_scores_equal_a_plain_sum(spark):
    import numpy as np

    docs = documents(spark, corpus(60)).select("doc_id", "text", "lang")
    model = langid.train(docs)
    texts = ["the der la", "x", "was für"]
    got = model.score(texts)
    for t, row in zip(texts, got):
        grams, ends = langid.ngram_buckets([t])
        want = np.zeros(len(model.langs))
        for g in grams:
            want += model.logp[g[: ends[-1] - 2]].sum(axis=0)
        assert np.allclose(row, want, rtol=1e-4)


def test_odd_rows(spark):
    rows = [*corpus(50), *[(100 + (r[0] or 0), *r[1:]) for r in odd_rows()], (None, "der und die", None, None, None)]
    out = langid.digest(documents(spark, rows))
    assert out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert got[103].lang_pred == got[104].lang_pred == got[105].lang_pred == "und" and got[103].score == 0
    assert langid.digest(empty(spark)).count() == 0
    unlabelled = langid.digest(documents(spark, [(1, "abc", None, None, None)])).first()
    assert unlabelled.lang_pred == "und"


def test_sample_is_exact_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), prose(rng.randrange(9), 8), rng.choice(["en", "fr"]), None, None) for _ in range(200)]
    keyed = documents(spark, rows).withColumn("__h", F.xxhash64("doc_id"))
    order = keyed.orderBy("__h", F.xxhash64("text"), "lang")
    for n in (1, 7, 60, 61, 199, 200, 500):
        got, want = (sorted(tuple(r) for r in x.select("doc_id", "text", "lang").collect()) for x in (langid._least(keyed, "__h", n), order.limit(n)))
        assert got == want
