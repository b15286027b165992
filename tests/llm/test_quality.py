import re
from collections import Counter

from helpers import documents, empty, odd_rows, prose

from rippleflow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, marked = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            marked |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_counts_equal_brute_force(spark):
    rows = [*odd_rows(), (20, "a b c d e\na b c d e\n\n x y a b c d e f", "en", None, None), (21, "x " * 40, "en", None, None), (22, "#a $b\x0b%c |", "en", None, None)]
    got = quality.digest(documents(spark, rows)).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted(brute(t) for _, t, *_ in rows)


def test_verdicts(spark):
    clean = [(i, ". ".join(prose(100 * i + k, 20).capitalize() for k in range(8)), "en", None, None) for i in range(30)]
    shout = (100, clean[0][1].upper().replace(" ", "!! "), "en", None, None)
    marks = (101, re.sub(" ", "### ", clean[1][1]), "en", None, None)
    short = (102, "TOO SHORT! TO BE JUDGED BY ITS HISTOGRAM AT ALL, SIR OK", "en", None, None)
    repeat = (103, "one two three four five six " * 20, "en", None, None)
    got = {r.doc_id: r for r in quality.digest(documents(spark, [*clean, shout, marks, short, repeat])).collect()}
    assert all(got[i].kept for i, *_ in clean) and got[102].kept
    assert not got[100].kept and not got[101].kept and not got[100].base_failed
    assert got[103].base_failed and not got[103].kept


def test_texts_without_common_words(spark):
    import random

    rng = random.Random(3)
    invented = lambda n: " ".join("".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))
    clean = [(i, ". ".join(prose(100 * i + k, 20).capitalize() for k in range(8)), "en", None, None) for i in range(30)]
    odd = [(100 + i, ". ".join(invented(20).capitalize() for _ in range(8)), "en", None, None) for i in range(3)]
    unlisted = [(200, odd[0][1], "xx", None, None)]  # too few words for a reference: no word verdict
    unknown = [(300, odd[1][1], None, None, None), (301, clean[0][1], None, None, None)]
    got = {r.doc_id: r for r in quality.digest(documents(spark, [*clean, *odd, *unlisted, *unknown])).collect()}
    assert all(got[i].kept for i, *_ in clean) and got[301].kept and got[200].kept and got[200].word_js is None
    assert not any(got[i].kept or got[i].base_failed for i in (100, 101, 102, 300)) and abs(got[100].word_js - 1) < 1e-6


def test_common_words_are_counted_over_all(spark):
    docs = documents(spark, [(i, "b A a | | c.", "q", None, None) for i in range(300)] + [(900, "z " * 10, "r", None, None)])
    assert quality.common_words(docs, words=2) == {"q": {"a": 2 / 6, "b": 1 / 6}}


def test_distance_is_that_of_jensen_shannon(spark):
    import math

    from pyspark.sql import functions as F

    p, q = [3, 1, 0], [0.2, 0.3, 0.5]
    m = [(a / 4 + b) / 2 for a, b in zip(p, q)]
    part = lambda xs: sum(x * math.log2(x / y) for x, y in zip(xs, m) if x)
    want = math.sqrt((part([a / 4 for a in p]) + part(q)) / 2)
    got = spark.range(1).select(quality._js(F.array(*[F.lit(x).cast("long") for x in p]), q)).first()[0]
    assert abs(got - want) < 1e-12


def test_empty_table_and_extra_columns(spark):
    assert quality.digest(empty(spark)).count() == 0
    clash = documents(spark, odd_rows()).withColumnRenamed("source", "__words").withColumnRenamed("n_chars", "n_words")
    out = quality.quality(clash)
    assert out.columns.count("n_words") == 1 and out.count() == len(odd_rows())


def test_a_few_common_words_do_not_save_a_salad(spark):
    """Invented words with 1 to 10 % common ones among them fail; prose of any length from 60 words stays."""
    import random

    rng = random.Random(8)
    common = [f"{c}{v}" for c in "thwns" for v in "aeio"]
    invented = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 5)))
    text = lambda n, share: " ".join(rng.choices(common, weights=range(20, 0, -1))[0] if rng.random() < share else invented() for _ in range(n))
    clean = [(i, text(n, 0.3), "en", None, None) for i, n in enumerate([60, 90, 130, 200, 300, 500, 900, 1500] * 30)]
    salads = [(1000 + k, " ".join(rng.sample(["ta"] * k + [invented() for _ in range(200 - k)], 200)), "en", None, None) for k in (1, 2, 4, 8, 20)]
    salads += [(2000 + n, text(n, 0.03), "en", None, None) for n in (200, 400, 1000)]
    got = {r.doc_id: r for r in quality.digest(documents(spark, clean + salads)).collect()}
    assert sum(not got[i].kept for i, *_ in clean) == 0
    assert not any(got[i].kept or got[i].base_failed for i, *_ in salads)


def test_no_python_in_the_plan(spark):
    plan = quality.digest(documents(spark, odd_rows()))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
