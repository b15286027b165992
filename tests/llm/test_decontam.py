import random

import numpy as np
from helpers import documents, empty, odd_rows, prose

from rippleflow.llm import decontam


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row), row.index(min(row))


def test_edit_distance_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        p, t = (bytes(rng.choices(b"abc", k=rng.randint(*k))) for k in ((0, 12), (0, 30)))
        assert decontam.edit_distance(p, t) == brute_distance(p, t)


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(t)), rng.random()
        if kind < 0.4:
            t[at] = "q"
        elif kind < 0.7:
            del t[at]
        else:
            t.insert(at, "z")
    return "".join(t)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, prose(1000 + i, 15 + i)) for i in range(12)]
    rows = []
    for k in range(60):
        text = prose(k, 60)
        if k % 2:
            i, item = rng.choice(items)
            at = rng.randrange(len(text))
            text = text[:at] + " " + edited(rng, item, rng.randint(0, len(item) // 10)) + " " + text[at:]
        rows.append((k, text, None, None, None))
    want = {(d, i): brute_distance(t.encode(), text.encode())[0] for d, text, *_ in rows for i, t in items}
    want = {k: v for k, v in want.items() if v <= len(dict(items)[k[1]].encode()) // 10}
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.digest(documents(spark, rows), benchmark(spark, items)).collect()}
    assert got == want and len(want) >= 25


def found_in(items, text):
    raw = np.frombuffer(text, np.uint8)
    return decontam.matches(raw, np.array([0, len(raw)]), items)[0]


def test_recall_at_the_most_edits():
    """Items of 8 to 400 bytes with all the edits that they may have: as many as brute force finds."""
    rng, tried, hit = random.Random(7), 0, 0
    for n in range(240):
        item = prose(n, 90)[: rng.choice([8, 10, 13, 20, 22, 31, 40, 63, 64, 65, 80, 110, 150, 240, 400])]
        text = (prose(5000 + n, 20) + edited(rng, item, len(item) // 10) + prose(9000 + n, 20)).encode()
        want = brute_distance(item.encode(), text)
        if want[0] <= len(item.encode()) // 10:
            tried += 1
            got = found_in(decontam.Items([(1, item.encode())], 0.1), text)
            if 0 in got:
                assert got[0][0] == want[0]
                hit += 1
            else:
                assert len(item) >= decontam.SHORT  # the exact search loses nothing
    assert tried >= 220 and hit >= 0.99 * tried


def test_walks_find_what_unrelated_texts_do_not():
    items = decontam.Items([(i, prose(i, 40).encode()) for i in range(30)], 0.1)
    raw = np.frombuffer(" ".join(prose(7000 + i, 60) for i in range(200)).encode(), np.uint8)
    assert len(items.bands) and not items.parts
    assert len(decontam.candidates(raw, np.array([0, len(raw)]), items)) <= 3


def test_short_and_huge_items(spark):
    assert 0 in found_in(decontam.Items([(1, b"abcdefghijklmnopqrst")], 0.1), b"zz abcdefgXijklmnXpqrst zz")
    item = prose(1, 20000)[:100_000]
    rng = random.Random(1)
    rows = [(1, prose(2, 50) + edited(rng, item, 300) + prose(3, 50), None, None, None), (2, prose(4, 20000), None, None, None)]
    got = [tuple(r) for r in decontam.digest(documents(spark, rows), benchmark(spark, [(7, item)])).collect()]
    assert len(got) == 1 and got[0][:2] == (1, 7) and 200 <= got[0][2] <= 300


def test_odd_rows_items_and_names(spark):
    rows = [*odd_rows(), (50, "xx tiny yy", None, None, None), (51, "", None, None, None)]
    items = [(1, None), (2, ""), (None, "abc"), (3, "tiny"), (4, "tiny"), (5, "a" * 60), (5, "a" * 60)]
    clash = documents(spark, rows).withColumnRenamed("lang", "leaks").withColumnRenamed("source", "item_id")
    out = decontam.scan(clash, benchmark(spark, items))
    assert out.count() == len(rows)
    got = {r.doc_id: [x["item"] for x in r.leaks] for r in out.collect()}
    assert got[50] == [3, 4] and got[8] == [5] and got[3] == got[4] == got[51] == []
    assert decontam.digest(empty(spark), benchmark(spark, items)).count() == 0
    assert decontam.digest(documents(spark, rows), benchmark(spark, [])).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = documents(spark, [(i, prose(i, 50), None, None, None) for i in range(20)])
    items = benchmark(spark, [(i, prose(i, 50)[20:150]) for i in range(20)])
    one = sorted(map(tuple, decontam.digest(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 900)
    assert sorted(map(tuple, decontam.digest(docs, items).collect())) == one and len(one) >= 20


def test_many_blocks_and_passes(spark, monkeypatch):
    items = [(i, prose(1000 + i, 20 + i % 5)) for i in range(40)] + [(90, "a short item"), (91, None), (None, "x" * 90)]
    rows = [(k, prose(k, 40) + " " + items[k % 40][1] + " " + prose(k + 7, 20) + " a short item", None, None, None) for k in range(30)] + odd_rows()
    docs = documents(spark, rows)
    want = sorted(map(tuple, decontam.digest(docs, benchmark(spark, items)).collect()), key=str)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 600)
    monkeypatch.setattr(decontam, "AT_ONCE", 4)
    monkeypatch.setattr(decontam, "GROUP_BYTES", 3000)
    assert len(list(decontam._blocks(benchmark(spark, items), "item_id", "text"))) > 4
    found = decontam.scan(docs, benchmark(spark, items))
    assert found.count() == len(rows) and len(want) >= 60
    assert sorted(map(tuple, decontam.digest(docs, benchmark(spark, items)).collect()), key=str) == want
