import random
from pathlib import Path

import pytest
from helpers import documents, empty, odd_rows, prose

from rippleflow.llm import pieces

pytestmark = pytest.mark.skipif(not Path(pieces.DEFAULT_MODEL).exists(), reason="no model file")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.load())


def brute(model, text):
    table = {t.replace("▁", " "): (i, s) for i, (t, s) in enumerate(zip(model.text, model.score)) if i not in model.byte.values() and i > 2}
    text, best = " " + text, [(0.0, [])]
    for end in range(1, len(text) + 1):
        options = [(best[end - n][0] + table[p][1], n, best[end - n][1] + [table[p][0]]) for n in range(min(16, end), 0, -1) if (p := text[end - n : end]) in table]
        if text[end - 1] not in table:
            options.append((best[end - 1][0] + model.fallback, 0, best[end - 1][1] + [model.byte[b] for b in text[end - 1].encode()]))
        top = max(options, key=lambda x: (x[0], x[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


def test_viterbi_equals_brute_force(model):
    rng = random.Random(1)
    texts = [prose(3, 40), "Ça va? \n\n naïve  café", "   a b", "x\r\n;\r y", "数学 и буквы", "".join(rng.choices("abc ABC.\n\t▁é", k=300))]
    for t in texts:
        assert model.encode(t).tolist() == brute(model, t)


def test_ids_are_those_of_sentencepiece(spark):
    spm = pytest.importorskip("sentencepiece")
    own, rng = spm.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL), random.Random(4)
    texts = [prose(3, 400), "the over international understanding", "Ça va? \n\n naïve  café", "   a b  ", "x\r\n;\r y\t", "数学 и буквы 😀", "a" * 3000, "abab" * 300]
    texts += ["".join(rng.choices("abcdeinrst ABC.\n\té", k=300)) for _ in range(50)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.ids for r in pieces.encode(documents(spark, rows), pieces.load()).collect()}
    assert all(got[i] == own.encode(t) for i, t in enumerate(texts))
    model = pieces.made(pieces.load())
    assert all(model.decode(got[i]) == t for i, t in enumerate(texts))


def test_every_match_is_found_by_output_links(model):
    auto, text = model.automaton, " international understanding"
    state, found = 0, set()
    for end, ch in enumerate(text, 1):
        state = auto.step(state, ch)
        at = state if auto.piece[state] >= 0 else auto.out[state]
        while at:
            found.add((end - auto.depth[at], end))
            at = auto.out[at]
    known = {t.replace("▁", " ") for i, t in enumerate(model.text) if i > 258}
    assert found == {(a, b) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if text[a:b] in known}


def test_round_trip(spark, model):
    rows = [*odd_rows(), (60, " leading", None, None, None), (61, "▁▁ a▁", None, None, None), (62, "﻿​\t\x0b", None, None, None)]
    out = pieces.digest(documents(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    assert {r.n_pieces for r in out if r.n_chars == 0} == {0}
    for seed in range(200):
        rng = random.Random(seed)
        text = "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0xD800), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(30))
        assert model.decode(model.encode(text).tolist()) == text


def test_long_words_and_full_tables(model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 3)
    text = prose(9, 300)
    assert model.decode(model.encode(text).tolist()) == text
    assert model.decode(model.encode("a" * 50000).tolist()) == "a" * 50000


def test_empty_table_and_clashing_names(spark):
    data = pieces.load()
    assert pieces.digest(empty(spark)).count() == 0
    clash = documents(spark, odd_rows()).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    out = pieces.decode(pieces.encode(clash, data), data)
    assert sorted(out.columns) == sorted(clash.columns) and out.count() == len(odd_rows())
