import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import language as g
from quillon.sources import read_table

from odd_docs import ODD


def longest_phrases(text, sample):
    """Phrases of a greedy parse into longest substrings of `sample`, by trying all."""
    has = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, len(sample) + 1)}
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and tuple(text[at : at + n + 1]) in has:
            n += 1
        at += n
        count += 1
    return count


@pytest.mark.parametrize("seed", range(5))
def test_automaton_reads_substrings_only(seed):
    rng = random.Random(seed)
    text = [rng.randrange(3) for _ in range(40)]
    steps = g.suffix_automaton(text)
    assert len(steps) < 2 * len(text)
    for _ in range(500):
        word, state = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], 0
        for c in word:
            state = steps[state].get(c) if state is not None else None
        held = any(text[i : i + len(word)] == word for i in range(len(text)))
        assert (state is not None) == held


def test_phrases():
    rng = random.Random(8)
    samples = {k: np.array([rng.randrange(1, 5) for _ in range(60)], np.uint8) for k in "ab"}
    model = g._automata(samples)
    texts = [np.array([rng.randrange(0, 7) for _ in range(n)], np.uint8) for n in (1, 2, 17, 60, 33)]
    got = g.phrases(texts, model).tolist()
    want = [[longest_phrases(t.tolist(), samples[k].tolist()) for k in "ab"] for t in texts]
    assert got == want


def test_symbols():
    table = g.alphabet()
    assert g.symbols("Ab, c--Ü!", table).tolist() == [1, 2, 0, 3, 0, table[ord("ü")], 0]
    assert (table[[ord(c) for c in "漢я"]] >= 27).all()


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = g.fit(docs.where(learn))
    out = g.identify(docs.where(~learn).drop("source"), model).collect()
    right = sum(r.lang == r.lang_pred for r in out)
    assert len(out) > 200 and right / len(out) > 0.99
    assert all(0.5 <= r.score <= 1 for r in out)


def test_odd_rows(odd):
    model = g.fit(odd)
    assert model.names == ["de", "en", "fr"]
    for r in g.identify(odd, model).collect():
        blank = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == blank and (r.score == 0) == blank
    assert g.identify(odd, model).count() == len(ODD)


def test_nothing_to_learn(odd, none):
    for df in (none, odd.where("lang is null"), odd.withColumn("text", F.lit("12 !"))):
        assert {(r.lang_pred, r.score) for r in g.identify(odd, g.fit(df)).collect()} == {("und", 0.0)}


def test_one_language_and_empty_and_clashing(odd, none):
    model = g.fit(odd.where("lang = 'en'"))
    assert {r.score for r in g.identify(odd, model).collect()} == {0.0, 1.0}
    assert g.identify(none, model).collect() == []
    out = g.identify(odd.withColumns({"Lang_pred": F.lit(1), "score": F.lit(2), "turn": F.lit(3)}), model)
    assert out.columns == [*odd.columns, "turn", "lang_pred", "score"]
