import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontamination as d
from quillon.llm.words import WordHasher

from odd_docs import ODD, prose

ITEMS = "item_id bigint, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(text, items, window):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(window, len(v))
        passages = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in passages] if n else []
        hit.update(j for i in at for j in range(i, i + n))
        if at and item_id is not None:
            found.add(str(item_id))
    return len(w), tuple(sorted(hit)), tuple(sorted(found))


def longest_matches(text, items, window):
    """(item_id, place, start, length) by extending every pair of equal places."""
    w, best = words(text), {}
    for item_id, item in items:
        v = words(item)
        for p in range(len(v)):
            for q in range(len(w)):
                if v[p] != w[q] or (p and q and v[p - 1] == w[q - 1]):
                    continue
                n = 1
                while p + n < len(v) and q + n < len(w) and v[p + n] == w[q + n]:
                    n += 1
                if n >= min(window, len(v)):
                    key = (item_id if item_id is None else str(item_id), p)
                    best[key] = max(best.get(key, (0, 0)), (n, -q))
    order = sorted(best, key=lambda k: (k[0] is not None, k[0] or "", k[1]))
    return [(*k, -best[k][1], best[k][0]) for k in order]


def check_matches(rows, df, items, benchmark, window=10):
    out = d.find_matches(df, benchmark, window=window).collect()
    got = Counter((r.doc_id, *[tuple(m) for m in r.matches]) for r in out)
    assert got == Counter((r[0], *longest_matches(r[1], items, window)) for r in rows)


def check(rows, df, items, benchmark, window=10):
    out = d.find_matches(df, benchmark, window=window).collect()
    got = Counter(
        (r.doc_id, r.n_words, tuple(i for h in r.hits for i in range(h.start, h.end)), tuple(r["items"]))
        for r in out
    )
    assert got == Counter((r[0], *expected(r[1], items, window)) for r in rows)


BENCHMARK = [
    (10, " ".join(prose(6, 30_000).split()[100:140])),  # long, within the very long text
    (9, prose(1, 40).upper()),
    (2, "Word"),  # shorter than a window
    (3, "don't"),  # two words
    (4, ""),
    (5, None),
    (None, prose(3, 25)),
    (2, "word"),  # a repeated id
    (7, "漢字 naïve"),
    (8, "the " * 30),
]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, ITEMS)


def test_odd_rows(odd, benchmark):
    check(ODD, odd, BENCHMARK, benchmark)


def test_window_and_shards(odd, benchmark, monkeypatch):
    monkeypatch.setattr(d, "SHARD_BYTES", 300)
    monkeypatch.setattr(d, "ARRAY_WORDS", 50)  # texts that span many arrays
    check(ODD, odd, BENCHMARK, benchmark, window=4)


def test_blocks_of_the_benchmark(odd, benchmark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 150)
    check(ODD, odd, BENCHMARK, benchmark)


def random_case(seed):
    """Texts and items of few words, so that they share much, in themselves too."""
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(rng.randrange(most)))
    items = [(rng.choice([None, *range(12)]), text(30)) for _ in range(25)]
    docs = [(i, text(60), None, None, None) for i in range(40)]
    docs += [(40 + i, f"x {t} y {t}", None, None, None) for i, (_, t) in enumerate(items)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_longest_matches(make, monkeypatch, seed):
    docs, items = random_case(seed)
    benchmark = make(items, ITEMS)
    check(docs, make(docs), items, benchmark, window=4)
    check_matches(docs, make(docs), items, benchmark, window=4)
    monkeypatch.setattr(d, "BLOCK_BYTES", 60)
    check(docs, make(docs), items, benchmark, window=4)
    check_matches(docs, make(docs), items, benchmark, window=4)


@pytest.mark.parametrize("seed", range(10))
def test_shard_in_parts(monkeypatch, seed):
    """Arrays that end within matches, blocks of a few items, and pairs a few at a time."""
    docs, items = random_case(seed)
    items = [(None if i is None else str(i), f"{k} {t}" if k % 2 else t) for k, (i, t) in enumerate(items)]
    table = pa.table(dict(zip(("item_id", "text"), map(list, zip(*items, strict=True)), strict=True)))
    blocks = []
    for row in (r for k in range(0, 25, 7) for r in d._prepared(table.slice(k, 7), 4).to_pylist()):
        numbers = [np.frombuffer(row[c], np.int64) for c in ("firsts", "places", "runs")]
        blocks.append(d.Block(row["ids"], np.frombuffer(row["letters"], np.uint64), *numbers, 4))
    monkeypatch.setattr(d, "ARRAY_WORDS", 20)
    monkeypatch.setattr(d, "PAIRS", 3)
    counts, hits, matches = d._shard([r[1] for r in docs], blocks, 4, WordHasher())
    for k, (_, text, *_) in enumerate(docs):
        n, hit, _ = expected(text, items, 4)
        assert (counts[k], tuple(np.flatnonzero(hits[k]))) == (n, hit)
        got = [(i, p, -q, n) for (i, p), (n, q) in matches[k].items()]
        assert sorted(got, key=str) == sorted(longest_matches(text, items, 4), key=str)


def test_matches_of_odd_rows(odd, benchmark):
    short = [r for r in ODD if len(r[1] or "") < 10_000]
    out = d.find_matches(odd, benchmark).collect()
    got = Counter((r.doc_id, *[tuple(m) for m in r.matches]) for r in out if len(r.text or "") < 10_000)
    assert got == Counter((r[0], *longest_matches(r[1], BENCHMARK, 10)) for r in short)


def test_one_word_again_and_again(make):
    """A text and an item of one word only: the pairs of all places are not listed."""
    rows = [(1, "the " * 3000, None, None, None)]
    (r,) = d.find_matches(make(rows), make([(1, "the " * 2000)], ITEMS)).collect()
    assert [tuple(m) for m in r.matches][0] == ("1", 0, 0, 2000)
    assert [tuple(m)[1:] for m in r.matches] == [(p, 0, 2000 - p) for p in range(1991)]


def test_empty_tables(none, odd, benchmark):
    assert d.find_matches(none, benchmark).collect() == []
    assert all(r.hits == [] for r in d.find_matches(odd, benchmark.limit(0)).collect())


def test_clashing_columns(odd, benchmark):
    out = d.find_matches(odd.withColumns({"Hits": F.lit(1), "items": F.lit(2), "row": F.lit(3)}), benchmark)
    assert out.columns == [*odd.columns, "row", "n_words", "hits", "items", "matches"]


@pytest.mark.parametrize("depth", [1, 2, 3, 10, 16])
def test_suffix_array_and_search(depth):
    rng = random.Random(depth)
    ranks = [rng.randrange(3) for _ in range(400)]
    order = d.suffix_array(np.array(ranks), depth).tolist()
    assert sorted(order) == list(range(400))
    keys = [tuple(ranks[i : i + depth]) for i in order]
    assert keys == sorted(keys)
    wanted = np.array([[rng.randrange(3) for _ in range(depth)] for _ in range(50)])
    low, high, longest = d.locate(np.array(ranks), np.array(order), wanted, np.full(50, depth))
    for k, w in enumerate(wanted.tolist()):
        at = {i for i in range(400) if ranks[i : i + depth] == w}
        assert set(order[low[k] : high[k]]) == at
        assert longest[k] == max(
            n for n in range(depth + 1) if any(ranks[i : i + n] == w[:n] for i in range(400 - n + 1))
        )
