import math
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from quillon.llm import divergence as d

from odd_docs import ODD, prose


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(repeated),
        n < 20 or 100 * len(repeated) > 30 * n,
    )


def classes(text):
    out = [0] * 6
    for c in text:
        k = (
            0 if regex.match(r"\p{Lu}", c) else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c)
            else 3 if c in " \t\n\x0b\f\r" else 4 if c in ".,;:!?'\"()-" else 5
        )
        out[k] += 1
    return out


def letters_only(text):
    return [w for w in regex.sub(r"[^\p{L}]+", " ", text).lower().split(" ") if w]


def jensen_shannon(p, q):
    half = lambda x, y: x * math.log2(2 * x / (x + y)) / 2 if x else 0.0
    return math.sqrt(max(0.0, sum(half(x, y) + half(y, x) for x, y in zip(p, q))))


def expected(rows):
    sums, counts = {}, {}
    for r in rows:
        text = r[1] or ""
        sums.setdefault(r[2], Counter()).update(dict(enumerate(classes(text))))
        counts.setdefault(r[2], Counter()).update(letters_only(text))
    out = []
    for r in rows:
        text = r[1] or ""
        total, words = sum(sums[r[2]].values()), counts[r[2]]
        common = sorted(words, key=lambda w: (-words[w], w))[: d.COMMON]
        own = Counter(letters_only(text))
        n, m = sum(own.values()), sum(words.values())
        word = char = None
        if n >= d.MIN_WORDS:
            shares = [words[w] / m for w in common] + [0.0] * (d.COMMON - len(common))
            mine = [own[w] / n for w in common] + [0.0] * (d.COMMON - len(common))
            word = jensen_shannon([*mine, 1 - sum(mine)], [*shares, 1 - sum(shares)])
        if len(text) >= d.MIN_CHARS:
            char = jensen_shannon([c / len(text) for c in classes(text)], [sums[r[2]][i] / total for i in range(6)])
        b = base(text)
        far = (word or 0) > d.MAX_WORD_DISTANCE or (char or 0) > d.MAX_CHAR_DISTANCE
        out.append((r[0], *b, word, char, not b[-1] and not far))
    return out


JUNK = [
    (100 + i, t, "en", "j", 0)
    for i, t in enumerate(
        [
            " ".join(f"w{k}x$$$ y{k}&&&" for k in range(60)),
            prose(1, 90).upper() + "!!",
            " | ".join(f"col{k}" for k in range(80)),
            " ".join(["the"] * 100),
            "# * $ % & | < >\nx\nx\n\n\n \n",
            prose(5, 8) + " " + prose(9, 30) + " " + prose(5, 8),  # one window twice
        ]
    )
]


def test_against_plain_python(make):
    rows = ODD + JUNK + [(200 + i, prose(200 + i, 120), "en", "p", 0) for i in range(40)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(
        ((r.doc_id, *(r[c] for c in d.BASE), r.word_distance, r.char_distance, r.kept) for r in d.judge(make(rows)).collect()),
        key=key,
    )
    want = sorted(expected(rows), key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    for g, w in zip(got, want):
        for a, b in zip(g[7:9], w[7:9]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-7))
    assert [g[9] for g in got] == [w[9] for w in want]
    kept = {g[0] for g in got if g[9]}
    assert set(range(200, 240)) <= kept and not kept & {100, 101, 102, 103, 104}


def test_empty_and_clashing(none, odd):
    assert d.judge(none).collect() == []
    out = d.judge(odd.withColumns({"Kept": F.lit(1), "words": F.lit("w"), "classes": F.lit("c"), "row": F.lit(2)}))
    assert out.columns == [*odd.columns, "words", "classes", "row", *d.BASE, "word_distance", "char_distance", "kept"]
    assert out.where("words = 'w' and classes = 'c' and row = 2").count() == len(ODD)


def test_work_is_left_out_where_it_tells_nothing(make):
    """Windows are hashed only where four words come twice, and texts in ASCII lowered as a whole."""
    odd = "\u0130stanbul IS Ok"
    texts = [" ".join(f"w{i}" for i in range(40)), " ".join(["one two Three four five"] * 4), "A b. C", odd]
    df = make([(i, t, "en", "a", 1) for i, t in enumerate(texts)]).select("doc_id", "text", F.lit("=en").alias("tongue"))
    rows = {r.doc_id: r for r in d._base(d._profiles(df)).collect()}
    assert [len(rows[i].windows) for i in range(4)] == [0, 13, 0, 0]
    assert [rows[i].n_repeat_words for i in range(4)] == [0, 20, 0, 0]
    assert rows[2].letter_words == ["a", "b", "c"] and rows[3].letter_words == odd.split()
    top = d.references(d._profiles(df.where("doc_id = 3"))).first()
    assert sorted(top.common) == sorted(w.lower() for w in odd.split())


def test_fours_are_hashed_only_where_seven_pairs_repeat(make):
    """Six pairs of a text that equal an earlier one rule out a window found twice."""
    tail = " ".join(f"t{i}" for i in range(30))
    one = lambda n: " ".join(f"w{i}" for i in range(n))
    texts = [f"{one(n)} x {one(n)} {tail}" for n in (7, 8)]
    df = make([(i, t, "en", "a", 1) for i, t in enumerate(texts)]).select("doc_id", "text", F.lit("=en").alias("tongue"))
    rows = {r.doc_id: r for r in d._base(d._profiles(df)).collect()}
    assert [len(rows[i].four) for i in (0, 1)] == [0, 44]
    assert [rows[i].n_repeat_words for i in (0, 1)] == [0, 16]


def test_an_empty_word_is_not_common(make):
    """Texts that begin with no letter have an empty word; a language without letters has no common one."""
    rows = [(1, "1 " + "the of " * 200, "en", "a", 1), (2, "12 34 " * 80, "xx", "a", 1)]
    got = {r.doc_id: r for r in d.judge(make(rows), min_words=1).collect()}
    assert got[1].word_distance == pytest.approx(0) and got[2].word_distance is None
    assert got[1].char_distance == pytest.approx(0) and got[2].char_distance == pytest.approx(0)
