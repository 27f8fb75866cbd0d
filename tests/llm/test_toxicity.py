import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import toxicity as t
from quillon.llm.queries import in_fold
from quillon.llm.words import LETTERS_DIGITS, WordHasher, mixed

from odd_docs import ODD, prose

LABELS = "doc_id bigint, label int"


def rows(n=400):
    rng, out, labels = random.Random(4), [], []
    for i in range(n):
        words, bad = prose(i, 40).split(), i % 5 == 0
        if bad:
            for w in ("idiot", "stupid", "loser"):
                words.insert(rng.randrange(len(words)), w)
        out.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(bad)))
    return out, labels


@pytest.fixture(scope="module")
def learned(make):
    docs, labels = rows()
    return t.fit(make(docs), make([x for x in labels if x[0] < 300], LABELS))


def scores(df, model):
    return {r.doc_id: r.score for r in t.score(df, model).collect()}


def test_held_out_rows(make, learned):
    docs, labels = rows()
    got = scores(make(docs), learned)
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels if i >= 300)
    assert len(learned.weights) < 3000  # few of the features keep a weight


def test_score_by_definition(make, learned):
    """One text's score, feature by feature."""
    text = "You idiot. The stupid dog and the stupid dog!"
    hasher, weights = WordHasher(), dict(zip(learned.coordinates.tolist(), learned.weights.tolist()))
    h = [hasher(w)[2][0] for w in text.encode().translate(LETTERS_DIGITS).split()]
    one = np.array
    features = {int(mixed(one([x + np.uint64(1)]))[0] >> np.uint64(44)) for x in h}
    for step in (1, 2):
        for a, b in zip(h, h[step:]):
            pair = one([a]) * np.uint64(3) + one([b]) * np.uint64(5) + np.uint64(step)
            features.add(int(mixed(pair)[0] >> np.uint64(44)))
    total = learned.bias + sum(weights.get(f, 0.0) for f in features)
    got = scores(make([(1, text, None, None, None)]), learned)[1]
    assert got == pytest.approx(1 / (1 + math.exp(-total)))


def test_features_do_not_cross_texts(make, learned):
    docs, _ = rows(30)
    together = scores(make(docs).coalesce(1), learned)
    apart = scores(make(docs).repartition(30), learned)
    assert together == apart


def test_odd_rows(odd, learned):
    out = t.score(odd, learned).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    blank = 1 / (1 + math.exp(-learned.bias))
    assert all(r.score == pytest.approx(blank) for r in out if not (r.text or "").strip())


def test_no_labels(make, odd):
    for labels in ([], [(None, 1), (1, None), (777, 1)]):
        model = t.fit(odd, make(labels, LABELS))
        assert {r.score for r in t.score(odd, model).collect()} == {0.0}


def test_odd_labels(make, odd):
    """Repeated and contradicting labels; ids that several rows share."""
    model = t.fit(odd, make([(1, 0), (1, 1), (2, 0), (2, 0), (6, 0), (3, 1)], LABELS))
    assert all(0 <= s <= 1 for s in scores(odd, model).values())


def test_bounded_sample(make):
    docs, labels = rows(200)
    once = t.fit(make(docs), make(labels, LABELS), max_rows=50)
    again = t.fit(make(docs).repartition(5), make(labels, LABELS).repartition(3), max_rows=50)
    assert once.bias == again.bias and (once.weights == again.weights).all()


def test_empty_and_clashing(none, odd, learned):
    assert t.score(none, learned).collect() == []
    out = t.score(odd.withColumns({"Score": F.lit("x"), "label": F.lit("y")}), learned)
    assert out.columns == [*odd.columns, "label", "score"]


def test_folds(make):
    got = make([(i, None, None, None, None) for i in range(50)] + [(None,) * 5])
    for r in got.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("x")).collect():
        assert r.x == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_rows_beyond_the_features_are_told(make):
    docs = make([(i, prose(i, 30), "en", "a", 1) for i in range(20)])
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) AS label")
    with pytest.warns(UserWarning, match="labelled rows left out beyond 100 features"):
        t.fit(docs, labels, max_features=100)
