import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from odd_docs import ODD, SCHEMA, groups, prose
from quillon.llm import ngram_join
from quillon.llm.words import WordHasher


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, percent=80):
    """Sorted (doc_id, n_shingles, component_id) of rows (doc_id, text) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    edges = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    part = groups(len(rows), edges)
    least = {}
    for (doc_id, _), p in zip(rows, part, strict=True):
        least[p] = min((x for x in (least.get(p), doc_id) if x is not None), default=None)
    return sorted(((d, len(s), least[p]) for (d, _), s, p in zip(rows, sets, part, strict=True)), key=str)


def run(df, **how):
    return sorted((tuple(r) for r in ngram_join.jaccard_components(df, **how).collect()), key=str)


def changed(text, at):
    words = text.split()
    for k in at:
        words[k % len(words)] = f"new{k}"
    return " ".join(words)


def family(seed, n, copies, most):
    """A text of n words and copies of it with up to `most` words replaced."""
    r = np.random.default_rng(seed)
    text = " ".join(f"w{x}" for x in r.integers(0, 5000, n))
    return [text, *[changed(text, r.integers(0, n, r.integers(0, most + 1)).tolist()) for _ in range(copies)]]


def test_equals_all_pairs(make):
    texts = [t for s in range(40) for t in family(s, 5 + 7 * s, 4, 1 + s // 3)]
    texts += [prose(s, 3 + s) for s in range(60)] + [f"word{s % 9} of few" for s in range(30)]
    rows = list(enumerate(texts))
    df = make([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(5)
    for percent in (80, 60):
        assert run(df, percent=percent) == brute(rows, percent)


def test_one_large_group_and_a_common_passage(make, monkeypatch):
    for name, value in (("LED", 3), ("PART", 8), ("COMMON", 20)):
        monkeypatch.setattr(ngram_join, name, value)
    passage = prose(99, 30)
    texts = family(1, 60, 150, 4) + [f"{prose(s, 12)} {passage} {prose(s + 500, 4 + s % 9)}" for s in range(150)]
    rows = list(enumerate(texts))
    df = make([(i, t, "en", "a", 1) for i, t in rows], SCHEMA).repartition(4)
    assert run(df) == brute(rows)


def test_odd_rows(odd, none):
    assert run(odd) == brute([r[:2] for r in ODD])
    assert run(none) == []


def test_extra_columns_with_names_used_inside(make):
    df = make([("n", 1, "s", b"h", prose(1, 30), i) for i in range(3)], "node string, u int, signature string, hashes binary, text string, doc_id int")
    assert run(df) == [(i, 26, 0) for i in range(3)]


@pytest.mark.parametrize("percent", [80, 90, 65])
def test_sets_that_link_share_a_signature(percent):
    r = np.random.default_rng(percent)
    table = ngram_join.bands(400, percent)
    none = np.empty(0, np.uint64)
    for n in [*range(1, 60), 90, 150, 240]:
        for _ in range(6):
            base = r.integers(0, 1 << 63, 2 * n + 20, dtype=np.uint64)
            most = int(r.integers(n, 100 * n // percent + 1))  # the larger set's size
            union_ = next(u for u in range(n + most, 0, -1) if 100 * (n + most - u) >= percent * u)
            both = n + most - union_
            a, b = np.unique(base[:n]), np.unique(np.concatenate((base[:both], base[n : n + most - both])))
            if a.tobytes() == b.tobytes():
                continue
            common = np.sort(base[: n // 2]) if n % 3 else none
            sig, of = ngram_join.signatures([a, b], table, common, percent)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (n, most, both)


def test_sets_without_elements_of_a_cut_still_meet():
    """Two links whose differences fill every part: found in a later cut, or by empty choices."""
    table = ngram_join.bands(50, 80)
    r = np.random.default_rng(3)
    for n in (5, 6, 9, 10, 13):
        for _ in range(300):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a[1:] if len(a) * 80 <= 100 * (len(a) - 1) else a
            sig, of = ngram_join.signatures([a, b], table, a, 80)  # all of them common
            assert len(a) == len(b) or set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_sketches_never_exceed_the_differences():
    r = np.random.default_rng(8)
    for n in (0, 3, 300, 90_000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 5 :], r.integers(0, 1 << 63, 7, dtype=np.uint64))))
        differ = np.abs(ngram_join.sketch(a).astype(int) - ngram_join.sketch(b)).sum()
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_shingle_counts_equal_those_of_strings():
    texts = [r[1] for r in ODD]
    found = ngram_join.shingle_sets([None if t is None else t.encode() for t in texts], WordHasher(), 5)
    assert [len(s) for s in found] == [len(shingles(t)) for t in texts]


def test_signing_holds_a_bounded_block(monkeypatch):
    """Memory of a task that signs more than fits a block, all its texts being one batch."""

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(ngram_join, "TaskContext", Context)
    r = np.random.default_rng(5)
    texts = [" ".join(f"{x:x}" for x in r.integers(0, 1 << 40, 1000)).encode() for _ in range(2600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    sign = ngram_join._signer(5, ngram_join.bands(1000, 80), np.empty(0, np.uint64), 80, 16)
    tracemalloc.start()
    entries = nodes = 0
    for out in sign([batch]):
        entries += sum(len(x.as_py()) // 8 for x in out.column("entries") if x.is_valid)
        nodes += sum(len(x.as_py()) // 16 for x in out.column("nodes") if x.is_valid)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert nodes == len(texts) and entries > 1 << 21
    assert peak < 170 << 20, peak
