import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import simhash
from quillon.llm.components import components
from quillon.llm.simhash import Links64, Links256, Members, Trie, neighbours

from odd_docs import ODD, groups, prose


def fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    shingles = shingles or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, budget=4):
    prints = [fingerprint(r[1]) for r in rows]
    near = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= budget
    ]
    group = groups(len(rows), near)
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    return Counter((r[0], p, least.get(g)) for r, p, g in zip(rows, prints, group))


def copies():
    """Texts with one word changed, in chains, among others."""
    rng, rows = random.Random(1), []
    for k in range(12):
        words = prose(k, 300).split()
        for i in range(8):
            rows.append((1000 - len(rows), " ".join(words), "en", "s", 0))
            words[rng.randrange(len(words))] = f"w{i}"
    return rows


@pytest.mark.parametrize("rows", [ODD, copies()], ids=["odd", "copies"])
def test_near_duplicates(make, rows):
    out = simhash.near_duplicates(make(rows)).collect()
    got = Counter((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in out)
    assert got == expected(rows)


def test_empty_table(none):
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.one_of_each(none).collect() == []


@pytest.mark.parametrize("piece_budget", [0, 4])
@pytest.mark.parametrize("seed", range(4))
def test_trie_join_finds_all(seed, piece_budget):
    """Random and close fingerprints, within a block and between two."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(1500)], np.uint64)
    every = np.unique(np.concatenate((base, base[rng.integers(0, 300, 1500)] ^ flips)))
    close = lambda a, b: np.bitwise_count(a[:, None] ^ b[None]) <= piece_budget
    member = lambda p: Members(p, p[:, None])
    got = neighbours(member(every), None, piece_budget, piece_budget)
    want = np.argwhere(close(every, every))
    assert groups(len(every), got) == groups(len(every), want)
    a, b = np.sort(every[::2]), np.sort(every[1::2])
    got = neighbours(member(a), member(b), piece_budget, piece_budget)
    both = np.concatenate((a, b))
    want = groups(len(both), np.argwhere(close(both, both)))
    cross = groups(len(both), [(i, j + len(a)) for i, j in np.argwhere(close(a, b))])
    found = groups(len(both), got)
    # all links across are found; links within a side may be found as well, none other
    assert all(found[i] == found[j] for i, j in enumerate(cross))
    assert all(want[i] == want[j] for i, j in enumerate(found))


def test_trie_of_equal_pieces():
    pieces = np.sort(np.repeat(np.array([5, 9], np.uint64) << np.uint64(32), 100))
    trie = Trie(pieces)
    assert trie.size[trie.left < 0].sum() == 200
    words = np.arange(200, dtype=np.uint64)[:, None] << np.uint64(40)
    assert neighbours(Members(pieces, words), None, 0, 0) == []


def test_counters_of_long_texts():
    """More shingles than a counter of 16 bits holds."""
    hashes = np.random.default_rng(0).integers(0, 2**64, 200_000, dtype=np.uint64)
    hashes[:150_000] |= np.uint64(1) << np.uint64(63)
    counts = np.array([150_000, 0, 50_000])
    parts = np.split(hashes, np.cumsum(counts)[:-1])
    want = [
        sum(1 << b for b in range(64) if 2 * int((p >> np.uint64(b) & np.uint64(1)).sum()) > len(p))
        for p in parts
    ]
    assert simhash.majorities(hashes, counts).tolist() == want


def test_one_of_each(make, odd):
    rows = copies() + [(5000, prose(77, 200), "en", "s", 0)]
    kept = simhash.one_of_each(make(rows), rule=Links256()).collect()
    assert sorted(r.doc_id for r in kept) == sorted([1000 - (8 * k + 7) for k in range(12)] + [5000])
    kept = simhash.one_of_each(odd).collect()
    # equal texts are one group, whatever their ids; so are those without words
    texts = {}
    for r in ODD:
        words = " ".join((r[1] or "").lower().split())
        texts.setdefault(words, []).append(r[0] if r[0] is not None else 10**9)
    got = Counter(r.doc_id if r.doc_id is not None else 10**9 for r in kept)
    assert got == Counter(min(v) for v in texts.values())


def test_clashing_columns(odd):
    extra = odd.withColumns({"name": F.lit("n"), "Fingerprint0": F.lit("f"), "node": F.lit(1)})
    out = simhash.one_of_each(extra)
    assert out.columns == extra.columns
    assert {(r.name, r.Fingerprint0, r.node) for r in out.collect()} == {("n", "f", 1)}


def test_rules():
    assert Links64().piece_budget == 4
    assert simhash.columns(Links256()) == [f"fingerprint{i}" for i in range(4)]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 700)] + [(7, 7)]
    want = groups(700, edges)
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.root for r in components(df).collect()}
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: want[n] for n in touched}
    assert components(df.limit(0)).collect() == []


@pytest.mark.parametrize("words", [1, 4])
def test_near_copies_are_parted(spark, words):
    """Most fingerprints share their first bits, and whole pieces; no group holds them all."""
    rng = np.random.default_rng(3)
    rule = Links64(block=64) if words == 1 else Links256(block=64)
    base = rng.integers(0, 2**64, (300, words), dtype=np.uint64)
    close = np.repeat(base[:1], 900, axis=0)
    close[:, -1] ^= np.array([sum(1 << int(b) for b in rng.choice(32, 6, replace=False)) for _ in close], np.uint64)
    every = np.unique(np.concatenate((base, close)), axis=0)
    rows = [(i, *r) for i, r in enumerate(every.view(np.int64).tolist())]
    nodes = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in ["node", *simhash.columns(rule)]))
    sizes = simhash.dealt(nodes, rule).groupBy(*simhash.GROUP).count().agg(F.max("count")).first()[0]
    assert sizes <= 4 * rule.block
    bits = np.bitwise_count(every[:, None] ^ every[None])
    want = bits.sum(axis=2, dtype=np.int64) <= rule.budget
    if words == 4:
        halves = every.view(np.uint32)
        want &= (np.bitwise_count(halves[:, None] ^ halves[None]) <= rule.piece_budget).any(axis=2)
    found = groups(len(every), [(r.u, r.v) for r in simhash.link(nodes, rule).collect()])
    assert found == groups(len(every), np.argwhere(want))


def test_a_row_is_sent_a_fixed_number_of_times(spark):
    assert [len(simhash.cuts(10**k, Links64())) for k in (4, 5, 6, 7, 8, 9, 11, 13)] == [1, 5, 5, 5, 5, 15, 15, 15]
    assert {len(simhash.cuts(10**k, Links256())) for k in range(3, 14)} == {1, 5, 15}
    for n in (10**5, 10**6):
        nodes = spark.range(n).select(F.col("id").alias("node"), F.xxhash64("id").alias("fingerprint"))
        assert simhash.dealt(nodes, Links64()).count() == 5 * n


@pytest.mark.parametrize("rule", [Links64(), Links256()])
def test_pieces_within_the_budget_are_equal_in_a_cut(rule):
    rng = np.random.default_rng(2)
    for n in (1, 10**6, 10**12):
        choices = simhash.cuts(n, rule)
        for _ in range(500):
            differ = set(rng.choice(rule.piece_bits, rule.piece_budget, replace=False).tolist())
            assert any(not any(a <= b < a + w for a, w in c for b in differ) for c in choices)


def test_near_copies_are_those_of_similarity_a_fifth_apart(make):
    """Planted pairs: none below 0.8 links, and 95% of those from 0.8 do."""
    rng, rows, similar = np.random.default_rng(4), [], []
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k, level in enumerate(np.repeat([0.70, 0.75, 0.79, 0.80, 0.85, 0.92], 50)):
        words = [f"w{x}" for x in rng.integers(0, 20_000, 400)]
        other, places = list(words), rng.permutation(400).tolist()
        j = 1.0
        while j > level + 0.012:
            other[places.pop()] = f"n{len(places)}"
            a, b = shingles(words), shingles(other)
            j = len(a & b) / len(a | b)
        similar.append(100 * len(a & b) >= 80 * len(a | b))
        rows += [(2 * k, " ".join(words), "en", "a", 1), (2 * k + 1, " ".join(other), "en", "a", 1)]
    kept = {r.doc_id for r in simhash.one_of_each(make(rows)).collect()}
    dropped = np.array([2 * k + 1 not in kept for k in range(len(similar))])
    similar = np.array(similar)
    assert kept >= {2 * k for k in range(len(similar))}
    assert not dropped[~similar].any()
    assert 100 <= similar.sum() <= 200 and dropped[similar].mean() >= 0.95


def test_a_large_group_of_near_copies_keeps_one(make):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for k in range(400):
        copy = list(words)
        for place in rng.choice(200, rng.integers(0, 4), replace=False):
            copy[place] = f"n{k}"
        rows.append((k, " ".join(copy), "en", "a", 1))
    assert [r.doc_id for r in simhash.one_of_each(make(rows)).collect()] == [0]


@pytest.mark.parametrize("rule", [Links64(block=64), Links256(block=64)])
def test_every_link_between_groups_comes_once(spark, rule):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**64, (40, rule.words), dtype=np.uint64)
    prints = np.repeat(base, 12, axis=0)
    prints[:, 0] ^= np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in prints], np.uint64)
    prints = np.unique(prints, axis=0)
    rows = [(i, i % 3, *r) for i, r in enumerate(prints.view(np.int64).tolist())]
    nodes = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in ["node", "grouped", *simhash.columns(rule)]))
    bits = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=np.int64)
    near = [(u, v) for u, v in np.argwhere(bits <= rule.budget).tolist() if u < v and u % 3 != v % 3]
    found = [tuple(sorted((r.u, r.v))) for r in simhash.link(nodes, rule, every=True).collect()]
    assert sorted(found) == near


def test_prints_and_sets_are_taken_in_one_python_step(make, monkeypatch, capsys):
    monkeypatch.setattr(simhash, "written", lambda df: df)
    texts = make([(i, prose(i, 40), "en", "a", 1) for i in range(5)])
    texts = texts.select("doc_id", F.col("text").cast("binary").alias("text"))
    prints = simhash._prints(texts, 5, 42, Links256())
    prints.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    plain = {r.doc_id: r for r in simhash.fingerprints(texts, shingle=5, rule=Links256()).collect()}
    names = simhash.columns(Links256())
    for r in prints.collect():
        assert [r[c] for c in names] == [plain[r.doc_id][c] for c in names] and len(r.set) == 16


def test_near_copies_below_the_similarity_are_not_listed_in_pairs(make, monkeypatch):
    """Texts whose fingerprints all link, but few of whose sets do, cost no square of their number."""
    rng = np.random.default_rng(8)
    words, rows = [f"w{x}" for x in rng.integers(0, 20_000, 400)], []
    for k in range(200):
        copy = list(words)
        for place in rng.choice(400, 12, replace=False):
            copy[place] = f"n{k}-{place}"
        rows.append((k, " ".join(copy), "en", "a", 1))
        if k % 10 == 0:
            rows.append((1000 + k, " ".join([*copy[:-1], "end"]), "en", "a", 1))
    tables, compared, real = [], [], simhash.ngram_join.verified

    def verified(pairs, sets, percent):
        compared.append(pairs.count())
        tables.append(sets.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(simhash.ngram_join, "verified", verified)
    kept = {r.doc_id for r in simhash.one_of_each(make(rows)).collect()}
    assert tables[0] == len(rows)  # each has a candidate
    assert sum(compared) <= 10 * len(rows)
    shingles = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (r[1].split() for r in rows)]
    near = [
        (i, j)
        for i, a in enumerate(shingles)
        for j, b in enumerate(shingles[:i])
        if 100 * len(a & b) >= 80 * len(a | b)
    ]
    firsts = {}
    for r, g in zip(rows, groups(len(rows), near)):
        firsts[g] = min(r[0], firsts.get(g, r[0]))
    assert kept == set(firsts.values()) and len(near) < 200


@pytest.mark.parametrize("second", [False, True])
def test_open_members(second):
    """Those near one of another group, though not each of their pairs is looked at."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(1500)], np.uint64)
    pieces = np.unique(np.concatenate((base, base[rng.integers(0, 60, 1500)] ^ flips)))
    parts = [pieces[::2], pieces[1::2]] if second else [pieces]
    pieces, grouped = np.concatenate(parts), rng.integers(0, 3, len(pieces))
    grouped[rng.integers(0, len(pieces), 900)] = 0
    near = np.bitwise_count(pieces[:, None] ^ pieces[None]) <= 4
    near &= grouped[:, None] != grouped[None]
    links = simhash.Open(len(pieces), grouped)
    assert neighbours(*([Members(p, p[:, None]) for p in parts] + [None])[:2], 4, 4, links=links) == []
    if second:  # links within a part may be found as well
        n, everywhere = len(parts[0]), near.any(axis=1)
        near[:n, :n] = near[n:, n:] = False
        assert (links.marked <= everywhere).all() and (near.any(axis=1) <= links.marked).all()
    else:
        assert links.marked.tolist() == near.any(axis=1).tolist()
