import random

import pytest
from pyspark.sql import functions as F

from quillon.llm.mixing import mix_sources, water_level
from quillon.llm.queries import weights_by_name

SIZED = "doc_id bigint, source string, size bigint"


def targets_by_loop(sizes, weights, max_epochs=3.0):
    """Shares by weight; what exceeds a cap is shared again among the free ones."""
    left, free, out = float(sum(sizes.values())), set(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total >= max_epochs * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = max_epochs * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def mixed(df, **more):
    return mix_sources(df, weights_by_name(df), key=["doc_id"], **more).collect()


def check(rows):
    sizes, taken, biggest = {}, {}, {}
    for r in rows:
        s = r.source
        sizes[s] = sizes.get(s, 0) + (r.size or 0)
        taken[s] = taken.get(s, 0) + (r.size or 0) * r.copies
        biggest[s] = max(biggest.get(s, 0), r.size or 0)
        assert 0 <= r.copies <= 3
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets_by_loop(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in names:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6


def test_targets_and_copies(make):
    rng = random.Random(5)
    rows = [(i, "src0" if i % 3 == 0 else f"src{i % 9}", rng.randint(1, 400)) for i in range(3000)]
    df = make(rows, SIZED)
    once = mixed(df)
    check(once)
    assert sorted(once) == sorted(mixed(df.repartition(7)))  # reruns agree
    assert sorted(once) != sorted(mixed(df, seed=1))


def test_odd_rows(make):
    rows = [
        (1, "a", 10),
        (1, "a", 10),  # a repeated row
        (1, "a", 30),  # a repeated id
        (None, "a", 5),
        (2, None, 40),  # a source of null
        (3, "b", 0),  # a source without words
        (4, "c", None),
        (None, None, None),
    ]
    found = mixed(make(rows, SIZED))
    check(found)
    assert len(found) == len(rows)
    assert {r.copies for r in found if r.source in ("b", "c")} == {0}


def test_one_source_takes_itself_once(make):
    assert {r.copies for r in mixed(make([(i, "a", 5) for i in range(50)], SIZED))} == {1}


def test_empty_table(make):
    assert mixed(make([], SIZED)) == []


def test_clashing_columns(make):
    df = make([(1, "a", 7), (2, "b", 9)], SIZED).withColumns(
        {"Target": F.lit("x"), "copies": F.lit("y"), "row": F.lit("r"), "cell": F.lit(1), "place": F.lit(2)}
    )
    out = mix_sources(df, weights_by_name(df), key=["doc_id"])
    assert out.columns == ["doc_id", "source", "size", "row", "cell", "place", "source_size", "target", "copies"]
    assert {(r.row, r.cell, r.place) for r in out.collect()} == {("r", 1, 2)}


def test_all_sources_at_their_cap(make):
    sources = make([("a", 10, 1.0), ("b", 20, 9.0)], "source string, source_size bigint, weight double")
    assert water_level(sources, 1000.0, 3.0) is None
