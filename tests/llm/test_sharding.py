from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import sharding
from quillon.llm.sharding import external_shuffle


def check(df, out, shards):
    given = Counter(map(tuple, df.collect()))
    rows = out.select(*df.columns, "shard", "slot").collect()
    assert Counter(tuple(r)[:-2] for r in rows) == given
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    return sorted((r.shard, r.slot, r.doc_id or -1) for r in rows)


@pytest.mark.parametrize("bucket_bytes", [1 << 10, 1 << 24])
def test_odd_rows(odd, bucket_bytes):
    once = external_shuffle(odd, shards=4, bucket_bytes=bucket_bytes)
    again = external_shuffle(odd, shards=4, bucket_bytes=bucket_bytes)
    assert check(odd, once, 4) == check(odd, again, 4)


def test_order_is_mixed_within_and_across_buckets(make):
    df = make([(i, f"text {i}", None, None, i) for i in range(4000)])
    rows = external_shuffle(df, shards=5, bucket_bytes=1 << 14).collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert sorted(order) == list(range(4000))
    steps = sum(b == a + 1 for a, b in zip(order, order[1:]))
    assert steps < 20  # about one is expected
    half = sum(d < 2000 for d in order[:2000])
    assert 850 < half < 1150
    assert {r.doc_id for r in external_shuffle(df, shards=5, seed=7).where("shard = 0").collect()} != {
        r.doc_id for r in rows if r.shard == 0
    }


def test_files_are_sharded(make):
    out = external_shuffle(make([(i, "t", None, None, i) for i in range(40)]), shards=4)
    assert {f.split("shard=")[1][0] for f in out.inputFiles()} == set("0123")


def test_empty_table(none):
    out = external_shuffle(none)
    assert out.collect() == []
    assert out.columns == [*none.columns, "shard", "slot"]


def test_clashing_columns(odd):
    out = external_shuffle(odd.withColumns({"Shard": F.lit("x"), "bucket": F.lit("b"), "order": F.lit(1)}))
    assert out.columns == [*odd.columns, "bucket", "order", "shard", "slot"]
    assert out.where("bucket = 'b'").count() == odd.count()


def test_equal_rows_are_spread_over_buckets(make, monkeypatch):
    """A third of the rows are equal in all columns; no bucket holds them all."""
    seen, orders = [], sharding._orders
    monkeypatch.setattr(sharding, "_orders", lambda counts, seed: orders(seen.append(counts) or counts, seed))
    df = make([(i if i % 3 else 0, f"text {i if i % 3 else 0}", None, None, 0) for i in range(3000)])
    once = external_shuffle(df, shards=4, bucket_bytes=1 << 13)
    assert seen[0].agg(F.sum("n"), F.max("n")).first()[0] == 3000
    assert seen[0].agg(F.max("n")).first()[0] < 400  # of 1,000 equal ones, in 27 buckets
    again = external_shuffle(df.repartition(7), shards=4, bucket_bytes=1 << 13)
    assert check(df, once, 4) == check(df, again, 4)
