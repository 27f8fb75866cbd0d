"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import col, without, written

#: Bytes a row takes in a bucket besides its text.
ROW_BYTES = 64

#: Copies of a row that together are more than this part of a bucket are dealt in runs that are no more.
PART = 4

#: Buckets are numbered through in groups of this many.
GROUP = 1024

ADDED = ("shard", "slot")


def external_shuffle(
    docs: DataFrame, *, shards: int = 16, seed: int = 42, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """All rows of `docs` in random order, dealt to `shards` shards written as Parquet.

    Pass one scatters the rows by a seeded hash of all their columns into buckets of about
    `bucket_bytes`. Pass two gives the rows of a bucket their places by a Fisher-Yates
    shuffle, and writes them. Buckets follow one another, so each row has one place in the
    whole; place p is slot p div shards of shard p mod shards. Shards thus differ by at
    most one row, and slots run from 0 without a gap.

    Rows equal in all columns are interchangeable. They share a bucket if they are few; if
    together they take more than a PART of a bucket, they are counted on the map side and their
    copies dealt in numbered runs, each to a bucket of its own hash. The table of such rows'
    hashes, which is broadcast, has PART rows a bucket at most.

    Adds `shard` and `slot`, which replace columns of these names. Null texts count as
    empty. An empty table gives empty shards. Columns of type map can't be hashed and are refused.

    The text is shuffled once. A bucket's order is drawn before, from its number of rows
    alone, and kept as a table: a task that runs again deals its rows as before.
    """
    docs = without(docs, ADDED)
    names = [col(c) for c in docs.columns]
    size = F.coalesce(F.octet_length(col("text")), F.lit(0)) + ROW_BYTES
    total = docs.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))

    mark = F.xxhash64(F.lit(seed), *names)
    keyed = docs.select(F.struct(*names).alias("row"), mark.alias("mark"), size.cast("bigint").alias("size"))
    keyed = _bucketed(keyed, n_buckets, seed, bucket_bytes // PART)
    buckets = _orders(keyed.groupBy("bucket").agg(F.count("*").alias("n")), seed)

    turn = F.row_number().over(Window.partitionBy("bucket").orderBy("mark", "row"))
    placed = (
        keyed.withColumn("turn", turn)
        .join(buckets, "bucket")
        .select("row", (F.col("first") + F.get("order", F.col("turn") - 1)).alias("place"))
        .select(
            "row.*",
            F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
            F.floor(F.col("place") / shards).alias("slot"),
        )
    )
    return written(placed.sortWithinPartitions("shard", "slot"), partition_by=["shard"])


def _bucketed(keyed: DataFrame, n_buckets: int, seed: int, most: int) -> DataFrame:
    """(row, mark, bucket) of each of `keyed` (row, mark, size); copies of a row that take more
    than `most` bytes are dealt in runs."""
    copies = keyed.groupBy("mark").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    many = written(
        copies.where((F.col("n") > 1) & (F.col("n") * F.col("size") > most)).select(
            F.col("mark").alias("many"), F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("size"))).alias("run")
        )
    )
    met = keyed.join(F.broadcast(many), F.col("mark") == F.col("many"), "left")
    few = met.where(F.col("many").isNull()).select(
        "row", "mark", F.pmod(F.xxhash64(F.lit(seed + 1), "mark"), F.lit(n_buckets)).alias("bucket")
    )
    runs = (
        met.where(F.col("many").isNotNull())
        .groupBy("row", "mark", "run")
        .agg(F.count("*").alias("n"))
        .withColumn("nth", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("run")))))
        .withColumn("n", F.least("run", F.col("n") - F.col("nth") * F.col("run")))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "mark", "nth"), F.lit(n_buckets)))
    )
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(parts, "mark", "nth").withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    return few.unionByName(dealt.select("row", "mark", "bucket"))


def _orders(counts: DataFrame, seed: int) -> DataFrame:
    """Per bucket its first place in the whole and a shuffled order of its rows.

    First places are running sums, taken within groups of buckets and over the groups.
    """
    counts = written(counts.withColumn("part", F.floor(F.col("bucket") / GROUP)))
    parts = counts.groupBy("part").agg(F.sum("n").alias("m"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("m").over(before.orderBy("part"))
    parts = parts.select("part", F.coalesce(start, F.lit(0)).alias("start"))
    within = F.sum("n").over(before.partitionBy("part").orderBy("bucket"))
    return written(
        counts.withColumn("within", F.coalesce(within, F.lit(0)))
        .join(parts, "part")
        .sortWithinPartitions("bucket")
        .select(
            "bucket",
            (F.col("start") + F.col("within")).alias("first"),
            F.shuffle(F.sequence(F.lit(0), F.col("n") - 1), F.lit(seed)).alias("order"),
        )
    )
