"""What several operators need: intermediate tables that outlive an executor, and names."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word as most contracts count it: a run without space, tab, line feed, vertical tab,
#: form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="quillon-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in `spark.checkpoint.dir` of the session. Where that is unset, as in tests on
    one machine, a temporary folder takes its place.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or _own_folder()
    return f"{top.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI that pyarrow knows (file, hdfs, s3, gs), and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def written(df: DataFrame, partition_by: Iterable[str] = ()) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back.

    Cuts the lineage: what was computed once is neither computed again nor lost with an
    executor, and later plans know the table's true size.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[col(c) for c in df.columns])


#: Bits of a filter, kept as words of 64: at most 2**18 rows, however many keys it holds.
FILTER_BITS = 1 << 24


def _slot(key: Column) -> tuple[Column, Column]:
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
    return F.floor(slot / 64), bit


def bit_filter(keys: DataFrame, key: Column) -> DataFrame:
    """A table of bits, of a fixed greatest size, by which `may_hold` tells most rows without
    one of the keys."""
    word, bit = _slot(key)
    return written(keys.groupBy(word.alias("filter_word")).agg(F.bit_or(bit).alias("filter_bits")))


def may_hold(df: DataFrame, key: Column, filter_: DataFrame) -> DataFrame:
    """`df` with `maybe`: true for every row whose key the filter holds, and for few others.

    No row moves. With more keys than the filter can tell apart more rows are true; what is
    true must be compared with the keys in any case.
    """
    word, bit = _slot(key)
    met = df.withColumn("word_", word).join(
        F.broadcast(filter_), F.col("word_") == F.col("filter_word"), "left"
    )
    maybe = F.coalesce(F.col("filter_bits").bitwiseAND(bit) != 0, F.lit(False))
    return met.withColumn("maybe", maybe).drop("word_", "filter_word", "filter_bits")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` without columns that clash, letter case aside, with `names`."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
