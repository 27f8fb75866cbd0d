from pyspark.sql import functions as F

from quillon.llm.shared import bit_filter, col, may_hold, n_words, without, written


def test_filter_holds_all_keys_and_few_others(spark):
    rows = spark.range(20_000).withColumn("key", F.struct(F.col("id"), F.lit(None).alias("none")))
    keys = rows.where("id % 100 = 0").select("key")
    marked = may_hold(rows, F.col("key"), bit_filter(keys, F.col("key")))
    assert marked.columns == ["id", "key", "maybe"]
    found = {r.id for r in marked.where("maybe").collect()}
    assert {i for i in range(0, 20_000, 100)} <= found and len(found) < 220
    assert marked.count() == 20_000


def test_empty_filter(spark):
    rows = spark.range(10)
    marked = may_hold(rows, F.col("id"), bit_filter(rows.limit(0), F.col("id")))
    assert marked.where("maybe").count() == 0 and marked.count() == 10


def test_written_keeps_columns_and_rows(spark):
    df = spark.range(10).select((F.col("id") % 3).cast("int").alias("part"), F.col("id").alias("a.b"))
    for by in ([], ["part"]):
        out = written(df, partition_by=by)
        assert out.dtypes == df.dtypes
        assert sorted(out.collect()) == sorted(df.collect())


def test_written_where_the_session_says(spark, tmp_path):
    class Session:
        conf = {"spark.checkpoint.dir": f"file://{tmp_path}/"}

    from quillon.llm.shared import shared_folder

    assert shared_folder(Session()).startswith(f"file://{tmp_path}/quillon-")
    assert shared_folder(Session()) != shared_folder(Session())


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, Shard int, `c``d` int")
    assert without(df, ["shard"]).columns == ["a.b", "c`d"]
    assert df.select(col("a.b"), col("c`d")).first()[:] == (1, 3)


def test_words(spark):
    texts = [("a  b\tc\x0bd\n", 4), ("", 0), (None, 0), ("\x1c \xa0", 2), (" x", 1)]
    df = spark.createDataFrame(texts, "text string, n bigint")
    assert all(r[0] == r[1] for r in df.select(n_words(F.col("text")), "n").collect())
