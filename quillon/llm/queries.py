"""The registered queries: each applies an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import (
    audit,
    centroids,
    decontamination,
    divergence,
    fuzzy_lines,
    language,
    mixing,
    ngram_join,
    sharding,
    simhash,
    tokens,
    toxicity,
    warc,
)
from quillon.llm.shared import n_words, written
from quillon.sources import read_table

#: Weights of sources in the order of their names, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 42


def weights_by_name(sources: DataFrame) -> DataFrame:
    """(source, weight): sources by code point, null last, weigh 5, 2, 1, repeating.

    The table has a row per source of the mix, not per document.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.array(*[F.lit(w) for w in WEIGHTS])
    weight = F.get(given, F.pmod(rank, F.lit(len(WEIGHTS))))
    return sources.select("source").distinct().withColumn("weight", weight)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    docs = read_table(spark, sf_dir, "documents")
    sized = written(
        docs.select(
            "doc_id", "source", n_words(F.col("text")).alias("size"), F.md5("text").alias("digest")
        )
    )
    mixed = mixing.mix_sources(
        sized, weights_by_name(sized), key=["doc_id", "digest"], seed=SEED
    )
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves `fold` modulo `folds`; false for a null id."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(rest == fold, F.lit(False))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the texts of `docs` whose labels are not held out."""
    labels = read_table(spark, sf_dir, "labels").where(~in_fold(F.col("doc_id"), 5, 0))
    return toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).select(
        "doc_id",
        in_fold(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts of each document and whether its histograms fit its language."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rounded = {c: F.round(c, 6) for c in ("word_distance", "char_distance")}
    return divergence.judge(docs).drop("text", "lang").withColumns(rounded)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document, and those that repeat a line kept elsewhere."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return fuzzy_lines.duplicate_lines(docs).select("doc_id", "n_lines", "n_removed", "removed")


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash of each document and the component that its links lead to."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, seed=SEED)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = language.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document, and whether it exceeds 1024 tokens."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark that each document holds verbatim."""
    found = decontamination.find_matches(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"),
        read_table(spark, sf_dir, "benchmark"),
    )
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(
            "hits", F.lit(0).cast("bigint"), lambda n, h: n + h["end"] - h["start"]
        ).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of each document after a two-pass external shuffle."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.external_shuffle(docs, shards=16, seed=SEED).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records with an index, and read back through it."""
    index = warc.write_archives(read_table(spark, sf_dir, "pages"))
    return warc.read_records(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shingles of each document and the component that links of similarity 0.8 lead to."""
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"), shingle=5, percent=80)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the terms of each source are from its language's other sources and from the language."""
    return audit.audit(read_table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each embedding after ten rounds of k-means in whole numbers."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.cluster(vectors, k=8, dims=64, rounds=10, scale=1024, seed=3).drop("embedding")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op")}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))
