"""From raw documents to a shuffled training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but
the last return the columns of `docs`, whatever they are; columns with the names that a
stage uses inside are kept apart from those. A stage holds for nulls, empty and repeated
rows and empty tables what its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontamination, mixing, sharding, simhash, toxicity
from quillon.llm.queries import SEED, toxicity_model, weights_by_name
from quillon.llm.shared import col, n_words, written
from quillon.sources import read_table


def _packed(docs: DataFrame) -> DataFrame:
    """`docs` as its text, and one column `row` of all others, so that a text is sent to Python once."""
    others = [col(c) for c in docs.columns if c.lower() != "text"]
    return docs.select(F.struct(*others).alias("row"), col("text").alias("text"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of `packed`, with the columns of `docs`."""
    row = F.col("row")
    return packed.select(*[F.col("text").alias(c) if c.lower() == "text" else row[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity_model(spark, docs.select("doc_id", "text"), sf_dir)
    return _unpacked(toxicity.score(_packed(docs), model).where(F.col("score") < 0.5), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: found by a trie join of 256-bit SimHashes,
    and linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.one_of_each(docs, shingle=5, seed=SEED)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = read_table(spark, sf_dir, "benchmark")
    found = decontamination.find_matches(_packed(docs), benchmark)
    return _unpacked(found.where(F.size("hits") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of all sources takes them."""
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row")).select(
        "row",
        F.col("row.source").alias("source"),
        n_words(F.col("row.text")).alias("size"),
        F.col("row.doc_id").alias("doc_id"),
        F.xxhash64("row").alias("mark"),
    )
    weights = weights_by_name(docs.select("source"))
    mixed = mixing.mix_sources(rows, weights, key=["doc_id", "mark"], seed=SEED)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in random order in 16 shards, with `shard` and `slot`."""
    return sharding.external_shuffle(docs, shards=16, seed=SEED)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: No SQL expresses the learned toxicity scores that the first stage decides by.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
