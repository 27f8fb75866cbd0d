"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.llm.shared import col, without, written
from quillon.llm.words import LETTERS_DIGITS, WordHasher, mixed, slices

#: Features are hashed to 2**BITS coordinates, so that a model has at most as many weights.
BITS = 20
#: The bounded sample that a model learns from: rows, and features of all of them.
MAX_ROWS, MAX_FEATURES = 16384, 1 << 25
#: Bytes of text taken at once.
SLICE_BYTES = 1 << 20


class Model(NamedTuple):
    """Non-zero weights, sorted by coordinate, and the bias."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 6.0,
    l2: float = 0.0,
    epochs: int = 8,
    seed: int = 42,
) -> Model:
    """A model of `labels` (doc_id, label 0 or 1) from the texts of `docs` (doc_id, text).

    It learns from a bounded sample: the `max_rows` labelled ids that come first in a seeded
    order, as far as their features, summed over rows, are not yet `max_features`; a warning
    says how many rows were left out for that. Ids or labels of null are left out;
    an id with several labels counts as 1 if any is. The ids' texts are found by a broadcast
    of at most `max_rows` ids, and their features are taken where they lie. One task then
    goes through the sample `epochs` times, in the seeded order, with a learning rate of its
    own for each coordinate; L1 leaves few weights other than zero, and only those are
    returned. Without labelled text the bias is minus infinity: every score is 0.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    known = labels.select(col("doc_id").alias("doc_id"), col("label").cast("int").alias("label"))
    sample = written(
        known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(order, "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    features = written(
        texts.join(F.broadcast(sample), "doc_id").mapInArrow(
            _extract, "doc_id bigint, label int, features array<int>"
        )
    )
    rows = features.orderBy(order, "doc_id", F.size("features"), "features").limit(max_rows)
    learned = rows.coalesce(1).mapInArrow(
        _learner(alpha, beta, l1, l2, epochs, max_features), "coordinate int, weight double"
    )
    found = sorted((r.coordinate, r.weight) for r in learned.collect())
    if not found:
        return Model(np.empty(0, np.int64), np.empty(0), -math.inf)
    (_, skipped), (_, bias), found = found[0], found[1], found[2:]  # at -2 and -1
    if skipped:
        warnings.warn(f"{skipped:.0f} labelled rows left out beyond {max_features} features", stacklevel=2)
    return Model(np.array([c for c, _ in found], np.int64), np.array([w for _, w in found]), bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score`, the probability of label 1 for its whole text, 0 to 1; replaces a
    column of that name. A null text has no features, like an empty one: its score is that of
    the bias. A row's score depends on its text alone, all of it however long, so repeated rows
    score alike; an empty table gives no row. No row moves; the model, of at most 2**BITS
    weights, is broadcast.
    """
    docs = without(docs, ["score"])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(_scorer(shared), schema)


def _coordinates(texts: list[str | None], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of single words, of pairs of neighbours and of pairs with one word
    skipped, and the text that each is from."""
    data = [(t or "").encode().translate(LETTERS_DIGITS) for t in texts]
    starts, _, h = hasher(b" ".join(data))
    begins = np.cumsum([0] + [len(x) + 1 for x in data])
    owner = np.searchsorted(begins, starts, "right") - 1
    features, owners = [mixed(h + np.uint64(1))], [owner]
    for step in (1, 2):
        one, two = h[: max(0, len(h) - step)], h[step:]
        own = owner[: len(one)]
        same = own == owner[step:]
        pair = one * np.uint64(3) + two * np.uint64(5) + np.uint64(step)
        features.append(mixed(pair[same]))
        owners.append(own[same])
    return (np.concatenate(features) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str | None]]]:
    text = batch.column(batch.schema.names.index("text"))
    sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
    for a, b in slices(sizes, SLICE_BYTES):
        yield a, b, text[a:b].to_pylist()


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        for a, b, texts in _parts(batch):
            found, owner = _coordinates(texts, hasher)
            keys = np.unique(owner << BITS | found)
            cuts = np.searchsorted(keys >> BITS, np.arange(b - a + 1)).astype(np.int32)
            values = pa.array((keys & ((1 << BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[a:b].cast(pa.int64()),
                    batch.column("label")[a:b],
                    pa.ListArray.from_arrays(pa.array(cuts), values),
                ],
                names=["doc_id", "label", "features"],
            )


def _learner(alpha: float, beta: float, l1: float, l2: float, epochs: int, max_features: int) -> Callable:
    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, skipped = [], 0, 0
        for batch in batches:
            for label, features in zip(batch.column("label").to_pylist(), batch.column("features"), strict=True):
                if held >= max_features:
                    skipped += 1
                else:
                    held += len(features)
                    x = np.append(features.values.to_numpy(), np.int32(1 << BITS))  # the bias
                    rows.append((label, x))
        if not rows:
            return
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

        def weights(zx: np.ndarray, nx: np.ndarray, penalty: np.ndarray) -> np.ndarray:
            w = -(zx - np.sign(zx) * penalty) / ((beta + np.sqrt(nx)) / alpha + l2)
            return np.where(np.abs(zx) <= penalty, 0.0, w)

        for _ in range(epochs):
            for label, x in rows:
                zx, nx = z[x], n[x]
                penalty = np.full(len(x), l1)
                penalty[-1] = 0
                w = weights(zx, nx, penalty)
                g = 1 / (1 + math.exp(-min(max(w.sum(), -35.0), 35.0))) - label
                grown = nx + g * g
                z[x] = zx + g - (np.sqrt(grown) - np.sqrt(nx)) / alpha * w
                n[x] = grown
        penalty = np.full(len(z), l1)
        penalty[-1] = 0
        w = weights(z, n, penalty)
        kept = np.flatnonzero(w[:-1])
        yield pa.RecordBatch.from_pydict(
            {
                "coordinate": pa.array(np.append(kept, [-1, -2]), pa.int32()),
                "weight": pa.array(np.append(w[kept], [w[-1], skipped]), pa.float64()),
            }
        )

    return learn


def _scorer(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinates, weights, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[coordinates] = weights
        hasher = WordHasher()
        for batch in batches:
            sums = [np.empty(0)]
            for a, b, texts in _parts(batch):
                found, owner = _coordinates(texts, hasher)
                weighty = dense[found] != 0
                keys = np.unique(owner[weighty] << BITS | found[weighty])
                sums.append(np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], b - a) + bias)
            scores = 1 / (1 + np.exp(-np.clip(np.concatenate(sums), -700, 35)))
            scores = np.zeros(len(scores)) if bias == -math.inf else scores
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"]
            )

    return run
