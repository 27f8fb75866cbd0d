"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillon.llm.shared import col, without, written
from quillon.llm.words import slices

#: Symbols: 0 for all that is no letter, 1 to 26 for a to z, and the rest for other letters,
#: which share them by their code points.
SYMBOLS = 64
#: The bounded sample that automata are built from: rows a language, characters of a row,
#: symbols a language, and symbols of all languages.
ROWS, PASSAGE, TEXT, TEXTS = 64, 400, 12000, 1 << 17
#: Texts are parsed in segments of so many symbols, side by side.
SEGMENT = 512
SLICE_BYTES = 1 << 20

UNKNOWN = "und"


class Automata(NamedTuple):
    """Languages, their roots, what a phrase counts, and the next state by state and symbol.

    State 0 stands for none.
    """

    names: list[str]
    roots: np.ndarray
    cost: np.ndarray
    following: np.ndarray


def alphabet() -> np.ndarray:
    """The symbol of each code point in lower case."""
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    points = np.arange(0x110000)
    table = np.where(letters, 27 + points % (SYMBOLS - 27), 0).astype(np.uint8)
    table[97:123] = np.arange(1, 27)
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """The symbols of a text; neighbours that are no letters are one."""
    found = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    kept = found != 0
    kept[1:] |= found[:-1] != 0
    return found[kept]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring of `text` from its
    state 0 (Blumer et al., 1985)."""
    following, link, length, last = [{}], [-1], [0], 0
    for c in text:
        now = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = now
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return following


def fit(
    docs: DataFrame,
    *,
    seed: int = 42,
    rows_each: int = ROWS,
    passage: int = PASSAGE,
    symbols_each: int = TEXT,
    symbols_all: int = TEXTS,
) -> Automata:
    """Automata of the languages of `docs` (doc_id, text, lang).

    They are built from a bounded sample: of each language's rows with a text, the `rows_each`
    that come first in a seeded order of their ids, a passage of `passage` characters at a seeded
    place of each, joined and cut to `symbols_each` symbols, or fewer if the languages together
    would exceed `symbols_all`. Rows without a language are left out; ids of null share a place. The order
    is taken on ids alone, by a window of which each map task sends `rows_each` rows a language at
    most; the chosen ids, a bounded number a language, find their texts by a join.
    """
    known = docs.where(col("lang").isNotNull() & col("text").isNotNull())
    rows = known.select(
        col("doc_id").alias("doc_id"),
        col("lang").cast("string").alias("lang"),
        col("text").alias("text"),
    ).withColumn("turn", F.xxhash64(F.lit(seed), "doc_id"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("turn"))
    chosen = written(
        rows.select("lang", "turn").withColumn("nth", nth).where(F.col("nth") <= rows_each).drop("nth").distinct()
    )
    start = F.pmod("turn", F.greatest(F.char_length("text") - passage, F.lit(0)) + 1) + 1
    passages = rows.join(chosen, ["lang", "turn"]).select(
        "lang", "turn", F.substring("text", start.cast("int"), F.lit(passage)).alias("passage")
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "passage"))
    sample = passages.withColumn("nth", nth).where(F.col("nth") <= rows_each).orderBy("lang", "nth")
    table, texts = alphabet(), {}
    for r in sample.toLocalIterator():
        texts.setdefault(r.lang, []).append(symbols(r.passage + "\n", table))
    return _automata({k: np.concatenate(v) for k, v in texts.items()}, symbols_each, symbols_all)


def _automata(texts: dict[str, np.ndarray], each: int = TEXT, all_: int = TEXTS) -> Automata:
    names, roots, cost, made = [], [], [], 1
    rows, columns, values = [], [], []
    most = min(each, all_ // max(1, len(texts)))
    for name, text in sorted(texts.items()):
        text = text[:most]
        if not (text != 0).any():
            continue
        following = suffix_automaton(text.tolist())
        names.append(name)
        roots.append(made)
        cost.append(np.log2(len(text) + 1))
        for state, steps in enumerate(following, made):
            rows += [state] * len(steps)
            columns += steps.keys()
            values += [made + v for v in steps.values()]
        made += len(following)
    table = np.zeros((made, SYMBOLS), np.int32)
    table[rows, columns] = values
    return Automata(names, np.array(roots, np.int64), np.array(cost), table.ravel())


def phrases(segments: list[np.ndarray], model: Automata) -> np.ndarray:
    """How many longest matches with each language's text make up each segment.

    A phrase goes on while the automaton of the language has a transition, and the next
    begins at the symbol that had none; a symbol that the language lacks is a phrase. A
    state is the root only where no phrase is open.
    """
    sizes = np.array([len(s) for s in segments])
    order = np.argsort(-sizes, kind="stable")
    grid = np.zeros((len(segments), sizes.max(initial=0)), np.int32)
    for row, k in enumerate(order.tolist()):
        grid[row, : sizes[k]] = segments[k]
    grid = np.ascontiguousarray(grid.T)
    live = np.searchsorted(-sizes[order], -np.arange(grid.shape[0]), "left")
    roots = model.roots[:, None].astype(np.int32)
    state = np.repeat(roots, len(segments), axis=1)
    count = np.zeros(state.shape, np.int64)
    for t in range(grid.shape[0]):
        n = live[t]
        symbol = grid[t, :n]
        now = model.following[state[:, :n] * SYMBOLS + symbol]
        ended = now == 0
        count[:, :n] += ended | (state[:, :n] == roots)
        if ended.any():
            fresh = model.following[roots * SYMBOLS + symbol]
            now = np.where(ended, np.where(fresh == 0, roots, fresh), now)
        state[:, :n] = now
    out = np.empty_like(count)
    out[:, order] = count
    return out.T


def identify(docs: DataFrame, model: Automata) -> DataFrame:
    """`docs` with `lang_pred` and `score` for its whole text; replaces columns of these names.

    A text is cut into segments of SEGMENT symbols; each language's phrases for all of them,
    times the bits that name a place in the language's sample, are its cost. The least cost
    wins, the first name among equals. The score is the second least cost's share of both,
    0.5 to 1, and 1 for a single language. A text that is null or has no letter, or any text
    if no language was learned, is `und` with score 0. A row's result depends on its text alone,
    so repeated rows have the same; an empty table gives no row. No row moves; the automata, of at most
    two for each symbol learned, are broadcast.
    """
    docs = without(docs, ["lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(_identifier(shared), StructType([*docs.schema.fields, *added]))


def _identifier(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decide(texts: list[str | None], table: np.ndarray, model: Automata) -> list[tuple[str, float]]:
        found = [symbols(t or "", table) for t in texts]
        owner, segments = [], []
        for k, s in enumerate(found):
            if model.names and (s != 0).any():
                owner += [k] * len(range(0, len(s), SEGMENT))
                segments += [s[i : i + SEGMENT] for i in range(0, len(s), SEGMENT)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not segments:
            return out
        counts = phrases(segments, model)
        costs = np.stack([np.bincount(owner, c, len(texts)) for c in counts.T], axis=1) * model.cost
        for k in set(owner):
            first, *rest = np.argsort(costs[k], kind="stable").tolist()
            second = costs[k, rest[0]] if rest else None
            out[k] = (
                model.names[first],
                1.0 if second is None else float(second / (second + costs[k, first])),
            )
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = Automata(*shared.value), alphabet()
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
            rows = [r for a, b in slices(sizes, SLICE_BYTES) for r in decide(text[a:b].to_pylist(), table, model)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return run
