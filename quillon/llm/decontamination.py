"""Benchmark decontamination by suffix arrays over the training text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quillon.llm.shared import col, file_system, shared_folder, without, written
from quillon.llm.words import LETTERS_DIGITS, WordHasher, slices

#: Bytes of training text in a shard, words in one suffix array, and bytes of benchmark
#: text that are searched at once. A task holds a shard and a block of the benchmark.
SHARD_BYTES, ARRAY_WORDS, BLOCK_BYTES = 2 << 20, 1 << 19, 2 << 20
#: Pairs of equal places in text and benchmark that are compared at once.
PAIRS = 1 << 20

SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
MATCH = StructType(
    [
        StructField("item_id", StringType()),
        StructField("place", LongType()),
        StructField("start", LongType()),
        StructField("length", LongType()),
    ]
)
FOUND = [
    StructField("n_words", LongType()),
    StructField("hits", ArrayType(SPAN)),
    StructField("items", ArrayType(StringType())),
    StructField("matches", ArrayType(MATCH)),
]
ADDED = tuple(f.name for f in FOUND)


def find_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """Where the texts of `docs` hold passages of `benchmark` (item_id, text) verbatim.

    Both are taken as words of letters and digits, A-Z lowered; null has none. A passage
    is `window` words of an item, or a whole item of fewer words. Adds

    - n_words: the words of the text;
    - hits: the runs [start, end) of words that lie in any occurrence of a passage, apart
      and in order; matches that overlap or adjoin are one run;
    - items: ids of the items with a passage that occurs, as strings, sorted; an item
      without id marks words but is not listed;
    - matches: for each item and each place in it where a longest match begins, that is, a
      run of a passage or more that can be extended to neither side, the longest there as
      (item_id, place, start, length) in words, from the first place of the text that has
      it. Distinct and in order. Items that share an id, or have none, are not told apart.

    Columns of these names in `docs` are replaced; all others are kept. A row's result
    depends on its text alone, so repeated rows and ids need no care. A very long text is a
    shard of its own. An empty benchmark hits nothing, an empty `docs` gives no row. Words
    are compared by 64-bit hashes, their texts are not.

    No row moves: each task cuts its rows into shards, orders the suffixes of a shard's
    words by their first `window` words, and finds every suffix of every item in that
    order by binary search, equal beginnings once; the beginnings it finds are extended in
    text and item to their longest match. The benchmark is prepared in tasks and written in
    blocks of at most twice BLOCK_BYTES of text (or one item, if that is longer), which
    the searching tasks read one after another; the blocks' sizes are checked before.
    """
    docs = without(docs, ADDED)
    folder = _write_blocks(benchmark, window)
    return docs.mapInArrow(_searcher(folder, window), StructType([*docs.schema.fields, *FOUND]))


def _write_blocks(benchmark: DataFrame, window: int) -> str:
    """The folder of the benchmark's blocks, one row each; only sizes come to the driver."""
    items = written(
        benchmark.where(col("text").isNotNull())
        .select(
            col("item_id").cast("string").alias("item_id"), col("text").cast("string").alias("text")
        )
        .distinct()
    ).withColumn("size", F.octet_length("text").cast("bigint"))
    sizes = items.agg(F.sum("size").alias("all"), F.max("size").alias("longest")).first()
    bound = max(2 * BLOCK_BYTES, sizes.longest or 0)
    n = max(1, math.ceil((sizes.all or 0) / BLOCK_BYTES))
    while n > 1:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        if items.groupBy(block).agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= bound:
            break
        n *= 2
    folder = shared_folder(benchmark.sparkSession)
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).groupBy("block").applyInArrow(
        lambda part: _prepared(part, window), BLOCK
    ).write.parquet(folder)
    return folder


#: A block: ids of its items; the hashes of all words, items parted by EDGE; where each item
#: begins; the places of passages, equal ones side by side; and where each run of equals begins.
ARRAYS = ("letters", "firsts", "places", "runs")
BLOCK = "ids array<string>, letters binary, firsts binary, places binary, runs binary"
#: Stands before and after every item; 0 stands between texts.
EDGE = np.uint64(1)


def _prepared(part: pa.Table, window: int) -> pa.Table:
    """A block from its items (item_id, text); no row if they have no word."""
    schema = pa.schema([("ids", pa.list_(pa.string())), *[(c, pa.binary()) for c in ARRAYS]])
    hasher = WordHasher()
    parted = [hasher(t.as_py().encode().translate(LETTERS_DIGITS))[2] for t in part["text"]]
    names = part["item_id"].to_pylist()
    ids, words = [i for i, w in zip(names, parted, strict=True) if len(w)], [w for w in parted if len(w)]
    if not words:
        return schema.empty_table()
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.full(1 + sizes.sum() + len(words) + window, EDGE)
    firsts = 1 + np.cumsum(sizes + 1) - sizes - 1
    places, passages = [], []
    for w, first in zip(words, firsts.tolist(), strict=True):
        letters[first : first + len(w)] = w
        n = max(1, len(w) - window + 1)
        at = np.arange(first, first + n)
        rows = letters[at[:, None] + np.arange(window)]
        rows[:, len(w) :] = 0  # an item shorter than a window
        places.append(at)
        passages.append(rows)
    at, rows = np.concatenate(places), np.concatenate(passages)
    same = np.unique(rows.view(f"V{8 * window}").ravel(), return_inverse=True)[1]
    order = np.lexsort((letters[at - 1], same))
    same = same[order]
    runs = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
    arrays = [a.tobytes() for a in (letters, firsts, at[order], runs)]
    return pa.Table.from_pylist([{"ids": ids, **dict(zip(ARRAYS, arrays, strict=True))}], schema)


@dataclass
class Block:
    """A block of the benchmark as the search needs it."""

    ids: list[str | None]
    letters: np.ndarray
    firsts: np.ndarray
    places: np.ndarray
    runs: np.ndarray
    window: int
    ends: np.ndarray = field(init=False)
    sizes: np.ndarray = field(init=False)
    before: np.ndarray = field(init=False)
    keys: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.ends = np.append(self.runs[1:], len(self.places))
        first = self.places[self.runs]
        lengths = np.diff(np.append(self.firsts, len(self.letters) - self.window)) - 1
        self.sizes = np.minimum(lengths[self.item(first)], self.window)
        # places of a run are in the order of the word before them
        self.before, rank = np.unique(self.letters[self.places - 1], return_inverse=True)
        run = np.repeat(np.arange(len(self.runs)), self.ends - self.runs)
        self.keys = run * len(self.before) + rank

    def item(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, "right") - 1

    def pairs(self, which: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(k, place), about PAIRS at a time, for each k-th occurrence, of the run `which[k]` of
        equal passages and with the word `before[k]` before it, and each place of that run with
        another word before it: where a match cannot be extended to the left."""
        rank = np.minimum(np.searchsorted(self.before, before), len(self.before) - 1)
        key = which * len(self.before) + rank
        low = np.searchsorted(self.keys, key)
        high = np.where(self.before[rank] == before, np.searchsorted(self.keys, key, "right"), low)
        n = self.ends[which] - self.runs[which] - (high - low)
        live = np.flatnonzero(n)
        for a, b in slices(n[live].tolist(), PAIRS):
            some = live[a:b]
            k = np.repeat(some, n[some])
            at = self.runs[which[k]] + np.arange(len(k)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            yield k, self.places[at + np.where(at >= low[k], high[k] - low[k], 0)]


def _blocks(folder: str, window: int) -> Iterator[Block]:
    system, path = file_system(folder)
    for info in sorted(system.get_file_info(pyarrow.fs.FileSelector(path)), key=lambda f: f.path):
        if info.base_name.startswith(("_", ".")) or not info.is_file:
            continue
        with system.open_input_file(info.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                for row in batch.to_pylist():
                    letters = np.frombuffer(row["letters"], np.uint64)
                    numbers = [np.frombuffer(row[c], np.int64) for c in ARRAYS[1:]]
                    yield Block(row["ids"], letters, *numbers, window)


class Benchmark:
    """The blocks of a folder, one after another as often as asked; kept if they are small."""

    #: Words kept at most.
    KEPT = 1 << 21

    def __init__(self, folder: str, window: int) -> None:
        self.folder, self.window, self.kept = folder, window, None

    def __iter__(self) -> Iterator[Block]:
        if self.kept is not None:
            yield from self.kept
            return
        kept, size = [], 0
        for block in _blocks(self.folder, self.window):
            size += len(block.letters)
            kept = [*kept, block] if size <= self.KEPT else []
            yield block
        if size <= self.KEPT:
            self.kept = kept


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in the order of their first `depth` ranks; ranks are 0 to n."""
    known, order = 1, None
    while known < depth:
        steps = [known] if 2 * known >= depth else [known, 2 * known]
        steps[-1] = min(steps[-1], depth - known)
        bits = int(ranks.max(initial=0) + 1).bit_length()
        if bits * (len(steps) + 1) > 63:
            steps = [min(known, depth - known)]
        key = ranks.astype(np.int64)
        for s in steps:
            key <<= bits
            key[: len(ranks) - s] += ranks[s:] + 1
        order = np.argsort(key)
        key = key[order]
        ranks = np.empty(len(key), np.int64)
        ranks[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))[: len(key)])
        known += steps[-1]
    return np.argsort(ranks) if order is None else order


def locate(ranks: np.ndarray, order: np.ndarray, wanted: np.ndarray, sizes: np.ndarray):
    """Binary search of every row of `wanted` among the suffixes.

    Gives per row the range of suffixes that begin with it (empty if none does) and the
    length of its longest prefix that some suffix begins with.
    """
    low = np.zeros(len(wanted), np.int64)
    high = np.full(len(wanted), len(order), np.int64)
    longest = np.zeros(len(wanted), np.int64)
    padded = np.concatenate((ranks, np.full(wanted.shape[1], -1, ranks.dtype)))
    for d in range(wanted.shape[1]):
        live = np.flatnonzero((low < high) & (sizes > d))
        if not len(live):
            break
        letter = wanted[live, d]

        def bound(after: bool, live=live, letter=letter, d=d) -> np.ndarray:
            a, b = low[live], high[live]
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                at = padded[order[np.minimum(mid, len(order) - 1)] + d]
                right = open_ & ((at <= letter) if after else (at < letter))
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            return a

        first, last = bound(False), bound(True)
        low[live], high[live] = first, last
        longest[live[first < last]] = d + 1
    return low, high, longest


def _occurrences(known: np.ndarray, ranks: np.ndarray, order: np.ndarray, block: Block):
    """Occurrences (word, run of equal passages) of a block's passages in one run of words."""
    at = np.minimum(np.searchsorted(known, block.letters), len(known) - 1)
    rank = np.where(known[at] == block.letters, at, -2)  # no suffix has a -2
    wanted = rank[block.places[block.runs][:, None] + np.arange(block.window)]
    low, high, _ = locate(ranks, order, wanted, block.sizes)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    skip = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return order[np.repeat(low, n) + skip], which


def _extended(letters: np.ndarray, at: np.ndarray, block: Block, places: np.ndarray, sizes: np.ndarray):
    """How many words are equal from each `at` of the text and each place of the block on; `sizes`
    are known to be. Every text and every item ends with a word that the other never has."""
    lengths, open_ = sizes.copy(), np.arange(len(at))
    while len(open_):
        n = lengths[open_]
        open_ = open_[letters[at[open_] + n] == block.letters[places[open_] + n]]
        lengths[open_] += 1
    return lengths


#: Per item id and place, the longest match there: its length, and minus its start.
Longest = dict[tuple[str | None, int], tuple[int, int]]


def _shard(texts: list[str | None], benchmark: Iterable[Block], window: int, hasher: WordHasher):
    """Per text: its number of words, the mask of its hit words, and its longest matches."""
    data = [(t or "").encode().translate(LETTERS_DIGITS) for t in texts]
    starts, _, hashes = hasher(b" ".join(data))
    begins = np.cumsum([0] + [len(x) + 1 for x in data])
    owner = np.searchsorted(begins, starts, "right") - 1
    counts = np.bincount(owner, minlength=len(texts))
    letters = np.zeros(len(hashes) + len(texts), np.uint64)
    letters[np.arange(len(hashes)) + owner] = hashes  # a 0 after each text
    firsts = np.cumsum(counts + 1) - counts - 1
    marks = np.zeros(len(letters) + 1, np.int32)
    matches: list[Longest] = [{} for _ in texts]
    for a in range(0, len(letters), ARRAY_WORDS):
        known, ranks = np.unique(letters[a : a + ARRAY_WORDS + window - 1], return_inverse=True)
        order = suffix_array(ranks, window)
        for block in benchmark:
            at, which = _occurrences(known, ranks, order, block)
            at += a
            np.add.at(marks, at, 1)
            np.add.at(marks, at + block.sizes[which], -1)
            for k, places in block.pairs(which, np.where(at > 0, letters[at - 1], 0)):
                lengths = _extended(letters, at[k], block, places, block.sizes[which[k]])
                text = np.searchsorted(firsts, at[k], "right") - 1
                _keep_longest(matches, text, at[k] - firsts[text], lengths, block, places)
    hit = np.cumsum(marks)[:-1] > 0
    return counts, [hit[f : f + n] for f, n in zip(firsts, counts, strict=True)], matches


def _keep_longest(matches: list[Longest], text, start, length, block: Block, places) -> None:
    order = np.lexsort((start, -length, places, text))
    text, start, length, places = text[order], start[order], length[order], places[order]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (places[1:] != places[:-1]))))
    item = block.item(places[new])
    rows = (text[new], item, places[new] - block.firsts[item], length[new], -start[new])
    for t, i, place, *found in zip(*(x.tolist() for x in rows), strict=True):
        key, found = (block.ids[i], place), tuple(found)
        if found > matches[t].get(key, (0, 0)):
            matches[t][key] = found


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _searcher(folder: str, window: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    match = pa.struct(
        [("item_id", pa.string()), ("place", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]
    )

    def listed(longest: Longest) -> list[dict]:
        rows = sorted(longest.items(), key=lambda x: (x[0][0] is not None, x[0][0] or "", x[0][1]))
        return [
            {"item_id": i, "place": p, "start": -start, "length": n} for (i, p), (n, start) in rows
        ]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark, hasher = Benchmark(folder, window), WordHasher()
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
            for a, b in slices(sizes, SHARD_BYTES):
                counts, hits, matches = _shard(text[a:b].to_pylist(), benchmark, window, hasher)
                items = [sorted({i for i, _ in m if i is not None}) for m in matches]
                columns = [
                    *batch.slice(a, b - a).columns,
                    pa.array(counts, pa.int64()),
                    pa.array([_runs(h) for h in hits], pa.list_(span)),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array([listed(m) for m in matches], pa.list_(match)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *ADDED])

    return search
