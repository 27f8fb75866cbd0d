"""SimHash near-duplicates, linked by a self-join of a binary trie."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quillon.llm import ngram_join
from quillon.llm.components import components
from quillon.llm.shared import bit_filter, col, may_hold, without, written
from quillon.llm.words import mixed, slices

#: Bytes of text fingerprinted at once; shingles summed in one go (16-bit counters).
SLICE_BYTES, LANE = 2 << 20, 32768

#: Rows of a block of the trie at most, about; fingerprints in a leaf; node pairs followed at
#: once.
BLOCK, LEAF, CHUNK = 32768, 32, 1 << 14

#: What tells the groups apart in which fingerprints are compared: a piece, blocks of its bits and
#: what they hold, and two parts of the rows of that.
GROUP = ("piece", "cut", "key", "x_part", "y_part")


class Links64(NamedTuple):
    """Texts link if their 64-bit fingerprints differ in at most `budget` bits."""

    budget: int = 4
    words: int = 1
    piece_bits: int = 64
    block: int = BLOCK

    @property
    def piece_budget(self) -> int:
        return self.budget


class Links256(NamedTuple):
    """Texts link if their 256-bit fingerprints differ in at most `budget` bits, and those of
    one of eight 32-bit pieces in at most `piece_budget`.

    Two sets of shingles with Jaccard similarity 0.8 differ in 39 of 256 bits on average (with a
    standard deviation of 6), and 99% of such pairs have a piece within 4; unrelated ones differ
    in 128. The budget is wide, as `one_of_each` compares what links by its shingles.
    """

    budget: int = 56
    words: int = 4
    piece_bits: int = 32
    block: int = BLOCK
    piece_budget: int = 4


def columns(rule: Links64 | Links256) -> list[str]:
    """The names of a fingerprint's 64-bit words."""
    return ["fingerprint"] if rule.words == 1 else [f"fingerprint{i}" for i in range(rule.words)]


def fingerprints(
    docs: DataFrame, *, shingle: int = 4, seed: int = 42, rule: Links64 | Links256 = Links64()
) -> DataFrame:
    """`docs` with the SimHash of its texts as `columns(rule)` (bigint), replacing columns of
    these names.

    Words are parted by ASCII white space, A-Z lowered. Shingles of `shingle` words, repeats
    included, joined by spaces (all words if there are fewer) are hashed by XXH64, from which
    further words of hash are mixed; a bit is 1 if it is set in more than half of the hashes.
    No words, or null: 0.
    """
    names = columns(rule)
    docs = without(docs, names)
    schema = StructType([*docs.schema.fields, *[StructField(n, LongType()) for n in names]])
    return docs.mapInArrow(_fingerprinter(shingle, seed, names), schema)


def _hashes(text: bytes | None, shingle: int, seed: int) -> list[int]:
    words = (text or b"").lower().split()
    if not words:
        return []
    data = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    starts, ends = [0, *[g + 1 for g in gaps]], [*gaps, len(data)]
    h = xxhash.xxh64_intdigest
    return [h(data[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)] or [h(data, seed)]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The majority bits of `counts` neighbouring hashes each; 0 for a count of 0."""
    pieces = np.maximum(1, -(-counts // LANE))
    owner = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(counts) - counts, pieces) + nth * LANE
    filled = np.flatnonzero(counts[owner] > 0)
    owner, starts = owner[filled], starts[filled]
    out = np.zeros(len(counts), np.uint64)
    if not len(starts):
        return out
    for k in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0001000100010001), starts)
        for j in range(4):
            ones = np.bincount(owner, ((lanes >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64), len(counts))
            out |= (2 * ones > counts).astype(np.uint64) << np.uint64(k + 16 * j)
    return out


def _fingerprinter(
    shingle: int, seed: int, names: list[str]
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
            prints = [[np.empty(0, np.uint64)] for _ in names]
            for a, b in slices(sizes, SLICE_BYTES):
                parts = [np.array(_hashes(t, shingle, seed), np.uint64) for t in text[a:b].cast(pa.binary()).to_pylist()]
                counts = np.array([len(p) for p in parts], np.int64)
                hashes = np.concatenate(parts)
                for i, out in enumerate(prints):
                    out.append(majorities(mixed(hashes + np.uint64(i)) if i else hashes, counts))
            marks = [pa.array(np.concatenate(out).view(np.int64)) for out in prints]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *marks], names=[*batch.schema.names, *names]
            )

    return run


class Trie:
    """A path-compressed binary trie over sorted fingerprints.

    A node is a range of them; `depth` is the length of the prefix all its members share.
    Nodes of at most LEAF members, or of equal ones, are not split.
    """

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        low, high = np.array([0]), np.array([len(prints)])
        lows, highs, lefts, made = [], [], [], 1
        while len(low):
            inner = (high - low > LEAF) & (prints[low] != prints[high - 1])
            left = np.full(len(low), -1)
            a, b = low[inner], high[inner]
            left[inner] = made + 2 * np.arange(len(a))
            made += 2 * len(a)
            lows.append(low)
            highs.append(high)
            lefts.append(left)
            bit = np.uint64(63) - _leading(prints[a] ^ prints[b - 1]).astype(np.uint64)
            split = np.searchsorted(prints, prints[b - 1] >> bit << bit)
            low = np.stack((a, split), axis=1).ravel()
            high = np.stack((split, b), axis=1).ravel()
        self.low, self.high, self.left = (np.concatenate(x) for x in (lows, highs, lefts))
        self.size = self.high - self.low
        self.first = prints[self.low]
        self.depth = _leading(self.first ^ prints[self.high - 1])


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bits."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return 64 - np.bitwise_count(x).astype(np.int64)


class Links:
    """Which of n members are connected so far; keeps an edge for each two parts joined.

    `parent` is a view of the roots that is renewed now and then, at a cost that the pairs
    looked at since then outweigh. What it shows as connected is; it may lag behind.

    With `groups`, members of equal ones are connected from the start; with `every`, all edges
    between different groups are kept, and connect nothing.
    """

    def __init__(self, n: int, groups: np.ndarray | None = None, every: bool = False) -> None:
        self.edges: list[tuple[int, int]] = []
        self.tree = list(range(n))
        if groups is not None and n:
            _, first, which = np.unique(groups, return_index=True, return_inverse=True)
            self.tree = first[which].tolist()
        self.looked, self.every = 0, every
        self._renew()

    def _renew(self) -> None:
        roots = np.array(self.tree, np.int64)
        while (roots != roots[roots]).any():
            roots = roots[roots]
        self.parent, self.tree, self.looked = roots, roots.tolist(), 0
        self.runs = np.cumsum(np.concatenate(([0], roots[1:] != roots[:-1])))

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        apart = self.parent[u] != self.parent[v]
        tree, before = self.tree, len(self.edges)
        if self.every:
            self.edges += zip(u[apart].tolist(), v[apart].tolist(), strict=True)
            return
        for i, j in zip(u[apart].tolist(), v[apart].tolist(), strict=True):
            a, b = i, j
            while tree[a] != a:
                a = tree[a]
            while tree[b] != b:
                b = tree[b]
            if a != b:
                tree[max(a, b)] = min(a, b)
                self.edges.append((i, j))
            tree[i] = tree[j] = min(a, b)
        self.looked += int(apart.sum()) + len(self.edges) - before
        if 8 * self.looked >= len(tree):
            self._renew()

    def uniform(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the members from low to high are all connected."""
        return self.runs[low] == self.runs[high - 1]

    def settled(self, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether ranges of members (low, high) need not be compared, as all are connected."""
        return self.uniform(*x) & self.uniform(*y) & (self.parent[x[0]] == self.parent[y[0]])


class Open(Links):
    """Which members are within the budgets of one of another group; ranges of which all are
    need no more pairs, so that a large group of close fingerprints costs its size."""

    def __init__(self, n: int, groups: np.ndarray) -> None:
        super().__init__(n, groups)
        self.marked, self.since = np.zeros(n, bool), 0
        self._count()

    def _count(self) -> None:
        self.left, self.since = np.cumsum(np.concatenate(([0], ~self.marked))), 0

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        ends = np.concatenate((u, v))[np.tile(self.parent[u] != self.parent[v], 2)]
        ends = np.unique(ends[~self.marked[ends]])
        self.marked[ends] = True
        self.since += len(ends)
        if 8 * self.since >= self.left[-1]:
            self._count()

    def settled(self, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        full = (self.left[x[0]] == self.left[x[1]]) & (self.left[y[0]] == self.left[y[1]])
        return full | super().settled(x, y)


class Members(NamedTuple):
    """Sorted pieces of fingerprints, and a row of all 64-bit words of each."""

    pieces: np.ndarray
    words: np.ndarray


def neighbours(
    a: Members,
    b: Members | None,
    piece_budget: int,
    budget: int,
    groups: np.ndarray | None = None,
    every: bool = False,
    may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    links: Links | None = None,
) -> list[tuple[int, int]]:
    """Edges that connect what is within both budgets between `a` and `b`, or within `a` if
    `b` is None; members of b count on from those of a. `groups` and `every`: see `Links`.
    Pairs that `may` rules out are left out. `links` takes the pairs instead, if given.

    Pairs of trie nodes are traversed together from the roots. The bits in which their
    shared prefixes differ are differences of all their members: beyond the budget of a piece
    the pair is pruned. It is also pruned if all members of both are connected already, so
    that a large group of close fingerprints costs no more than its links. Pairs of leaves
    are compared member by member.
    """
    sides = (a, a if b is None else b)
    one, two = Trie(a.pieces), Trie(sides[1].pieces)
    shift = 0 if b is None else len(a.pieces)
    words = a.words if b is None else np.concatenate((a.words, b.words))
    links = links or Links(len(words), groups, every)

    def near(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        close = np.bitwise_count(words[u] ^ words[v]).sum(axis=1, dtype=np.int64) <= budget
        if may is not None:
            close[close] = may(u[close], v[close])
        return close

    for k, side in enumerate(sides[: 1 if b is None else 2]):  # neighbours in order, first
        u = np.arange(len(side.pieces) - 1) + k * shift
        u = u[near(u, u + 1)]
        links.join(u, u + 1)
    stack = [(np.array([0]), np.array([0]))]
    while stack:
        x, y = stack.pop()
        if len(x) > CHUNK:
            stack.append((x[CHUNK:], y[CHUNK:]))
            x, y = x[:CHUNK], y[:CHUNK]
        depth = np.minimum(one.depth[x], two.depth[y])
        off = np.uint64(64) - np.maximum(depth, 1).astype(np.uint64)
        differ = np.bitwise_count((one.first[x] ^ two.first[y]) >> off)
        linked = links.settled((one.low[x], one.high[x]), (two.low[y] + shift, two.high[y] + shift))
        live = ((differ <= piece_budget) | (depth == 0)) & ~linked
        x, y = x[live], y[live]
        leaf_x, leaf_y = one.left[x] < 0, two.left[y] < 0
        both = leaf_x & leaf_y
        if both.any():
            _compare(one, two, x[both], y[both], piece_budget, shift, near, links)
        x, y, leaf_x, leaf_y = x[~both], y[~both], leaf_x[~both], leaf_y[~both]
        if not len(x):
            continue
        same = (x == y) if b is None else np.zeros(len(x), bool)
        left = ~leaf_x & (leaf_y | (one.size[x] >= two.size[y])) & ~same
        right = ~left & ~same
        p, q, s = one.left[x[left]], two.left[y[right]], one.left[x[same]]
        xs = [p, p + 1, x[right], x[right], s, s, s + 1]
        ys = [y[left], y[left], q, q + 1, s, s + 1, s + 1]
        stack.append((np.concatenate(xs), np.concatenate(ys)))
    return links.edges


def _compare(
    one: Trie, two: Trie, x: np.ndarray, y: np.ndarray, budget: int, shift: int, near: Callable, links: Links
) -> None:
    """Joins the members of pairs of leaves that are within the budgets, a bounded number of
    pairs at a time."""
    rows = one.size[x]
    pair = np.repeat(np.arange(len(x)), rows)
    u = one.low[x][pair] + np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    wide, low = two.size[y][pair], two.low[y][pair]
    done = np.concatenate(([0], np.cumsum(wide)))
    at = 0
    while at < len(u):
        to = max(at + 1, int(np.searchsorted(done, done[at] + 8 * CHUNK, "right")) - 1)
        many = wide[at:to]
        i = np.repeat(u[at:to], many)
        j = np.repeat(low[at:to], many) + np.arange(many.sum()) - np.repeat(done[at:to] - done[at], many)
        close = np.bitwise_count(one.prints[i] ^ two.prints[j]) <= budget
        i, j = i[close], j[close] + shift
        apart = links.parent[i] != links.parent[j]
        i, j = i[apart], j[apart]
        keep = near(i, j)
        links.join(i[keep], j[keep])
        at = to


def _members(table: pa.Table, names: list[str]) -> tuple[Members, Members | None, np.ndarray]:
    """The two parts of a group of `dealt`, the second None if it is one part or a part is
    empty, and the rows of both in order."""
    second, value, node = (table.column(c).to_numpy() for c in ("second", "value", "node"))
    words = np.stack([table.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
    order = np.lexsort((node, value.view(np.uint64)))
    parts = [order[second[order] == k] for k in (0, 1)]
    one, two = (Members(value[p].view(np.uint64), words[p]) for p in parts)
    return one, None if table.column("within")[0].as_py() else two, np.concatenate(parts)


def link(
    nodes: DataFrame, rule: Links64 | Links256, *, every: bool = False, percent: int | None = None
) -> DataFrame:
    """Edges (u, v) that connect those of `nodes` (node bigint, and `columns(rule)`) that
    link: for each group of GROUP a spanning forest.

    Rows are a few numbers each; a group emits fewer edges than it has members, never all
    pairs. If `nodes` has a column `grouped`, nodes with equal ones are taken as connected;
    with `every`, all links between different ones are given, each by one group. With
    `percent`, `nodes` have the `size` and `sketch` of sets, and pairs that these show to be less
    similar are no links.
    """
    names, choices = columns(rule), cuts(nodes.count(), rule)

    def compare(table: pa.Table) -> pa.Table:
        one, two, rows = _members(table, names)
        node, edges = table.column("node").to_numpy()[rows], []
        if len(one.pieces) and (two is None or len(two.pieces)):
            groups, may = None, None
            if "grouped" in table.column_names:
                groups = table.column("grouped").to_numpy()[rows]
            if percent is not None:
                sketches = table.column("sketch").combine_chunks().take(pa.array(rows))
                may = ngram_join.similar_sketches(table.column("size").to_numpy()[rows], sketches.to_pylist(), percent)
            edges = neighbours(one, two, rule.piece_budget, rule.budget, groups, every, may)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        if every and len(ends):
            ends = np.unique(np.sort(ends, axis=1), axis=0)
            words = one.words if two is None else np.concatenate((one.words, two.words))
            first = first_group(words[ends[:, 0]] ^ words[ends[:, 1]], choices, rule)
            ends = ends[first == (table.column("piece")[0].as_py() * len(choices) + table.column("cut")[0].as_py())]
        return pa.table({"u": node[ends[:, 0]], "v": node[ends[:, 1]]})

    return dealt(nodes, rule, choices).groupBy(*GROUP).applyInArrow(compare, "u bigint, v bigint")


def open_nodes(nodes: DataFrame, rule: Links64 | Links256) -> DataFrame:
    """(node): those of `nodes`, as `link` takes them, that link with one of another `grouped`."""
    names = columns(rule)

    def mark(table: pa.Table) -> pa.Table:
        one, two, rows = _members(table, names)
        node, grouped = (table.column(c).to_numpy()[rows] for c in ("node", "grouped"))
        links = Open(len(rows), grouped)
        if len(one.pieces) and (two is None or len(two.pieces)):
            neighbours(one, two, rule.piece_budget, rule.budget, links=links)
        return pa.table({"node": node[links.marked]})

    return dealt(nodes, rule).groupBy(*GROUP).applyInArrow(mark, "node bigint").distinct()


def first_group(differ: np.ndarray, choices: list[list[tuple[int, int]]], rule: Links64 | Links256) -> np.ndarray:
    """For pairs whose fingerprints differ in the bits `differ`, the first piece within its budget,
    times the number of cuts, plus the first cut in which that piece is equal."""
    out = np.full(len(differ), -1)
    pieces = list(differ.T)
    if rule.piece_bits == 32:
        pieces = [(w >> np.uint64(32) if s == 0 else w & np.uint64(0xFFFFFFFF)) << np.uint64(32) for w in differ.T for s in (0, 1)]
    for p, piece in enumerate(pieces):
        near = (np.bitwise_count(piece) <= rule.piece_budget) & (out < 0)
        for c, choice in enumerate(choices):
            mask = sum(((1 << w) - 1) << (64 - a - w) for a, w in choice)
            out = np.where(near & (out < 0) & (piece & np.uint64(mask) == 0), p * len(choices) + c, out)
    return out


def cuts(n: int, rule: Links64 | Links256) -> list[list[tuple[int, int]]]:
    """Choices of blocks (first bit, bits) of a piece, one of which is equal in any two pieces
    within the budget.

    A piece cut into budget + t blocks has t equal ones. t is 0 up to `rule.block` rows, one
    group then, and 1, or 2 where blocks of one would hold more rows: 1, 5 or 15 choices at
    a budget of 4, at any number of rows.
    """
    width, budget = rule.piece_bits, rule.piece_budget
    equal = 0 if n <= rule.block else 1 if n >> (width // (budget + 1)) <= rule.block else 2
    if not equal:
        return [[]]
    edges = [width * i // (budget + equal) for i in range(budget + equal + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(blocks, equal)]


def dealt(
    nodes: DataFrame, rule: Links64 | Links256, choices: list[list[tuple[int, int]]] | None = None
) -> DataFrame:
    """The rows of `nodes`, once for each group (columns GROUP) in which they are compared, with
    `value`, the piece, `second`, 1 for the second part of the group, and `within`, whether the
    group is one part that is compared with itself.

    Rows meet that are equal in one of `cuts`, so a row is sent as often as there are cuts of
    its pieces, however many rows there are, and a trie join finds the links of each group.
    Fingerprints need not be spread evenly. The rows of each group are counted, and one of more
    than twice `rule.block` is parted by a hash of the nodes, which are distinct, into parts of
    `rule.block` on average, of which each two are a group: none holds more than about four
    times `rule.block`, whatever the fingerprints are. A row of such a group is sent once for each
    of its parts.
    """
    names = columns(rule)
    pieces = [F.col(c) for c in names]
    if rule.piece_bits == 32:
        pieces = [p for c in pieces for p in (F.shiftright(c, 32), c)]
        pieces = [F.shiftleft(p, 32) for p in pieces]
    keys = []
    for choice in choices or cuts(nodes.count(), rule):
        key = F.lit(0).cast("bigint")
        for first, width in choice:
            block = F.shiftrightunsigned(F.shiftleft("value", first), 64 - width)
            key = F.shiftleft(key, width).bitwiseOR(block)
        keys.append(key)
    rows = nodes.select("*", F.posexplode(F.array(*pieces)).alias("piece", "value"))
    rows = rows.select("*", F.posexplode(F.array(*keys)).alias("cut", "key"))
    group = ("piece", "cut", "key")
    large = rows.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > 2 * rule.block)
    large = written(large.select(*group, F.ceil(F.col("n") / rule.block).cast("int").alias("parts")))
    rows = rows.join(large, list(group), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("their", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns(
        {
            "x_part": F.least("own", "their"),
            "y_part": F.greatest("own", "their"),
            "second": (F.col("own") > F.col("their")).cast("int"),
            "within": F.col("own") == F.col("their"),
        }
    ).drop("parts", "own", "their")


def _components(prints: DataFrame, first: Column, rule: Links64 | Links256, edges: Callable) -> DataFrame:
    """(node, first): the smallest `first` among the rows of `prints` reachable over `edges` of
    the nodes from those of that node."""
    names = columns(rule)
    one = prints.groupBy("node").agg(F.min(F.struct(*names)).alias("print"), F.min(first).alias("own"))
    nodes = written(one.select("node", "print.*", "own"))
    tied = written(components(edges(nodes.drop("own"))).withColumnRenamed("node", "tied"))
    groups = (
        tied.join(nodes, tied.tied == nodes.node).groupBy("root").agg(F.min("own").alias("least"))
    )
    moved = tied.join(groups, "root").select("tied", "least")
    return written(
        nodes.join(moved, nodes.node == moved.tied, "left").select(
            "node", F.coalesce("least", "own").alias("first")
        )
    )


def _prints(texts: DataFrame, shingle: int, seed: int, rule: Links64 | Links256) -> DataFrame:
    """Fingerprints without the texts, and the node of each: the fingerprint if it is one word,
    or else 64 bits of the name of the text's set of shingles, which is `set`."""
    names = columns(rule)
    if rule.words == 1:
        prints = fingerprints(texts, shingle=shingle, seed=seed, rule=rule)
        return written(prints.drop("text").withColumn("node", F.col(names[0])))
    texts = without(texts, names)
    others = [f for f in texts.schema.fields if f.name != "text"]
    added = [*[StructField(n, LongType()) for n in names], StructField("set", BinaryType()), StructField("node", LongType())]
    kept = [*[f.name for f in others], *names]
    add = _fingerprinter(shingle, seed, names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in ngram_join.text_sets(add(batches), shingle):
            marks = [ngram_join.node_of(s) for s in sets]
            nodes = [int.from_bytes(x[:8], "big", signed=True) for x in marks]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(marks, pa.binary()), pa.array(nodes, pa.int64())],
                schema=pa.schema([*[batch.schema.field(c) for c in kept], ("set", pa.binary()), ("node", pa.int64())]),
            )

    return written(texts.mapInArrow(run, StructType([*others, *added])))


def similar(
    nodes: DataFrame, texts: DataFrame, names: DataFrame, rule: Links256, shingle: int, percent: int
) -> DataFrame:
    """Edges (u, v) of `nodes` that link by `rule` and whose sets of shingles have
    100 * intersection >= percent * union, so many that they connect all that do.

    Candidates are a spanning forest of each group of the trie join, compared set by set. Nodes
    with a link beyond their component are joined again with a sketch of their sets, first a
    forest and then all links between what is still apart: only pairs whose sketches let them
    be so similar. So a large group of copies, similar enough or not, costs its links, and each
    edge is a pair that was compared. `names` has the `set` of each node, and `texts` the texts,
    which are read again for nodes with candidates.
    """
    found = ngram_join.different(link(nodes, rule))
    ends = found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node")))
    some = written(names.join(ends.distinct(), "node", "left_semi").select("set", "node").distinct())
    kept = ngram_join.kept_sets(texts, some.select(F.col("set").alias("node")), shingle)
    sets = written(kept.withColumnRenamed("node", "set").join(some, "set").select("node", "hashes", "sketch"))
    done, edges = found, written(ngram_join.verified(found, sets, percent))

    def grouped(nodes: DataFrame) -> DataFrame:
        roots = written(components(edges)).withColumnRenamed("node", "of")
        met = nodes.join(roots, F.col("node") == F.col("of"), "left")
        return met.withColumn("grouped", F.coalesce("root", "node")).drop("root", "of")

    now = nodes.join(sets.select("node"), "node", "left_semi")  # others have no candidate
    left = written(open_nodes(written(grouped(now)), rule))
    small = sets.select("node", F.floor(F.length("hashes") / 8).alias("size"), "sketch")
    now = written(now.join(left, "node", "left_semi").join(small, "node"))
    for every in (False, True):
        found = ngram_join.different(link(written(grouped(now)), rule, every=every, percent=percent))
        found = written(found.join(done, ["u", "v"], "left_anti"))
        edges = written(edges.unionByName(ngram_join.verified(found, sets, percent)))
        done = done.unionByName(found)
    return edges


def near_duplicates(
    docs: DataFrame, *, shingle: int = 4, seed: int = 42, rule: Links64 | Links256 = Links64()
) -> DataFrame:
    """(doc_id, `columns(rule)`, component_id) for each row of `docs` (doc_id, text).

    Texts are linked by `rule`; component_id is the smallest doc_id reachable over links, the
    row's own included. Null ids are larger than any; a component of null ids alone has
    component_id null. Repeated rows, and rows that share an id, each get a row. An empty
    table gives an empty result.
    """
    texts = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    prints = _prints(texts, shingle, seed, rule)
    whole = _components(prints, F.col("doc_id"), rule, lambda nodes: link(nodes, rule))
    return prints.join(whole, "node").select(
        "doc_id", *columns(rule), F.col("first").alias("component_id")
    )


def one_of_each(
    docs: DataFrame, *, shingle: int = 5, seed: int = 42, rule: Links256 = Links256(), percent: int = 80
) -> DataFrame:
    """The rows of `docs` that stay when each group of linked texts keeps one row.

    Texts link if `rule` links their fingerprints and their sets of shingles, words as in
    `fingerprints`, have 100 * intersection >= `percent` * union (`similar`), and if the sets are
    equal; texts without words have equal ones. Texts of any length are taken whole.

    The row with the smallest doc_id stays, null being larger than any; among rows of that
    id, the one with the smallest hash of all columns; of rows equal in all columns, one. All
    columns are kept as they are.

    Fingerprints are taken once, without the other columns. The rows to drop, and those to
    take once of several equal ones, are told by id and hash: a filter of a fixed greatest
    size lets most other rows pass where they lie, so that the texts that move are about
    those of the copies, as long as the filter is not full (`shared.FILTER_BITS`).
    """
    names = [col(c) for c in docs.columns]
    rows = docs.select(
        F.struct(*names).alias("row"),
        F.struct(
            col("doc_id").isNull().alias("none"),
            col("doc_id").alias("doc_id"),
            F.xxhash64(*names).alias("mark"),
        ).alias("name"),
    )
    texts = rows.select("name", F.col("row.text").cast("string").cast("binary").alias("text"))
    prints = _prints(texts, shingle, seed, rule)
    whole = _components(
        prints, F.col("name"), rule, lambda nodes: similar(nodes, texts.select("text"), prints, rule, shingle, percent)
    )
    named = prints.groupBy("node", "name").agg(F.count("*").alias("n")).join(whole, "node")
    first = F.col("name") == F.col("first")
    told = written(named.where(~first | (F.col("n") > 1)).select("name", first.alias("once")))
    name = F.col("name")
    marked = may_hold(rows, name, bit_filter(told, name))
    dropped = told.where(~F.col("once"))
    maybe = marked.where("maybe")
    kept = maybe.join(dropped, _same(maybe, dropped), "left_anti").dropDuplicates(["name"])
    return marked.where(~F.col("maybe")).unionByName(kept).select("row.*")


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Equal names, null ids being equal; part by part, as Spark joins by parts."""
    return (a["name"]["mark"] == b["name"]["mark"]) & a["name"]["doc_id"].eqNullSafe(b["name"]["doc_id"])
