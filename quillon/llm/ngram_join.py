"""Jaccard self-join of word n-gram sets by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.shared import col, written
from quillon.llm.words import WordHasher, mixed, slices

#: Sets link if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Second-level parts, of which one is left out of each signature.
SECOND = 3
#: How often a set that is too thin for a partition of the domain goes on to another one.
LEVELS = 8

#: Bytes of text taken at once, signatures of a block, and those of a bucket, about.
SLICE_BYTES, BLOCK, BUCKET = 1 << 20, 1 << 20, 1 << 19
#: A signature more frequent in a block is led there by one of its sets. One in so many of the
#: signatures of three sets or more has all of them compared with a leader at first.
LED, LED_PART = 32, 8
#: Documents sampled for common shingles, in how many of them a shingle is common, and most such.
SAMPLE, COMMON, MOST_COMMON = 4096, 8, 1 << 16
#: Members of a group that are compared with each other at once, counters of a sketch, pairs of
#: sketches compared at once, and bits of the filter of members.
PART, SKETCH, SKETCHED, FILTER_BITS = 512, 256, 1 << 13, 27

#: Bytes as they are but for A-Z, lowered, and white space, made spaces.
SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes | None], hasher: WordHasher, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    data = [(t or b"").translate(SPACED) for t in texts]
    starts, _, h = hasher(b" ".join(data))
    begins = np.cumsum([0] + [len(x) + 1 for x in data])
    owner = np.searchsorted(begins, starts, "right") - 1
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    odd = _odd(size, 11)
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        rolled += h[j : j + len(rolled)] * odd[j]
    rolled = mixed(rolled)
    out = []
    for a, n in zip(first.tolist(), counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(rolled[a : a + n - size + 1]))
        elif n:
            out.append(mixed((h[a : a + n] * odd[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(hashes: np.ndarray) -> bytes:
    """16 bytes that name a set: a hash of its shingles' hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def most_apart(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The most elements in which two sets of `total` elements together may differ and link."""
    return total - 2 * -(-percent * total // (100 + percent))


class Bands(NamedTuple):
    """Bands of sizes, and for each the elements in which a set of it and one at least as large
    may differ and link. Links join sets of one band or of neighbours."""

    low: np.ndarray
    high: np.ndarray
    apart: np.ndarray


def bands(largest: int, percent: int) -> Bands:
    low, high, apart, at = [], [], [], 1
    while at <= largest:
        to = 100 * at // percent
        low.append(at)
        high.append(to)
        top = to + 100 * to // percent
        apart.append(max(most_apart(t, percent) for t in range(max(2, top - 12), top + 1)))
        at = to + 1
    return Bands(*(np.array(x, np.int64) for x in (low, high, apart)))


def signatures(
    sets: list[np.ndarray], table: Bands, common: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (64 bits) and the set that each is of.

    A set signs for its own band and, if it may link with smaller ones, for the band below. For
    a band within `apart` elements the domain of shingles is cut by a hash into first-level
    parts, more than (apart + 1) / 2 of them by `slack`, and each into SECOND. So in more than
    `slack` of the first-level parts two sets that link differ in one element at most, and agree
    in all second-level parts but one: each choice of SECOND - 1 of them gives a signature.

    A choice that holds no element of the set is not signed, as all sets without would meet. A
    set with empty choices in at most `slack` parts needs none of them. Of two sets that link and
    share no signature both are thinner, so such sets sign again for another cut, and so on; in
    the last one empty choices are signed too. The first cut leaves out `common` shingles: what
    differs elsewhere is within the same bound, and no signature is made of common ones alone.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(table.low, sizes, "right") - 1
    whole = [np.array([i for i in range(len(sets)) if sizes[i]], np.int64)]
    below = whole[0][band[whole[0]] > 0]
    whole.append(below[sizes[below] <= 100 * table.high[band[below] - 1] // percent])
    found = []
    for step, members in enumerate(whole):
        for level in range(LEVELS):
            members = members[table.apart[band[members] - step] > 0]  # equal sets are one node
            if not len(members):
                break
            sig, of, thin = _signed([sets[i] for i in members], band[members] - step, table, common, level)
            found.append((sig, members[of]))
            members = members[thin]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _signed(
    sets: list[np.ndarray], band: np.ndarray, table: Bands, common: np.ndarray, level: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures for one cut, the set that each is of, and which sets are too thin for it."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if level == 0 and len(common):
        rare = common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] != flat
        flat, owner = flat[rare], owner[rare]
    base = (table.apart[band] + 2) // 2
    slack = (base + 4) // 8
    parts = base + slack
    first = np.cumsum(parts) - parts
    salt = mixed(np.uint64(1 + level) + (band.astype(np.uint64) << np.uint64(8)))
    u = mixed(flat ^ salt[owner])
    low, half = u & np.uint64(0xFFFFFFFF), np.uint64(32)
    part = first[owner] + ((low * parts[owner].astype(np.uint64)) >> half).astype(np.int64)
    cell = part * SECOND + (((u >> half) * np.uint64(SECOND)) >> half).astype(np.int64)
    n_cells = int(parts.sum()) * SECOND
    value = ((u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(22)).astype(np.float64)  # exact in sums of 2**11
    count, total = (np.bincount(cell, x, n_cells).astype(np.int64).reshape(-1, SECOND) for x in (None, value))
    count, total = (x.sum(axis=1, keepdims=True) - x for x in (count, total))  # without one second-level part
    of_part = np.repeat(np.arange(len(sets)), parts)
    empty = count == 0
    thin = np.bincount(of_part, empty.any(axis=1), len(sets)) > slack
    at = (np.arange(len(of_part)) - first[of_part])[:, None] * SECOND + np.arange(SECOND)
    sig = mixed(total.astype(np.uint64) ^ mixed(salt[of_part][:, None] + at.astype(np.uint64)))
    signed = ~empty if level < LEVELS - 1 else np.ones(empty.shape, bool)
    return sig[signed], np.broadcast_to(of_part[:, None], sig.shape)[signed], thin


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Elements by the last bits of their hashes, 255 at most: the differences of two sketches
    add up to no more than the elements in which the sets differ."""
    counts = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.minimum(counts, 255).astype(np.uint8)


def similar_sketches(sizes: np.ndarray, sketches: list[bytes], percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells which pairs (u, v) of sets may link, by their sizes and sketches."""
    counts = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sizes), SKETCH).astype(np.int16)

    def may(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = 100 * np.minimum(sizes[u], sizes[v]) >= percent * np.maximum(sizes[u], sizes[v])
        at = np.flatnonzero(out)
        for some in np.split(at, range(SKETCHED, len(at), SKETCHED)):
            a, b = u[some], v[some]
            out[some] = np.abs(counts[a] - counts[b]).sum(axis=1) <= most_apart(sizes[a] + sizes[b], percent)
        return out

    return may


def text_sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hasher = WordHasher()
    for batch in batches:
        text = batch.column("text")
        sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
        for a, b in slices(sizes, SLICE_BYTES):
            yield batch.slice(a, b - a), shingle_sets(text[a:b].to_pylist(), hasher, size)


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _printer(size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in text_sets(batches, size):
            yield _batch(
                doc_id=batch.column("doc_id"),
                n_shingles=pa.array([len(s) for s in sets], pa.int64()),
                node=pa.array([node_of(s) for s in sets], pa.binary()),
            )

    return run


def _exploder(size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in text_sets(batches, size):
            yield _batch(shingle=pa.array(np.concatenate(sets).view(np.int64)))

    return run


PACKED = "bucket int, base bigint, entries binary, leaders binary, nodes binary"


def _signer(size: int, table: Bands, common: np.ndarray, percent: int, buckets: int) -> Callable:
    """Signatures packed by bucket. Sets are numbered in the task; a row without bucket has the
    nodes of its numbers. An entry is the signature's last 40 bits and 24 of a number."""

    def block(held: list[tuple[np.ndarray, np.ndarray]], nodes: list[bytes], base: int) -> Iterator[pa.RecordBatch]:
        rows = [(None, base, None, None, b"".join(nodes))]
        key, of = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket = (key >> np.uint64(40)) % np.uint64(buckets)
        key = (bucket << np.uint64(40)) | (key & np.uint64((1 << 40) - 1))
        order = np.argsort(key, kind="stable")
        key, of, bucket = key[order], of[order], bucket[order]
        del order
        entry = (key << np.uint64(24)) | of  # without the bucket's bits
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(start, len(key)))
        large = np.repeat(length > LED, length)
        leader = np.repeat(of[start], length)
        kept = ~large
        kept[start] = True
        for few in (True, False):
            mine = np.flatnonzero(kept if few else large)
            for chosen in np.split(mine, np.flatnonzero(np.diff(bucket[mine])) + 1) if len(mine) else ():
                led = None if few else leader[chosen].tobytes()
                rows.append((int(bucket[chosen[0]]), base, entry[chosen].tobytes(), led, None))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        names = ("bucket", "base", "entries", "leaders", "nodes")
        columns = zip(names, kinds, zip(*rows, strict=True), strict=True)
        yield _batch(**{n: pa.array(c, k) for n, k, c in columns})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, nodes, known, held, n = TaskContext.get().partitionId() << 40, [], set(), [], 0
        for _, sets in text_sets(batches, size):
            fresh = []
            for s in sets:
                if len(s) and (node := node_of(s)) not in known:  # copies are one
                    known.add(node)
                    nodes.append(node)
                    fresh.append(s)
            sig, of = signatures(fresh, table, common, percent)
            held.append((sig, (of + (len(nodes) - len(fresh))).astype(np.uint32)))
            n += len(sig)
            if n >= BLOCK or len(nodes) >= 1 << 23:
                yield from block(held, nodes, base)
                base, nodes, known, held, n = base + len(nodes), [], set(), [], 0
        if nodes:
            yield from block(held, nodes, base)

    return run


MEMBERS = "signature bigint, member bigint, leader bigint, node binary"


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed rows in order of buckets: the members of each signature that three sets or more
    share; pairs (member, leader), which are those of signatures that two share, and some of the
    others'; and the node of each number."""

    def out(signature, member, leader) -> pa.RecordBatch:
        columns = dict(signature=signature, member=member, leader=leader)
        arrays = {k: pa.nulls(len(member), pa.int64()) if x is None else pa.array(x) for k, x in columns.items()}
        return _batch(**arrays, node=pa.nulls(len(member), pa.binary()))

    def pairs(member: np.ndarray, leader: np.ndarray) -> pa.RecordBatch:
        both = np.unique(np.stack((member, leader), axis=1)[member != leader], axis=0)
        return out(None, both[:, 0], both[:, 1])

    def shared(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        entries = [np.frombuffer(e, np.uint64) for _, e in held]
        member = np.repeat([b for b, _ in held], [len(e) for e in entries])
        entry = np.concatenate(entries)
        member = member + (entry & np.uint64((1 << 24) - 1)).astype(np.int64)
        key = entry >> np.uint64(24)
        order = np.argsort(key, kind="stable")
        key, member = key[order], member[order]
        same = key[1:] == key[:-1]
        some = np.concatenate((same, [False])) | np.concatenate(([False], same))
        key, member = key[some], member[some]
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(start, len(key)))
        turn = np.lexsort((mixed(member.astype(np.uint64)), np.repeat(np.arange(len(start)), length)))
        leader = np.repeat(member[turn[start]], length)
        two = np.repeat(length == 2, length)
        compared = two | (key % np.uint64(LED_PART) == 0)
        yield pairs(member[compared], leader[compared])
        yield out((key[~two] | np.uint64(bucket << 40)).view(np.int64), member[~two], None)

    bucket, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["nodes"] is not None:
                names = [row["nodes"][i : i + 16] for i in range(0, len(row["nodes"]), 16)]
                none = pa.nulls(len(names), pa.int64())
                member = pa.array(np.arange(len(names)) + row["base"])
                yield _batch(signature=none, member=member, leader=none, node=pa.array(names, pa.binary()))
                continue
            if row["bucket"] != bucket:
                if held:
                    yield from shared(bucket, held)
                bucket, held = row["bucket"], []
            if row["leaders"] is None:
                held.append((row["base"], row["entries"]))
            else:
                entry = np.frombuffer(row["entries"], np.uint64)
                member = (entry & np.uint64((1 << 24) - 1)).astype(np.int64) + row["base"]
                leader = np.frombuffer(row["leaders"], np.uint32).astype(np.int64) + row["base"]
                key = (entry >> np.uint64(24)) | np.uint64(bucket << 40)
                compared = key % np.uint64(LED_PART) == 0
                yield pairs(member[compared], leader[compared])
                yield out(key.view(np.int64), member, None)
    if held:
        yield from shared(bucket, held)


def _common(docs: DataFrame, n: int, size: int) -> np.ndarray:
    """Sorted hashes of shingles that COMMON of about SAMPLE documents hold, MOST_COMMON at most.

    They only say which shingles the first cut does without: the links found do not depend on them.
    """
    scale = 1 << 30
    rate = min(scale, SAMPLE * scale // max(1, n))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < rate)
    counts = sample.mapInArrow(_exploder(size), "shingle bigint").groupBy("shingle").count()
    found = counts.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON)
    return np.sort(np.array([r.shingle for r in found.select("shingle").collect()], np.int64).view(np.uint64))


def jaccard_links(docs: DataFrame, *, shingle: int = 5, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(prints, edges) of `docs` (doc_id, text): (doc_id, n_shingles, node) of each row, and
    edges (u, v) of nodes that connect all that links.

    A node is a set of shingles, so copies are one. Pairs are found by PartEnum signatures and
    each edge is a pair whose sets were compared. Members of a signature are first compared with
    one of them; where that leaves several components in a group of three or more, once with
    another of them; and then those of different components with each other, unless their
    sketches or sizes show that they differ too much. So a group of near copies costs its size,
    and no two nodes that link stay in different components.
    """
    docs = docs.select(col("doc_id").alias("doc_id"), col("text").cast("string").cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    prints = written(docs.mapInArrow(_printer(shingle), f"doc_id {kind}, n_shingles bigint, node binary"))
    told = prints.agg(F.count("*"), F.max("n_shingles"), F.sum("n_shingles")).first()
    table = bands(told[1] or 0, percent)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 23, max(parts, (told[2] or 0) // BUCKET))
    signer = _signer(shingle, table, _common(docs, told[0], shingle), percent, buckets)
    spread = F.coalesce(F.col("bucket").cast("bigint"), F.xxhash64("base"))
    packed = docs.mapInArrow(signer, PACKED).repartition(parts, spread).sortWithinPartitions("bucket")
    found = written(packed.mapInArrow(_members, MEMBERS))

    names = found.where("node is not null").select("node", F.col("member").alias("number"))
    names = written(names.withColumn("one", F.min("number").over(Window.partitionBy("node"))))
    members = found.where("signature is not null").select("signature", F.col("member").alias("number"))
    pairs = _renamed(found.where("leader is not null").select("member", "leader").distinct(), names)
    some = members.select("number").distinct().join(names, "number").select("one", "node")
    some = some.unionByName(pairs.join(names, F.col("u") == F.col("one")).select("one", "node"))
    some = some.unionByName(pairs.join(names, F.col("v") == F.col("one")).select("one", "node"))
    some = written(some.distinct())
    sets = written(kept_sets(docs, some, shingle).join(some, "node").withColumnsRenamed({"node": "name", "one": "node"}))

    done, edges = pairs, written(verified(pairs, sets, percent))
    members = written(members.join(names.select("number", "one"), "number").select("signature", "one"))
    for last in (False, True):
        groups = _open_groups(members, edges)
        rest = (_apart if last else _led)(groups, sets, percent).join(done, ["u", "v"], "left_anti")
        rest = written(rest)
        edges = written(edges.unionByName(verified(rest, sets, percent)))
        done = done.unionByName(rest)
    node = sets.select("node", "name")
    named = edges.join(node, F.col("u") == F.col("node")).select(F.col("name").alias("x"), "v")
    named = named.join(node, F.col("v") == F.col("node")).select(F.col("x").alias("u"), F.col("name").alias("v"))
    return prints, written(named)


def _renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (member, leader) of numbers as pairs (u, v) of one number a node."""
    one, two = (names.select(F.col("number").alias(n), F.col("one").alias(c)) for n, c in (("member", "u"), ("leader", "v")))
    return different(pairs.join(one, "member").join(two, "leader").select("u", "v"))


def different(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with the smaller node first."""
    pairs = pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return written(pairs.distinct())


def kept_sets(docs: DataFrame, some: DataFrame, size: int) -> DataFrame:
    """(node, hashes, sketch) of `some` (node) and of few others, read from the texts again.

    A filter of a fixed size tells the nodes by their first bits; one that is full lets more
    through, not fewer.
    """
    place = F.shiftright(F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("bigint"), 32 - FILTER_BITS)
    byte, bit = F.floor(place / 8), F.pmod(place, F.lit(8)).cast("int")
    marks = some.groupBy(F.floor(byte / 64).cast("int").alias("line"), F.pmod(byte, F.lit(64)).cast("int").alias("at"))
    marks = marks.agg(F.bit_or(F.call_function("shiftleft", F.lit(1), bit)).alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part in marks.groupBy("line").agg(F.collect_list(F.struct("at", "bits")).alias("marks")).toLocalIterator():
        for at, x in part.marks:
            bits[part.line * 64 + at] = x
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for _, sets in text_sets(batches, size):
            some = {}
            for s in sets:
                node = node_of(s)
                p = int.from_bytes(node[:4], "big") >> (32 - FILTER_BITS)
                if len(s) and held[p >> 3] >> (p & 7) & 1:
                    some[node] = s
            yield _batch(
                node=pa.array(list(some), pa.binary()),
                hashes=pa.array([s.tobytes() for s in some.values()], pa.binary()),
                sketch=pa.array([sketch(s).tobytes() for s in some.values()], pa.binary()),
            )

    found = docs.mapInArrow(run, "node binary, hashes binary, sketch binary")
    return found.groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("sketch").alias("sketch"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets (node, hashes) link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    kept.append(k)
            yield batch.select(["u", "v"]).take(pa.array(kept, pa.int64()))

    one = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    two = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _open_groups(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(signature, node, root, parts, a) of signatures whose members are in several components of
    `edges`, `a` being one of them."""
    roots = components(edges).withColumnRenamed("node", "of")
    met = members.join(roots, F.col("one") == F.col("of"), "left")
    met = written(met.select("signature", F.col("one").alias("node"), F.coalesce("root", "one").alias("root")))
    groups = met.groupBy("signature").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"))
    groups = groups.where("a != b").select("signature", "a", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    return written(met.join(groups, "signature"))


def _led(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members that are not in component `a` with one that is."""
    within = groups.where("root = a").groupBy("signature")
    leaders = within.agg(F.min_by("node", F.xxhash64("node", "signature")).alias("v"))
    met = groups.where("root != a").join(leaders, "signature")
    return different(met.select(F.col("node").alias("u"), "v"))


def _apart(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members in different components whose sketches and sizes let them link."""
    small = sets.select("node", F.floor(F.length("hashes") / 8).alias("size"), "sketch")
    rows = groups.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(small, "node")
    rows = rows.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "signature", "x", "y").sortWithinPartitions("signature", "x", "y")
    rows = rows.select("signature", "x", "y", "own", "node", "root", "size", "sketch")
    return different(rows.mapInArrow(_comparer(percent), "u bigint, v bigint"))


def _comparer(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def near(group: list[dict]) -> Iterator[tuple[int, int]]:
        group.sort(key=lambda r: r["own"])
        own = np.array([r["own"] for r in group])
        size = np.array([r["size"] for r in group], np.int64)
        _, root = np.unique([r["root"] for r in group], return_inverse=True)
        sketches = np.frombuffer(b"".join(r["sketch"] for r in group), np.uint8).reshape(len(group), SKETCH).astype(np.int16)
        within = group[0]["x"] == group[0]["y"]
        for i in range(len(group) if within else int((own == own[0]).sum())):
            j = np.arange(i + 1, len(group)) if within else np.flatnonzero(own != own[0])
            j = j[(root[j] != root[i]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))]
            if len(j):
                j = j[np.abs(sketches[j] - sketches[i]).sum(axis=1) <= most_apart(size[j] + size[i], percent)]
            for k in j.tolist():
                yield group[i]["node"], group[k]["node"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, pairs = None, [], set()
        for batch in batches:
            for row in batch.to_pylist():
                if (now := (row["signature"], row["x"], row["y"])) != key:
                    pairs.update(near(group) if group else ())
                    key, group = now, []
                group.append(row)
            if len(pairs) > 1 << 16:
                yield _pairs(pairs)
                pairs = set()
        pairs.update(near(group) if group else ())
        yield _pairs(pairs)

    return run


def _pairs(pairs: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    pairs = list(pairs)
    return _batch(u=pa.array([p[0] for p in pairs], pa.int64()), v=pa.array([p[1] for p in pairs], pa.int64()))


def jaccard_components(docs: DataFrame, *, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text).

    Words are parted by ASCII white space, A-Z lowered. The set of a text is its distinct
    `shingle`-word shingles, or all its words as one if it has fewer; without words, or null, it is
    empty. Rows link if 100 * intersection >= `percent` * union; empty sets link with nothing.
    component_id is the smallest doc_id reachable over links, the row's own included; null ids
    are larger than any. Repeated rows, and rows that share an id, each get a row. Texts of any
    length are taken whole; an empty table gives an empty result; other columns are ignored.

    Shingles are told apart by 64-bit hashes and sets by 128-bit ones.
    """
    prints, edges = jaccard_links(docs, shingle=shingle, percent=percent)
    return component_ids(prints, edges)


def component_ids(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) from what `jaccard_links` gives."""
    full = prints.where("n_shingles > 0")
    least = written(full.groupBy("node").agg(F.min("doc_id").alias("least")))
    roots = written(components(edges).withColumnRenamed("node", "of"))
    met = roots.join(least, F.col("of") == F.col("node"))
    firsts = met.groupBy("root").agg(F.min("least").alias("component_id"))
    tied = written(roots.join(firsts, "root").select("of", "component_id"))
    named = least.join(tied, F.col("node") == F.col("of"), "left").select(
        F.col("node").alias("same"), F.coalesce("component_id", "least").alias("component_id")
    )
    linked = full.join(written(named), F.col("node") == F.col("same")).select("doc_id", "n_shingles", "component_id")
    empty = prints.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)
