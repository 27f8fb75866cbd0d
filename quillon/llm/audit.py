"""Source divergence audit: how the words of each source differ from its language's."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import col, written
from quillon.llm.words import slices

#: A term: a run of letters a to z and of characters beyond ASCII, A-Z lowered.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are counted in billionths, with so much added to each count.
ONE, ADDED_COUNT = 1_000_000_000, 5

#: What no term holds or begins or ends with: the rest of ASCII.
EDGES = bytes(b for b in range(128) if not chr(b).isalpha())

#: Chunks whose counts, or whose absence from a filter, a task holds; bytes of text taken at once.
HELD, SLICE_BYTES = 1 << 19, 1 << 20
#: Bits of the filter of unsettled chunks: 16 MB, however many there are.
FILTER_BITS = 27
#: Kept terms of a language in a block, about.
BLOCK_TERMS = 1024


def audit(docs: DataFrame, *, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of `docs` (text, lang, source).

    Nulls read as ''. Each lang keeps the terms that at least `min_docs` of its rows hold.
    A group, that is a lang and source that occur together, and each lang, gives each of the V
    kept terms p = 1 + floor(ONE * (count + 5) / (N + 5 * V)), N being its count of all kept
    terms. Part `pair`: for each other source of the lang the sum over kept terms of the
    differences of both p. Part `term`: kept terms that the group holds, with a p above the
    lang's, by how far it is above; the `top` first. Ranks run from 1 in each group and part,
    by value descending, then by item in UTF-8. All arithmetic is exact.

    Each row is a document, so repeated rows and ids count as often as they come. Empty and
    blank texts hold no term, and a long text or chunk is whole. An empty table gives an empty
    result; other columns are ignored, whatever their names.

    Whitespace chunks (A-Z lowered, without the characters at both ends that no term holds) are
    counted document by document and summed in each task, so the shuffle gets a row for each
    chunk that a task saw in a group, not one for each word. All that is known of a chunk then
    meets in one row, which is parted into terms once; its terms go back to its counts there.
    Occurrences add up. Documents of a lang do not where one holds a term in several chunks
    ("it" and "it's"): they lie between the largest number of a chunk with the term and the
    sum of all. Where `min_docs` lies between the two the documents that hold
    such chunks are told by a second reading and counted once each.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.coalesce(col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        *[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
    )
    chunks = written(_chunks(rows.mapInArrow(_chunk_counts, COUNTS)))
    kept = written(_kept(rows, chunks.where("chunk != ''"), min_docs))
    each = chunks.select("terms", F.explode("langs").alias("of")).select("terms", "of.lang", F.explode("of.sources").alias("s"))
    groups = each.select("lang", "s.source").distinct()  # the empty chunk tells of those without words
    found = each.select("lang", "s.source", "s.n", F.explode("terms").alias("term")).repartition("lang", "term")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    return _ranked(written(groups), counts.join(kept, ["lang", "term"]), kept, top)


def _chunks(counted: DataFrame) -> DataFrame:
    """(chunk, terms, langs): a row a chunk, with its terms, repeats included, and for each lang
    its documents and the occurrences by source. One shuffle, on the chunk."""
    met = counted.repartition("chunk").groupBy("chunk", "lang", "source")
    met = met.agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    langs = met.groupBy("chunk", "lang").agg(
        F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "n")).alias("sources")
    )
    whole = langs.groupBy("chunk").agg(F.collect_list(F.struct("lang", "n_docs", "sources")).alias("langs"))
    return whole.select("chunk", F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0)).alias("terms"), "langs")


COUNTS = "lang string, source string, chunk string, n_docs bigint, n bigint"


def _texts(batch: pa.RecordBatch, names: list[str]) -> Iterator[list[tuple]]:
    """Rows of the columns, about SLICE_BYTES of text at a time."""
    sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
    for a, b in slices(sizes, SLICE_BYTES):
        yield list(zip(*[batch.column(n)[a:b].to_pylist() for n in names], strict=True))


def _chunk_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences of each chunk by group, summed over many documents; the empty
    chunk stands for the documents themselves."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def full() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, times) in held.items():
            chunks = list(docs)
            alike = [pa.array([x] * len(chunks), pa.string()) for x in (lang, source)]
            columns = [pa.array(chunks, pa.binary()).cast(pa.string())]
            columns += [pa.array([c[x] for x in chunks], pa.int64()) for c in (docs, times)]
            yield pa.RecordBatch.from_arrays([*alike, *columns], names=["lang", "source", "chunk", "n_docs", "n"])
        held.clear()

    for batch in batches:
        for rows in _texts(batch, ["lang", "source", "text"]):
            for lang, source, text in rows:
                docs, times = held.setdefault((lang, source), (Counter(), Counter()))
                chunks = [c.strip(EDGES) for c in text.lower().split()]
                times.update(chunks)
                docs.update({*chunks, b""})
            if sum(len(d) for d, _ in held.values()) > HELD:
                yield from full()
    yield from full()


def _kept(rows: DataFrame, chunks: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of the terms in at least `min_docs` documents of the lang."""
    met = chunks.select("chunk", F.explode(F.array_distinct("terms")).alias("term"), "langs")
    met = met.select("chunk", "term", F.explode("langs").alias("of")).select("chunk", "term", "of.lang", "of.n_docs")
    bounds = met.groupBy("lang", "term").agg(F.max("n_docs").alias("least"), F.sum("n_docs").alias("most"))
    bounds = written(bounds.where(F.col("most") >= min_docs))
    open_ = bounds.where(F.col("least") < min_docs).select("lang", "term")
    unsettled = written(met.select("lang", "chunk", "term").join(open_, ["lang", "term"]))
    found = _holders(rows, unsettled.select("lang", "chunk").distinct())
    held = (
        found.join(unsettled, ["lang", "chunk"])
        .select("lang", "term", "row_id")
        .distinct()
        .groupBy("lang", "term")
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )
    settled = bounds.where(F.col("least") >= min_docs)
    return settled.select("lang", "term").unionByName(held.select("lang", "term"))


def _holders(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(row_id, lang, chunk): the documents that may hold one of `chunks` (lang, chunk).

    A filter of a fixed size tells the chunks by CRC-32; what is not among `chunks` drops out
    where this is joined to them. A filter that is full lets more rows through, not fewer.
    """
    place = F.shiftright(F.crc32(F.col("chunk").cast("binary")), 32 - FILTER_BITS)
    byte, bit = F.floor(place / 8), F.pmod(place, F.lit(8)).cast("int")
    marks = chunks.groupBy(F.floor(byte / 64).cast("int").alias("line"), F.pmod(byte, F.lit(64)).cast("int").alias("at"))
    marks = marks.agg(F.bit_or(F.call_function("shiftleft", F.lit(1), bit)).alias("bits"))
    table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part in marks.groupBy("line").agg(F.collect_list(F.struct("at", "bits")).alias("marks")).toLocalIterator():
        for at, bits in part.marks:
            table[part.line * 64 + at] = bits
    shared = rows.sparkSession.sparkContext.broadcast(table.tobytes())
    return rows.mapInArrow(_holder(shared), "row_id bigint, lang string, chunk string")


def _holder(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crc, shift, absent = shared.value, zlib.crc32, 32 - FILTER_BITS, set()
        for batch in batches:
            for rows in _texts(batch, ["row_id", "lang", "text"]):
                ids, langs, found = [], [], []
                for row_id, lang, text in rows:
                    chunks = {c.strip(EDGES) for c in text.lower().split()} - absent
                    places = [(crc(c) >> shift, c) for c in chunks]
                    some = [c for p, c in places if table[p >> 3] >> (p & 7) & 1]
                    if len(absent) > HELD:
                        absent.clear()
                    absent.update(chunks.difference(some))
                    found += some
                    ids += [row_id] * len(some)
                    langs += [lang] * len(some)
                columns = [pa.array(ids, pa.int64()), pa.array(langs, pa.string())]
                columns.append(pa.array(found, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "lang", "chunk"])

    return run


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (n + 5) / (total + 5 * terms)) in whole numbers."""
    big = (n.cast("decimal(28,0)") + ADDED_COUNT) * F.lit(ONE).cast("decimal(10,0)")
    parts = (total.cast("decimal(28,0)") + terms.cast("decimal(20,0)") * ADDED_COUNT).cast("decimal(38,0)")
    return F.call_function("div", big.cast("decimal(38,0)"), parts) + 1


def _ranked(groups: DataFrame, counts: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """Both parts, from the groups, the kept terms and the counts (lang, source, term, n)."""
    counts = written(counts)
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").cast("decimal(28,0)").alias("total"))
    groups = written(
        groups.join(totals, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .withColumn("total", F.coalesce("total", F.lit(0).cast("decimal(28,0)")))
    )
    shared = written(counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v"))))

    of_lang = shared.groupBy("lang", "term").agg(F.sum("n").cast("decimal(28,0)").alias("m"))
    all_ = groups.groupBy("lang").agg(F.sum("total").cast("decimal(28,0)").alias("all"))
    of_lang = of_lang.join(all_, "lang").join(terms, "lang").withColumn("q", _share(F.col("m"), F.col("all"), F.col("v")))
    above = shared.select("lang", "source", "term", "p").join(of_lang.select("lang", "term", "q"), ["lang", "term"])
    value = (F.col("p") - F.col("q")).alias("value")
    of_term = above.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by)
    of_term = of_term.withColumn("rank", rank).where(F.col("rank") <= top)

    sums = _differences(shared.select("lang", "source", "term", "p"), groups, terms)
    one, two = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    pairs = one.join(two, "lang").where(F.col("source") != F.col("item")).join(sums, ["lang", "source", "item"], "left")
    value = F.coalesce("value", F.lit(0).cast("bigint")).alias("value")
    of_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value).withColumn("rank", rank)
    return of_term.unionByName(of_pair)


def _differences(shared: DataFrame, groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed differences of p of each two sources of a lang.

    Kept terms are dealt into blocks of about BLOCK_TERMS; a row is a block with the p of all
    sources, and p of a term that a source lacks is the same for all its terms.
    """
    lacking = _share(F.lit(0), F.col("total"), F.col("v"))
    with_terms = groups.where("v > 0").select("lang", F.struct("source", lacking.alias("p")).alias("s"))
    sources = with_terms.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("sources"))
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BLOCK_TERMS)).alias("block")
    dealt = shared.join(terms, "lang").select("lang", block, "term", "source", "p")
    lists = dealt.groupBy("lang", "block", "term").agg(F.collect_list(F.struct("source", "p")).alias("held"))
    blocks = lists.groupBy("lang", "block").agg(F.collect_list("held").alias("terms"))
    parts = blocks.join(sources, "lang").select("lang", "sources", "terms")
    found = parts.mapInArrow(_subtracted, "lang string, source string, item string, value bigint")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _subtracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, sources, terms in zip(*[c for c in batch.columns], strict=True):
            sources, terms = sources.as_py(), terms.as_py()
            names = [s["source"] for s in sources]
            at = {s: i for i, s in enumerate(names)}
            p = np.tile(np.array([s["p"] for s in sources], np.int64)[:, None], len(terms))
            for j, held in enumerate(terms):
                for h in held:
                    p[at[h["source"]], j] = h["p"]
            for i, name in enumerate(names):  # a source at a time, so that S x terms is all that is held
                value = np.abs(p - p[i]).sum(axis=1)
                alike = [pa.array([x] * len(names), pa.string()) for x in (lang.as_py(), name)]
                yield pa.RecordBatch.from_arrays(
                    [*alike, pa.array(names, pa.string()), pa.array(value)], names=["lang", "source", "item", "value"]
                )
