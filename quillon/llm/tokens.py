"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillon.llm.shared import col, without, written
from quillon.llm.words import slices

#: Characters of a chunk, and by how many it overlaps the next one at first.
CHUNK, OVERLAP = 16384, 512
#: The overlap grows by this factor where chunks find no common boundary.
WIDEN = 16
#: Bytes of text encoded at once.
SLICE_BYTES = 1 << 20


def count_tokens(
    docs: DataFrame, tokenizer: str, *, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """`docs` with `n_tokens`, the number of tokens of its whole text; null text counts 0.
    Replaces a column of that name.

    `tokenizer` is the path, on every executor, of a byte-level BPE file of the tokenizers
    library whose pre-tokenizer splits by the usual pattern (contractions, letters, digits,
    other characters, each with a space before, and white space). Counts are those of the
    library for the whole text, its added tokens recognised, without tokens added around it.

    Texts of more than `chunk + overlap` characters become rows of that length, each
    overlapping the next, that are spread over the tasks. Two chunks are spliced at a
    boundary between pre-tokens that both have in their overlap and that the first could see
    enough text after to be sure of (`_trusted`): from there on the second splits the text
    as the whole would be. A text with an overlap without such a boundary is done again
    with a wider one, at last as one chunk; chunks are never shorter than the overlap, so that
    each time at most twice the text is encoded. An empty table gives no row. Only numbers are kept between the steps, a few
    for each chunk, under the text's SHA-256: copies of a text share them, so repeated rows,
    ids and other columns need no care.
    """
    docs = without(docs, ["n_tokens"])
    names = [col(c) for c in docs.columns]
    kept = F.struct(*names).alias("row")
    huge = F.coalesce(F.char_length(col("text")) > chunk + overlap, F.lit(False))
    schema = StructType([*docs.schema.fields, StructField("n_tokens", LongType())])
    small = docs.where(~huge).mapInArrow(_counter(tokenizer), schema)
    parts = [small]

    left = docs.where(huge).select(kept, F.sha2(col("text"), 256).alias("text_id"))
    while True:
        spliced = written(_spliced(left, tokenizer, chunk, overlap))
        parts.append(spliced.where("n_tokens is not null").select("row.*", "n_tokens"))
        left = spliced.where("n_tokens is null").select("row", "text_id")
        if left.isEmpty():
            break
        overlap *= WIDEN
        chunk = max(chunk, overlap)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _spliced(texts: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """(row, text_id, n_tokens) of huge texts; n_tokens null where an overlap has no splice."""
    text = F.col("row.text")
    last = F.greatest(F.lit(0), F.ceil((F.char_length(text) - overlap) / chunk) - 1)
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk")
    chunks = texts.select("text_id", text.alias("text"), last.alias("last"), number).select(
        "text_id",
        "chunk",
        "last",
        F.when(F.col("chunk") == F.col("last"), F.expr(f"substring(text, int(chunk * {chunk} + 1))"))
        .otherwise(F.expr(f"substring(text, int(chunk * {chunk} + 1), {chunk + overlap})"))
        .alias("text"),
    )
    marks = (
        chunks.repartition("text_id", "chunk")
        .mapInArrow(_marker(tokenizer, chunk, overlap), MARKS)
        .groupBy("text_id")
        .agg(F.sort_array(F.collect_set(F.struct("chunk", "last", "head", "tail", "total"))).alias("marks"))
        .mapInArrow(_splicer(), "text_id string, n_tokens bigint")
    )
    return texts.join(marks, "text_id").select("row", "text_id", "n_tokens")


MARKS = (
    "text_id string, chunk bigint, last bigint, head array<struct<at:bigint,before:bigint>>, "
    "tail array<struct<at:bigint,before:bigint>>, total bigint"
)
_AT = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))


class Encoder:
    """Counts tokens with the library, each different word of a task once.

    Before a space that is followed by another kind of character the pattern always begins a
    pre-token, and what stands before does not depend on what follows. So a text is cut there,
    and its count is the sum of its words' counts, which are kept. A text that holds one of
    the tokenizer's added tokens is left to the library whole.
    """

    #: Words whose counts are kept at most, before all are forgotten, and their greatest length
    #: in characters: about 200 MB if all are that long and of four bytes a character.
    KEPT, KEPT_LENGTH = 1 << 19, 64

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.longest_added = max(map(len, self.added), default=0)
        self.counts: dict[str, int] = {}

    def words(self, text: str) -> list[str] | None:
        """The text cut into words, or None if it holds an added token."""
        if any(a in text for a in self.added):
            return None
        if "\0" in text or UNEVEN.search(text):
            return CUT.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def learn(self, parted: list[list[str] | None]) -> list[str]:
        """Count all words that are new; gives those too long to be kept, to forget after use."""
        if len(self.counts) > self.KEPT:
            self.counts.clear()
        fresh = list(set().union(*filter(None, parted)).difference(self.counts))
        found = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
        self.counts.update(zip(fresh, map(len, found), strict=True))
        return [w for w in fresh if len(w) > self.KEPT_LENGTH]

    def forget(self, words: list[str]) -> None:
        for w in words:
            del self.counts[w]

    def totals(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        parted = [self.words(t) for t in texts]
        long = self.learn(parted)
        totals = [
            len(self.tokenizer.encode(t, add_special_tokens=False))
            if words is None
            else sum(map(self.counts.__getitem__, words))
            for t, words in zip(texts, parted, strict=True)
        ]
        self.forget(long)
        return totals

    def boundaries(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Per text, places where pre-tokens begin, each with the number of tokens before; the
        last place is the end of the text."""
        parted = [self.words(t) for t in texts]
        long = self.learn(parted)
        out = []
        for text, words in zip(texts, parted, strict=True):
            if words is None:
                encoding = self.tokenizer.encode(text, add_special_tokens=False)
                ids, offsets = encoding.word_ids, encoding.offsets
                places = [(offsets[i][0], i) for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
                out.append([*places, (len(text), len(ids))])
            else:
                at = accumulate(map(len, words), initial=0)
                before = accumulate(map(self.counts.__getitem__, words), initial=0)
                out.append(list(zip(at, before, strict=True)))
        self.forget(long)
        return out


#: Cuts before a space that no white space follows; texts with any other space.
CUT, UNEVEN = re.compile(r"(?= \S)"), re.compile(r" (?!\S)")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """A batch's texts, null as empty, about SLICE_BYTES at a time, with the first's place."""
    text = batch.column(batch.schema.names.index("text"))
    sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
    for a, b in slices(sizes, SLICE_BYTES):
        yield a, [t or "" for t in text[a:b].to_pylist()]


def _counter(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            counts = [n for _, texts in _texts(batch) for n in encoder.totals(texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "n_tokens"]
            )

    return run


def _trusted(text: str, longest_added: int) -> int:
    """Boundaries below this place are those of any text that begins with `text`.

    The pattern decides on a pre-token by its own characters and the one after it, at most 3
    from its start for a contraction, and on white space by the first other character after
    it. An added token, before which the text is parted, is seen if it fits. So what comes
    before a character that is no white space, and that an added token could begin at and
    still fit, is certain.
    """
    return len(text[: max(0, len(text) - max(3, longest_added) + 1)].rstrip())


def _marker(path: str, chunk: int, overlap: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            numbers, lasts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            heads, tails, totals = [], [], []
            for start, texts in _texts(batch):
                found = encoder.boundaries(texts)
                for k, (text, places) in enumerate(zip(texts, found, strict=True), start):
                    at, sure = numbers[k] * chunk, _trusted(text, encoder.longest_added)
                    heads.append([{"at": p + at, "before": n} for p, n in places if p < overlap])
                    tails.append(
                        [{"at": p + at, "before": n} for p, n in places if chunk <= p < sure]
                        if numbers[k] < lasts[k]
                        else []
                    )
                    totals.append(places[-1][1])
            columns = [pa.array(heads, _AT), pa.array(tails, _AT), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *columns], names=["text_id", "chunk", "last", "head", "tail", "total"]
            )

    return run


def spliced_total(marks: list[dict]) -> int | None:
    """Tokens of a text from its chunks in order; None if two have no boundary in common."""
    total, skip = 0, 0
    for one, two in zip(marks, marks[1:], strict=False):
        head = {h["at"]: h["before"] for h in two["head"]}
        splice = next((t for t in one["tail"] if t["at"] in head), None)
        if splice is None:
            return None
        total += splice["before"] - skip
        skip = head[splice["at"]]
    return total + marks[-1]["total"] - skip


def _splicer() -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [spliced_total(m.as_py()) for m in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64())], names=["text_id", "n_tokens"]
            )

    return run
