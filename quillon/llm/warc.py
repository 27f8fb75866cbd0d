"""WARC archives, index first: written with an index of records, read by byte range."""

from __future__ import annotations

import base64
import hashlib
import zlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import col, file_system, shared_folder, written

INDEX = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, record_id string, file string, offset bigint, length bigint"
)
READ = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, record_id string, payload binary"
)

#: An archive is closed when it is this long.
ARCHIVE_BYTES = 256 << 20
#: Ranges at most GAP apart are read at once, up to READ_BYTES.
GAP, READ_BYTES = 64 << 10, 8 << 20
#: Bytes of archives, and records, that a task reads on average.
TASK_BYTES, TASK_RECORDS = 32 << 20, 1 << 14


def typed(pages: DataFrame) -> DataFrame:
    """`pages` as (page_id, url, payload, record_type, refers_to).

    Of rows with equal payloads (html in UTF-8; null is empty) the one with the largest
    page_id is the response and the others revisit it; null ids are smaller than any. If
    several rows have that largest id, or no row of the payload has an id, each of them is
    a response. Other columns are left out.

    Payloads are compared by SHA-256. Groups are counted on the map side, and only groups
    of more than one row are joined back, as a table whose size Spark knows.
    """
    rows = pages.select(
        col("page_id").cast("bigint").alias("page_id"),
        col("url").cast("string").alias("url"),
        F.coalesce(col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("sha", F.sha2("payload", 256))
    groups = (
        rows.groupBy(F.col("sha").alias("same"))
        .agg(F.count("*").alias("n"), F.max("page_id").alias("kept"))
        .where((F.col("n") > 1) & F.col("kept").isNotNull())
        .select("same", "kept")
    )
    groups = written(groups)
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.join(groups, rows.sha == groups.same, "left").select(
        "page_id",
        "url",
        F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("payload"),
        F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record per row of `pages` into gzipped WARC files; return their index.

    A task appends its records to files of its own, one gzip member a record, so that any
    record can be read alone. File names are new for each attempt, and only the index rows
    of attempts that Spark committed are kept: a lost or doubled attempt leaves at most a
    file that no index row names. The index is a Parquet table in the shared folder.

    A revisit names its response by id (WARC-Refers-To): a response's id follows from its
    page_id and payload, so repeated rows, which are the same record again, share it. No row
    gives an empty index. A record is held in memory whole, as Spark holds its row.

    `folder`: a URI that pyarrow opens on every executor (file, hdfs, s3, gs); by default a
    new one in the shared folder.
    """
    folder = folder or shared_folder(pages.sparkSession)
    return written(
        typed(pages).mapInArrow(lambda batches: _write(folder, batches), INDEX)
    )


def read_records(index: DataFrame) -> DataFrame:
    """The records that `index` (all of it or selected rows) points to, read and checked.

    The rows are ordered by file and offset in ranges of that order, so that a task reads
    neighbouring records with one request. The number of ranges follows from the bytes and
    the records that are to be read. A revisit has no payload; its length and digest are
    those of the payload it refers to, as its own headers give them. An empty index gives no
    row, and a row of the index that is repeated is read again.
    """
    ordered = index.select("file", "offset", "length")
    size = ordered.agg(F.sum("length").alias("bytes"), F.count("*").alias("records")).first()
    n = max(1, -(-(size["bytes"] or 0) // TASK_BYTES), -(-size["records"] // TASK_RECORDS))
    ordered = ordered.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read, READ)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, a few at a time, so that a batch is not held twice."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            yield from batch.slice(start, 64).to_pylist()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _write(folder: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    schema, out, name, offset, done = _arrow(INDEX), None, "", 0, []
    try:
        for row in _rows(batches):
            if out is None or offset >= ARCHIVE_BYTES:
                if out is not None:
                    out.close()
                name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            row["payload_digest"] = base64.b32encode(bytes.fromhex(row.pop("sha1"))).decode()
            response = row["record_type"] == "response" and row["page_id"] is not None
            row["record_id"] = _response_id(row["page_id"], row) if response else uuid.uuid4().urn
            member = _member(row)
            out.write(member)
            del row["payload"]
            done.append(row | {"file": f"{folder}/{name}", "offset": offset, "length": len(member)})
            offset += len(member)
            if len(done) >= 4096:
                yield _batch(done, schema)
                done = []
    finally:
        if out is not None:
            out.close()
    yield _batch(done, schema)


def _response_id(page_id: int, row: dict) -> str:
    """The id of the response of that page whose payload is the row's."""
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id} {row['payload_bytes']} {row['payload_digest']}").urn


def _line(text: str) -> str:
    """A header value: one line."""
    return " ".join(text.split())


def _member(row: dict) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    payload = row["payload"].encode()
    url = _line(row["url"] or "") or "urn:none"
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_response_id(row['refers_to'], row)}>",
            f"X-Refers-To-Page-ID: {row['refers_to']}",
        ]
    block = "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(block) + pack.flush()


def _headers(block: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in block.decode().split("\r\n")[1:])
    return {k.lower(): v.strip() for k, _, v in pairs}


def _parsed(member: bytes) -> dict:
    """The row of a record; raises if its payload does not have the digest it names."""
    record = zlib.decompress(member, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http)["content-length"])
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    revisit = warc["warc-type"] == "revisit"
    if not revisit:
        read = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (read, len(payload)) != (digest, size):
            raise ValueError(f"record {warc['warc-record-id']}: payload and digest differ")
    number = lambda k: int(warc[k]) if k in warc else None
    return {
        "page_id": number("x-page-id"),
        "url": None if warc["warc-target-uri"] == "urn:none" else warc["warc-target-uri"],
        "record_type": warc["warc-type"],
        "refers_to": number("x-refers-to-page-id"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_id": warc["warc-record-id"].strip("<>"),
        "payload": None if revisit else payload,
    }


def coalesced(ranges: Iterable[dict]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Ranges (file, offset, length) in order, as (file, start, [(offset, length)]) reads."""
    file, start, end, parts = None, 0, 0, []
    for r in ranges:
        stop = r["offset"] + r["length"]
        if parts and (r["file"] != file or r["offset"] - end > GAP or stop - start > READ_BYTES):
            yield file, start, parts
            parts = []
        if not parts:
            file, start, end = r["file"], r["offset"], r["offset"]
        parts.append((r["offset"], r["length"]))
        end = max(end, stop)
    if parts:
        yield file, start, parts


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, name, source = _arrow(READ), None, None
    for file, start, parts in coalesced(_rows(batches)):
        if file != name:
            if source is not None:
                source.close()
            system, path = file_system(file)
            name, source = file, system.open_input_file(path)
        end = max(o + n for o, n in parts)
        block = source.read_at(end - start, start)
        rows = [_parsed(block[o - start : o - start + n]) for o, n in parts]
        yield _batch(rows, schema)
    if source is not None:
        source.close()
