"""WARC archives by way of a chunked record table.

A payload never travels as one value: it is cut into rows (record, chunk number, bytes) where it is read, and only keys
(ids, digests, lengths) are ever grouped or joined. The writer walks the rows of a partition in order and carries the
record's digest from chunk to chunk; a chunk becomes one WARC record, the first a ``response`` (or ``revisit``), the
others ``continuation`` segments, as the format's segmentation rule has it.

An archive file is a row of gzip members, one for each WARC record, so that any can be fetched alone by its offset.
Spark's text sink writes the members as they are: its line separator is the zero byte that every member of less than
16 MB ends with. A file holds at most RECORDS_PER_FILE members of at most CHUNK_BYTES each. A record's segments may lie
in two files; the reader brings the rows of such records together and checks that none is missing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import new_folder, staged

CHUNK_BYTES, RECORDS_PER_FILE = 1 << 16, 1 << 10
LEAST_REVISIT_BYTES = 100
GZIP_LEVEL = 3
#: Payloads that several pages share: up to so many (some 100 bytes each) are broadcast, more are joined by digest.
HELD_PAYLOADS = 200_000

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ID = "urn:tidegauge:"
_READ = pa.schema(
    [
        ("record", pa.int64()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("chunk_no", pa.int32()),
        ("n_chunks", pa.int32()),
        ("running_digest", pa.string()),
        ("chunk", pa.binary()),
        ("offset", pa.int64()),
    ]
)
_READ_DDL = "record long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, n_chunks int, running_digest string, chunk binary, offset long"
_RECORDS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def shared_payloads(pages: DataFrame, id_col: str, body: Column, least: int) -> DataFrame:
    """(digest, first_id, alone) of the payloads of at least ``least`` bytes that more than one row has; the least id comes first.

    ``alone`` says that one row only has that id and payload.
    """
    keys = pages.select(F.col(id_col).cast("long").alias("id"), F.octet_length(body).alias("n"), F.sha2(body, 256).alias("digest")).where(F.col("n") >= least)
    once = keys.groupBy("digest", "id").agg(F.count("*").alias("n"))
    by = once.groupBy("digest").agg(F.min("id").alias("first_id"), F.min_by("n", "id").alias("n_first"), F.sum("n").alias("n_rows"))
    return staged(by.where((F.col("n_rows") > 1) & F.col("first_id").isNotNull()).select("digest", "first_id", (F.col("n_first") == 1).alias("alone")), "shared-payloads")


def chunk_table(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    chunk_bytes: int = CHUNK_BYTES,
    least: int = LEAST_REVISIT_BYTES,
    held_payloads: int = HELD_PAYLOADS,
) -> DataFrame:
    """Rows (record, page_id, url, record_type, refers_to, alone, payload_bytes, payload_digest, n_chunks, chunk_no, chunk).

    ``alone``: one record is the response for this payload, and so carries the payload's name. A record's rows follow each other within a partition. A revisit has one chunk, of no bytes.
    """
    if not 0 < chunk_bytes < 1 << 23:
        raise ValueError("chunks are of less than 8 MB")
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    shared = shared_payloads(pages, id_col, body, least)
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    if shared.count() <= held_payloads:
        return _cut(rows.join(F.broadcast(shared), "digest", "left"), chunk_bytes).drop("again")
    # Many payloads: chunks are joined, not payloads; adaptive execution splits a payload that a third of all pages have.
    met = _cut(rows.withColumn("first_id", F.lit(None).cast("long")).withColumn("alone", F.lit(False)), chunk_bytes).drop("again", "record_type", "refers_to", "alone").join(shared, F.col("payload_digest") == F.col("digest"), "left")
    again = _again(F.col("page_id"), F.col("first_id"))
    kept = met.where(~again | (F.col("chunk_no") == 0)).select("record", "page_id", "url", *_told(again), F.coalesce("alone", F.lit(False)).alias("alone"), "payload_bytes", "payload_digest", F.when(again, 1).otherwise(F.col("n_chunks")).alias("n_chunks"), "chunk_no", F.when(again, F.lit(b"")).otherwise(F.col("chunk")).alias("chunk"))
    return kept.repartition("record").sortWithinPartitions("record", "chunk_no")


def _again(page_id: Column, first_id: Column) -> Column:
    return first_id.isNotNull() & (page_id.isNull() | (page_id > first_id))


def _told(again: Column) -> tuple[Column, Column]:
    return F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to")


def _cut(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    again = _again(F.col("page_id"), F.col("first_id"))
    n_chunks = F.when(again, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.octet_length("body") / chunk_bytes))).cast("int")
    sent = rows.select("record", "page_id", "url", *_told(again), F.coalesce("alone", F.lit(False)).alias("alone"), F.octet_length("body").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), n_chunks.alias("n_chunks"), again.alias("again"), "body")
    chunk = F.when(F.col("again"), F.lit(b"")).otherwise(F.substring("body", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return sent.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))).withColumn("chunk", chunk).drop("body")


def _header(*fields: tuple[str, object]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)


def _one_line(url: str | None) -> tuple[str | None, str | None]:
    """(target, mark). A url stays as it is; line ends, which would end the header field, are percent-encoded together
    with the percent sign, and a field of our own marks that."""
    if url is None or "\r" not in url and "\n" not in url:
        return url, None
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"), "line-ends"


def _as_it_was(url: str | None, mark: bytes | None) -> str | None:
    return url if url is None or mark is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows → WARC records, each a gzip member without its last byte, which the text sink writes."""
    digest, record, due = hashlib.sha256(), None, 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            first, last, revisit = r["chunk_no"] == 0, r["chunk_no"] == r["n_chunks"] - 1, r["record_type"] == "revisit"
            if r["chunk_no"] != (0 if first else due) or not first and r["record"] != record:
                raise ValueError(f"page {r['page_id']}: chunk {r['chunk_no']} is out of order")
            digest = hashlib.sha256() if first else digest
            record, due = r["record"], r["chunk_no"] + 1
            digest.update(r["chunk"])
            if last and not revisit and digest.hexdigest() != r["payload_digest"]:
                raise ValueError(f"page {r['page_id']}: the chunks' digest is not the payload's")
            block = r["chunk"]
            if first:
                block = b"HTTP/1.1 200 OK\r\n" + _header(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", r["payload_bytes"])) + b"\r\n" + block
            name = f"<{_ID}payload:{r['payload_digest']}>" if r["alone"] and not revisit else f"<{_ID}record:{r['record']}>"
            target, mark = _one_line(r["url"])
            head = _header(
                ("WARC-Type", r["record_type"] if first else "continuation"),
                ("WARC-Record-ID", name if first else name[:-1] + f":{r['chunk_no'] + 1}>"),
                ("WARC-Target-URI", target),
                ("X-Target-Encoded", mark),
                ("WARC-Date", "1970-01-01T00:00:00Z"),
                ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"),
                ("WARC-Refers-To", f"<{_ID}payload:{r['payload_digest']}>" if revisit and r["alone"] else None),
                ("WARC-Profile", PROFILE.decode() if revisit else None),
                ("WARC-Segment-Number", r["chunk_no"] + 1 if r["n_chunks"] > 1 else None),
                ("WARC-Segment-Origin-ID", None if first else name),
                ("WARC-Segment-Total-Length", r["payload_bytes"] if last and not first else None),
                ("X-Record-Number", r["record"]),
                ("X-Page-ID", r["page_id"]),
                ("X-Refers-To-Page", r["refers_to"]),
                ("X-Payload-Length", r["payload_bytes"]),
                ("X-Segment-Count", r["n_chunks"]),
                ("X-Running-Digest", f"sha256:{digest.hexdigest()}"),
                ("Content-Type", "application/http; msgtype=response"),
                ("Content-Length", len(block)),
            )
            packed = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
            member = packed.compress(VERSION + head + b"\r\n" + block + b"\r\n\r\n") + packed.flush()
            if member[-1]:
                raise ValueError(f"page {r['page_id']}: a record of 16 MB or more")
            out.append(member[:-1])
        yield pa.record_batch([pa.array(out, pa.binary())], ["record"])


def write_archives(chunks: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """A chunk table as archives in the folder ``path``: files of gzip members, as gzip and WARC tools read them."""
    members = chunks.mapInArrow(_segments, "record binary").select(F.col("record").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def _members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(view):
        begin, held, parts = at, zlib.decompressobj(31), []
        while not held.eof:
            if at >= len(view):
                raise ValueError("a record is cut off")
            piece = view[at : at + (1 << 15)]
            parts.append(held.decompress(piece))
            at += len(piece)
        at -= len(held.unused_data)
        yield begin, b"".join(parts)


def _number(name: bytes | None) -> int | None:
    return None if name is None else int(name)


def _segment(offset: int, data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    if len(block) != int(fields[b"Content-Length"]) + 4:
        raise ValueError("a record is not as long as it says")
    continued = fields[b"WARC-Type"] == b"continuation"
    uri, mark = fields.get(b"WARC-Target-URI"), fields.get(b"X-Target-Encoded")
    return {
        "record": int(fields[b"X-Record-Number"]),
        "page_id": _number(fields.get(b"X-Page-ID")),
        "url": _as_it_was(uri.decode(), mark) if uri is not None else None,
        "record_type": "response" if continued else fields[b"WARC-Type"].decode(),
        "refers_to": _number(fields.get(b"X-Refers-To-Page")),
        "payload_bytes": int(fields[b"X-Payload-Length"]),
        "payload_digest": fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"),
        "chunk_no": int(fields.get(b"WARC-Segment-Number", 1)) - 1,
        "n_chunks": int(fields[b"X-Segment-Count"]),
        "running_digest": fields[b"X-Running-Digest"].decode().removeprefix("sha256:"),
        "chunk": block[:-4] if continued else block[:-4].partition(b"\r\n\r\n")[2],
        "offset": offset,
    }


def _taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for offset, data in _members(content.as_buffer()):
                rows.append(_segment(offset, data))
                held += len(data)
                if held > 1 << 24 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _READ)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives in ``path``, with each segment's offset in its file; one file is held at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_taken_apart, _READ_DDL)


def _right_payload(r: dict, size: int) -> None:
    if r["record_type"] == "response" and (size != r["payload_bytes"] or r["running_digest"] != r["payload_digest"]):
        raise ValueError(f"record {r['record']}: the payload is not what its header says")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows in order → one row for each record whose every chunk is there, with the announced length and digest."""
    now, digest, size, due, n_chunks = None, hashlib.sha256(), 0, 0, 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["record"] != now or due == n_chunks:
                if due != n_chunks:
                    raise ValueError(f"record {now}: the chunks from {due + 1} to {n_chunks} are missing")
                now, digest, size, due, n_chunks = r["record"], hashlib.sha256(), 0, 0, r["n_chunks"]
            if r["chunk_no"] != due:
                raise ValueError(f"record {now}: chunk {due + 1} is missing")
            digest.update(r["chunk"])
            size, due = size + len(r["chunk"]), due + 1
            if digest.hexdigest() != r["running_digest"]:
                raise ValueError(f"record {now}: a chunk's digest is not what its bytes have")
            if due == n_chunks:
                _right_payload(r, size)
                out.append({k: r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([_READ.field(k) for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")]))
    if due != n_chunks:
        raise ValueError(f"record {now}: the chunks from {due + 1} to {n_chunks} are missing")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one chunk are checked and lose their bytes; the chunks of others pass through."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            if r["n_chunks"] == 1:
                if r["chunk_no"] or hashlib.sha256(r["chunk"]).hexdigest() != r["running_digest"]:
                    raise ValueError(f"record {r['record']}: a chunk's digest is not what its bytes have")
                _right_payload(r, len(r["chunk"]))
                r["chunk"] = None
        yield pa.RecordBatch.from_pylist(rows, _READ)


def read_records(chunks: DataFrame) -> DataFrame:
    """The chunk table of :func:`read_archives` → one row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Raises if a chunk is missing or a length or digest is wrong. Records of one chunk are checked where they are read;
    the others' chunks are brought together by record and stream through their digest in order.
    """
    seen = staged(chunks.mapInArrow(_settled, _READ_DDL), "warc-chunks")
    one = seen.where("n_chunks = 1").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    more = seen.where("n_chunks > 1").repartition("record").sortWithinPartitions("record", "chunk_no")
    return one.unionByName(more.mapInArrow(_checked, _RECORDS_DDL))


def archive_pages(
    pages: DataFrame,
    path: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    chunk_bytes: int = CHUNK_BYTES,
    least: int = LEAST_REVISIT_BYTES,
    held_payloads: int = HELD_PAYLOADS,
    records_per_file: int = RECORDS_PER_FILE,
) -> DataFrame:
    """Writes a WARC record per row and returns what reading the archives gives back, one row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url. Of records with equal payloads of at least
    ``least`` bytes, the one with the least page_id is the response and the others revisit it.

    * A null payload is the empty one; a null url gives no target field and comes back null.
    * A null page_id comes after all others. Rows that repeat the least page_id and its payload are all responses; then
      revisits name the page, but no one record.
    * Record ids are those of the record number, or of the payload's digest for the one response that others revisit.
    * Payloads of over ``chunk_bytes`` are several rows and several segments; an empty table gives no records.
    * Lengths and digests are checked against the bytes on reading, and that no chunk is missing; other columns aren't looked at.
    """
    path = path or new_folder(pages.sparkSession, "warc")
    write_archives(chunk_table(pages, id_col, url_col, body_col, chunk_bytes, least, held_payloads), path, records_per_file)
    chunks = read_archives(pages.sparkSession, path)
    return read_records(chunks)
