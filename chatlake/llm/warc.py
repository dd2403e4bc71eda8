"""Zstandard-compressed WARC archives with an embedded dictionary.

Each task writes its rows into archives of bounded size. The dictionary of an archive is trained on the
records of that archive, stands compressed in a leading skippable frame, and every record is a frame of
its own, so that a reader can start at any record. Archives are rows of a table (name, bytes), which
Spark commits like any other output; `export_archives` puts them into files.

Null payloads are empty payloads, null addresses give records without a target. Rows without an id are
never referred to: a class of equal payloads with null ids only is all response, else such rows revisit.
Rows that repeat the smallest id of their class are all response. Very long payloads close their archive. An empty table gives no
archive. Columns with other names are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ready, table, written

#: Skippable frame that holds the dictionary, as the WARC-Zstandard convention has it.
_MAGIC = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES = 32 << 10
#: Bytes of whole records that a dictionary is trained on, taken evenly from the archive.
TRAINING_BYTES = 2 << 20
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for these records by one rule: what zstandard's trainer makes of them, and where it finds too little
    to train on (it needs several records that have something in common), the bytes of the same samples."""
    stride = max(1, sum(map(len, records)) // TRAINING_BYTES)
    samples, room = [], TRAINING_BYTES
    for r in records[::stride]:
        if len(r) <= room or not samples:
            samples.append(r)
            room -= len(r)
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dict_data(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def archive(records: list[bytes], level: int = 3) -> bytes:
    raw = dictionary(records)
    packed = zstandard.ZstdCompressor(level=10).compress(raw)
    d = _dict_data(raw)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True) if d else zstandard.ZstdCompressor(level=level, write_checksum=True)
    return b"".join([struct.pack("<II", _MAGIC, len(packed)), packed, *map(compressor.compress, records)])


def frame_end(data: bytes, at: int) -> int:
    """The byte after the frame that starts at `at`, by its block headers."""
    head = data[at : at + 18]
    p = zstandard.get_frame_parameters(head)
    at += zstandard.frame_header_size(head)
    while True:
        h = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if (h >> 1) & 3 == 1 else h >> 3)
        if h & 1:
            return at + 4 * bool(p.has_checksum)


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != _MAGIC:
        raise ValueError("the archive has no dictionary frame")
    d = _dict_data(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    reader = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(data):
        end = frame_end(data, at)
        yield reader.decompress(data[at:end])
        at = end


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(first, digest)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(urn: str) -> int | None:
    v = urn.split(":")[2]
    return int(v) if v else None


def parse(record: bytes) -> dict:
    """The fields of a record; of a response, its payload is held against the digest it names."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload's digest does not hold")
    n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    return {
        "page_id": _id(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": n,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else _id(fields["WARC-Refers-To"]),
        "payload": payload if response else None,
    }


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archives of a (page_id, url, html) table as rows `archive` string, `n_records` int, `data` binary.

    Of pages with equal payloads of at least min_revisit_bytes, the one with the smallest page_id is a
    response record and the others are revisit records that refer to it."""
    ready(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").select("*", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
    # one row per payload after the map side; only classes of several rows go on
    shared = rows.where(F.col("size") >= min_revisit_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    joined = rows.join(shared, ["sha1", "size"], "left").select("page_id", "url", "html", "sha1", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))

    def run(batches):
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{count:05d}.warc.zst"]), pa.array([len(held)], pa.int32()), pa.array([archive(held)], pa.binary())], ["archive", "n_records", "data"])

        for batch in batches:
            for page_id, url, html, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
                body = (html or "").encode()
                held.append(_record(page_id, url, body, base64.b32encode(bytes.fromhex(sha1)).decode(), first))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, count = [], 0, count + 1
        if held:
            yield flush()

    return joined.mapInArrow(run, "archive string, n_records int, data binary")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and of responses the payload. A damaged record fails the job."""
    ready(archives.sparkSession)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    types = dict(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]))

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [parse(r) for r in records_of(data)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[c]) for c in names], names)

    return archives.where("data IS NOT NULL").select("data").mapInArrow(run, schema)


def export_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive to a file of its name in a folder that all executors mount; repeated tasks
    replace whole files only."""

    def save(rows):
        for row in rows:
            to = Path(folder, row.archive)
            part = to.with_suffix(f".{TaskContext.get().taskAttemptId()}.tmp")
            part.write_bytes(row.data)
            part.replace(to)

    Path(folder).mkdir(parents=True, exist_ok=True)
    archives.select("archive", "data").foreachPartition(save)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(written(write_archives(table(spark, sf_dir, "pages")), "op1-archives"), with_payload=False).drop("url")



OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
c AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1),
x AS (SELECT p.page_id, p.h, unhex(sha1(p.h)) AS d, CASE WHEN p.page_id = c.first OR c.first IS NULL THEN NULL ELSE c.first END AS refers_to FROM p JOIN c ON p.h = c.h),
b AS (SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(bits[i * 5 + 1 : i * 5 + 5]::BIT::INT AS INT) + 1, 1), '' ORDER BY i) FROM range(32) r(i)) AS payload_digest
  FROM (SELECT *, (SELECT string_agg(lpad(bin(CAST('0x' || substr(hex(d), 1 + 2 * j, 2) AS INT)), 8, '0'), '' ORDER BY j) FROM range(20) s(j)) AS bits FROM x))
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM b
"""
