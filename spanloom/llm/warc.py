"""WARC archives with an index written first and coalesced range reads.

Records are gzip members of ``.warc.gz`` files in the shared folder, one file per
writing task.  The index (file, offset, length, URL, digest per record) is a
table; a reader sorts the entries it selects by file and offset, joins
neighbouring byte ranges and reads each joined range once.

Of records with equal payloads of at least DEDUP_BYTES bytes, the one with the
largest page_id is a response and the others are revisits of it; smaller ones
are responses.  Defined cases: null html is the empty payload; null URLs leave
out the target header; a null page_id is never the one revisited unless all of
its group are null (then all are responses); rows that repeat the largest page_id
are all responses; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.storage import fresh_path, fs_of, make_dir, normal_uri, ship, shuffle_parts, written

DEDUP_BYTES = 1000
MAX_GAP = 1 << 16
MAX_RANGE = 1 << 23
_INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; a response's payload is checked against its digest."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")

    def page(x: str) -> int | None:
        return int(n) if (n := x[len("<urn:page:") : -1]) else None

    url = fields.get("WARC-Target-URI")
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload,
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages; the index table of their records."""
    spark = ship(pages.sparkSession)
    make_dir(folder)
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    big = F.octet_length("payload") >= DEDUP_BYTES
    kept = p.where(big).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null").drop("n")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")) & big
    p = p.join(kept, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("keep")).alias("refers_to"))

    def run(batches):
        fs, root = fs_of(folder)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            found = []
            for page, url, payload, digest, refers in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = z.compress(record(page, url, payload, digest, refers, refers is not None)) + z.flush()
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(raw)
                found.append((name, at, len(raw), page, url, digest, "response" if refers is None else "revisit", refers))
                at += len(raw)
            if found:
                cols = list(zip(*found, strict=True))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])
        if out is not None:
            out.close()

    return written(p.mapInArrow(run, _INDEX), "warcindex")


def coalesced(entries: Iterator[tuple[str, int, int]], max_gap: int = MAX_GAP, max_range: int = MAX_RANGE) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, entries) of neighbouring sorted entries that are read at once."""
    file, start, end, held = None, 0, 0, []
    for f, offset, length in entries:
        if held and (f != file or offset - end > max_gap or offset + length - start > max_range):
            yield file, start, end, held
            held = []
        if not held:
            file, start = f, offset
        end = offset + length
        held.append((offset, length))
    if held:
        yield file, start, end, held


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the selected index entries, read from the archives."""
    spark = ship(index.sparkSession)

    def run(batches):
        fs, root = fs_of(folder)
        name, src = None, None
        entries = (e for b in batches for e in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in _READ.split(", ")]
        for file, start, end, held in coalesced(entries):
            if file != name:
                name, src = file, fs.open_input_file(f"{root}/{file}")
            raw = src.read_at(end - start, start)
            found = [parse(zlib.decompress(raw[o - start : o - start + n], 31)) for o, n in held]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip(names, kinds, strict=True)], names=names)

    wanted = index.select("file", "offset", "length").repartitionByRange(shuffle_parts(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(run, _READ)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    folder = normal_uri(fresh_path(pages.sparkSession, "warc"))
    return read_records(write_archives(pages, folder), folder)
