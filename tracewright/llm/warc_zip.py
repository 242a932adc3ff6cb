"""WARC records in ZIP archives: writing, and reading by ranges without extraction.

Each task writes archives of its own: a stored member with gzipped WARC records, one
gzip member per record, and a stored index of their offsets. The reader parses the end
record, the ZIP64 records and the central directory, finds the stored members, reads
the index, and fetches records by byte ranges (neighbouring ones in one request). An
archive counts once its task has succeeded: only archives named in the manifest are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, text_or_empty

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
ARCHIVE_BYTES, ARCHIVE_RECORDS, REQUEST_BYTES = 64 << 20, 20_000, 1 << 20
RECORDS = "archive string, record_id string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


class _Stream:
    """The write side of a file that can't seek; ZIP members then carry data descriptors."""

    def __init__(self, file):
        self.write, self.flush = file.write, lambda: None


def warc_record(record_id: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """page_id and refers_to are the table's ids; record_id is the record's own and differs between any two records."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + " ".join(url.split()),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(raw: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda name: int(fields[name]) if name in fields else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload and digest differ")
    return {
        "record_id": fields["WARC-Record-ID"].removeprefix("<urn:uuid:").removesuffix(">"),
        "page_id": page("Page-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page("Refers-To-Page-ID"),
    }


def write_archives(pages: DataFrame, where: str, most_bytes: int = ARCHIVE_BYTES, most_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Writes (page_id, url, payload, digest, keeper) into archives under where; one row per archive: archive, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(where)
        fs.create_dir(base, recursive=True)
        rows = (row for batch in batches for row in zip(*batch.columns, strict=True))
        row = next(rows, None)
        while row is not None:
            own = uuid.uuid4()
            name = f"{own.hex}.wacz"
            index, offset = [], 0
            with fs.open_output_stream(f"{base}/{name}", compression=None) as file, zipfile.ZipFile(_Stream(file), "w", zipfile.ZIP_STORED) as archive:
                with archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                    while row is not None and offset < most_bytes and len(index) < most_records:
                        page_id, url, html, digest, keeper = (x.as_py() for x in row)
                        revisit = keeper is not None and keeper != page_id
                        raw = gzipped(warc_record(str(uuid.uuid5(own, str(len(index)))), page_id, url, html.encode(), digest, keeper, revisit))
                        data.write(raw)
                        index.append(json.dumps({"url": url, "offset": offset, "length": len(raw)}))
                        offset += len(raw)
                        row = next(rows, None)
                archive.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
            yield pa.RecordBatch.from_pydict({"archive": [f"{where}/{name}"], "records": pa.array([len(index)], pa.int64())})

    return pages.select("page_id", "url", "payload", "digest", "keeper").mapInArrow(run, "archive string, records long")


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """(start, length) of the data of each stored member, from the central directory of a ZIP or ZIP64 file."""
    span = min(size, 65_557)
    tail = file.read_at(span, size - span)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = size - span + at
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and end >= 20:
        locator = file.read_at(20, end - 20)
        if locator[:4] == b"PK\x06\x07":
            record = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if record[:4] != b"PK\x06\x06":
                raise ValueError("bad ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, out, at = file.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, names, extras, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode()
        extra = directory[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the saturated fields, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        if method == 0:
            local = file.read_at(30, offset)
            out[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + names + extras + comment
    return out


def records(archive: str) -> Iterator[dict]:
    """All records of an archive in index order; neighbouring ones are fetched by one range read."""
    fs, path = pafs.FileSystem.from_uri(archive)
    with fs.open_input_file(path) as file:
        found = members(file, file.size())
        start, length = found[INDEX]
        entries = [json.loads(line) for line in file.read_at(length, start).splitlines()]
        start, _ = found[DATA]
        at = 0
        while at < len(entries):
            first, stop = entries[at]["offset"], at
            while stop < len(entries) and entries[stop]["offset"] + entries[stop]["length"] - first <= max(REQUEST_BYTES, entries[at]["length"]):
                stop += 1
            last = entries[stop - 1]
            block = file.read_at(last["offset"] + last["length"] - first, start + first)
            for entry in entries[at:stop]:
                raw = block[entry["offset"] - first : entry["offset"] - first + entry["length"]]
                yield parse_record(zlib.decompress(raw, 31))
            at = stop


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the archives named in manifest: rows of RECORDS; without payload its column is null.

    - an empty manifest gives no rows; an archive named twice is read twice; other columns of manifest are not looked at;
    - a null or missing archive, one that is no stored ZIP with both members, or a record that differs from its digest is an error;
    - records of pages without an id have a null page_id; record_id is never null and never repeated within the archives of a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["archive", "record_id", "page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(fields, types, strict=True)], names=fields)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                for record in records(archive):
                    rows.append(record | {"archive": archive} | ({} if payload else {"payload": None}))
                    if len(rows) == 500:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return manifest.select("archive").mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, where: str, least_bytes: int = 1000) -> DataFrame:
    """Writes a record per row of pages under where and returns the manifest of archives.

    Of rows with equal payloads of least_bytes or more the one with the largest page_id is a response, the others revisit it.

    - null html counts as empty, null urls as ""; smaller payloads are always responses;
    - repeated rows with the group's largest page_id are all responses;
    - null page_ids revisit their group's response; a group of null ids is all responses;
    - an empty table gives no archives; columns other than page_id, url, html are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text_or_empty("url").alias("url"), text_or_empty("html").alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("strong"), F.octet_length("payload").alias("bytes")
    )
    scratch = Scratch(pages.sparkSession)
    groups = (
        rows.where(F.col("bytes") >= least_bytes)
        .groupBy("digest", "strong", "bytes")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    groups = scratch.table(groups, "groups")
    # small payloads have no group: a key of their own keeps equal ones (all empty pages) from meeting in one task
    alone = F.when(F.col("bytes") < least_bytes, F.xxhash64("page_id", "url")).otherwise(F.lit(0))
    kept = rows.withColumn("alone", alone).join(groups.withColumn("alone", F.lit(0).cast("long")), ["digest", "strong", "bytes", "alone"], "left")
    return scratch.table(write_archives(kept, where), "manifest")


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archive_pages(load(spark, sf_dir, "pages"), Scratch(spark).path("archives"))
    spread = manifest.repartition(max(1, manifest.count()), "archive")
    return read_archives(spread, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
             max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM g
"""
