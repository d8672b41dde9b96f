"""WARC records in ZIP-packaged archives: written by the tasks, read by range from the archives' own directories.

An archive is a ZIP file with two stored members: archive/data.warc.gz, the records one after the other, each a gzip
member of its own, and indexes/index.json, a line for each record with its place.  A reader takes the end record, the ZIP64 end record where
it is used, and the central directory, finds both members' bytes from their local headers, and reads each record by
range; nothing is unpacked.  Of records with equal payloads (at least `least` bytes long) that with the largest id is
the response, the others are revisits of it without a body; their headers keep digest and length.

Roles come from a table of the payloads that occur more than once.  Spark broadcasts it if it is small, and then no payload
is shuffled; if not, payloads meet it by digest, frequent ones by broadcast, so that none fills a task.

Cases: null payload counts as empty; null URLs are written as empty; a row gives a record, repeated ones too: of an id with
several payloads each is judged by its own digest, and repeated rows with the largest id are all responses; a row with a null id is a
response under a record id of its own, which no other refers to, and is read back with a null id; other columns, whatever their names, are neither read nor returned; a payload is held whole in a task (Spark's
limit of 2 GB a value holds); an empty table gives no archives and no rows.  The shared folder is one that pyarrow opens:
file, hdfs, viewfs, s3 (s3a too), gs or abfs.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import joined, new_path, stored, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.json"
#: Bytes of records after which a task begins a new archive, and bytes of payload read at once.
ROLL, AHEAD = 256_000_000, 8_000_000


def record(page_id: int | None, url: str, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{f'none-{uuid.uuid4().hex}' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    body = b"" if kind == "revisit" else payload
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def filesystem(path: str):
    """(file system, path in it) of a folder that all executors share."""
    from pyarrow import fs

    path = path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def members(file) -> dict[str, tuple[int, int]]:
    """(start, length) of each stored member of an open ZIP file, ZIP64 or not."""
    size = file.size()
    tail_at = max(0, size - 65_557)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        place = tail.rfind(b"PK\x06\x07", 0, end)
        file.seek(struct.unpack("<Q", tail[place + 8 : place + 16])[0])
        big = file.read(56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", big[32:56])
    file.seek(start)
    directory, at, out = file.read(length), 0, {}
    for _ in range(count):
        method, = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, plain, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        header, = struct.unpack("<I", directory[at + 42 : at + 46])
        name, extra = directory[at + 46 : at + 46 + n_name].decode(), directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while extra:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, header))
            extra = extra[4 + n :]
        if method == 0:
            file.seek(header)
            local = file.read(30)
            out[name] = (header + 30 + sum(struct.unpack("<HH", local[26:30])), plain)
        at += 46 + n_name + n_extra + n_note
    return out


def with_roles(rows: DataFrame, least: int) -> DataFrame:
    """rows (id, payload, …) with kind and refers_to."""
    rows = rows.withColumn("digest", F.sha1("payload"))
    of = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    several = stored(of.where("n > 1"), "several")
    total = several.agg(F.sum("n")).first()[0] or 0
    last = joined(rows, several, "digest", total)
    revisit = F.coalesce((F.octet_length("payload") >= least) & (F.col("id") < F.col("last")), F.lit(False))
    return last.withColumn("kind", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("last")))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(archive, records): archives of all rows in `folder`; a list stored beside them names the ones that count."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    if dict(pages.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("page ids are whole numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        for archive, n in archives(fs, root, batches):
            yield pa.RecordBatch.from_pydict({"archive": pa.array([archive]), "records": pa.array([n], pa.int64())})

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = with_roles(rows, least).select("id", "url", "payload", "kind", "refers_to")
    return stored(rows.mapInArrow(run, "archive string, records bigint"), "archives")


def archives(fs, root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    """Write a task's records; each try of a task has names of its own, so a repeated one overwrites nothing."""
    index: list[str] = []
    out = package = data = None
    size = 0
    path = ""

    def close() -> tuple[str, int]:
        data.close()
        package.writestr(INDEX, "\n".join(index))
        package.close(), out.close()
        return path, len(index)

    for batch in batches:
        for page_id, url, payload, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                path, index, size = f"{root}/{uuid.uuid4().hex}.wacz", [], 0
                out = fs.open_output_stream(path)
                package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                data = package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            raw = gzip.compress(record(page_id, url.replace("\r", "%0D").replace("\n", "%0A"), kind, refers_to, digest, payload), compresslevel=1, mtime=0)
            data.write(raw)
            index.append(json.dumps({"id": page_id, "at": size, "length": len(raw)}))
            size += len(raw)
            if size >= ROLL:
                yield close()
                out = None
    if out is not None:
        yield close()


def read(listed: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes[, payload]) of every record, by the archives' indexes.

    A response whose payload has not the digest and length that its header states stops the job.
    """
    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    fields = fields if payloads else fields[:-1]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))[: len(fields)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with fs.open_input_file(archive) as file:
                    rows, held = [], 0
                    for row in records(file):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if held >= AHEAD:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return listed.select("archive").repartition(max(1, listed.count()), "archive").mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in fields))


def records(file) -> Iterator[tuple]:
    """The records of an open archive, each read by range from its place in the index."""
    places = members(file)
    start, length = places[INDEX]
    file.seek(start)
    lines = file.read(length).decode().split("\n")
    base, _ = places[DATA]
    for entry in map(json.loads, filter(None, lines)):
        file.seek(base + entry["at"])
        fields, body = parse_record(gzip.decompress(file.read(entry["length"])))
        kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        if kind == "response" and (n != len(body) or digest != base64.b32encode(hashlib.sha1(body).digest()).decode()):
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
        page, refers = (x[len("<urn:page:") : -1] for x in (fields["WARC-Record-ID"], fields.get("WARC-Refers-To", "")))
        yield None if page.startswith("none-") else int(page), kind, int(refers) if refers else None, digest, n, body if kind == "response" else None


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = new_path(spark, "warc")
    found = read(write(table(spark, sf_dir, "pages"), folder), folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
