"""WARC archives: written as one gzip stream, normalised to one member per record, indexed.

* ``write_archives`` writes monolithic ``.warc.gz`` files: a whole file is one gzip stream,
  so nothing in it can be read without all that comes before.
* ``normalise_archives`` inflates each such stream once, front to back in bounded memory,
  rewrites every record as a gzip member of its own and writes a sidecar index of offsets.
* ``read_records`` reads single records by the index.

Files go to a folder that driver and executors share, through ``pyarrow.fs``. Each attempt
of a task writes names of its own and only the names that finished tasks return are used,
so retried or doubled tasks do no harm. Revisits are decided by a map-side combined minimum
per digest of ids; digests that occur more than once are joined to the pages, by broadcast
where they are few, else the pages move by digest, and a hot digest is split as a skewed one.

Each record has the four fields that the standard asks for: type, id, date and length.

Defined results: null html is an empty payload and equal to any other empty one; payloads
under ``least`` bytes are all responses; of equal payloads the smallest page_id is the
response, and rows that repeat it with that payload are responses too; rows that share a
page_id but not the payload are judged each by its own payload; a null page_id revisits an equal
payload of any other id, is never referred to, and its record is named by a random UUID; a null url
leaves out the target; other columns are not read; an empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Bytes of payload after which a writer begins another archive.
ARCHIVE_BYTES = 64 << 20
LEVEL = 6
#: When the pages were captured, as far as it is known.
DATE = "1970-01-01T00:00:00Z"
_BLOCK = 1 << 20


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def firsts(pages: DataFrame, least: int = 0) -> DataFrame:
    """(digest, first) of the payloads among ``pages`` (page_id, html) that have revisits."""
    digests = pages.select("page_id", F.expr("sha1(coalesce(html, ''))").alias("digest"), F.expr("octet_length(coalesce(html, ''))").alias("n")).where(F.col("n") >= least)
    return digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null").select("digest", "first")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit has the full payload's digest and length, but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit")]
    fields += [("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<{uuid.uuid4().urn}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


#: Field names that are read, as the standard spells them.
WARC_FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest", "Content-Type", "Content-Length")
_PROPER = {f.lower(): f for f in WARC_FIELDS}


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields (names as in WARC_FIELDS, whatever their case), HTTP header and payload of one record.

    Lines that begin with white space continue the field before; a line without a colon is
    left out. A block that is no HTTP message is all payload.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = _PROPER.get(name.strip().lower(), name.strip())
            fields[name] = value.strip()
    block = rest[: int(fields["Content-Length"])]
    if not fields.get("Content-Type", "").lower().replace(" ", "").startswith("application/http"):
        return fields, b"", block
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; rows (path, records)."""
    import pyarrow as pa

    shared = scratch.materialize(firsts(pages, least), "firsts")
    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"), F.expr("sha1(coalesce(html, ''))").alias("digest")).join(shared, "digest", "left")
    rows = rows.select("page_id", "url", "html", F.expr("if(page_id is null or page_id > first, first, null)").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(folder)
        done, out, packer, held, n, path = [], None, None, 0, 0, ""

        def close() -> None:
            out.write(packer.flush())
            out.close()
            done.append((path, n))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k) for k in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    path, packer, held, n = f"{top}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                    out = fs.open_output_stream(path)
                data = record_bytes(page_id.as_py(), url.as_py(), html.as_py() or b"", refers_to.as_py(), date)
                out.write(packer.compress(data))
                held, n = held + len(data), n + 1
                if held >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    fs, top = _fs(folder)
    fs.create_dir(top, recursive=True)
    return scratch.materialize(rows.mapInArrow(write, "path string, records bigint"), "archives")


def _inflated(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip stream, read once; several members are read as one."""
    unpack = zlib.decompressobj(31)
    while data := stream.read(_BLOCK):
        while data:
            yield unpack.decompress(data, _BLOCK)
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(31)


def records_of(stream) -> Iterator[bytes]:
    """Each record of a gzipped WARC stream. Memory holds a record and a block."""
    held, parts = bytearray(), _inflated(stream)

    def fill(enough) -> bool:
        while not enough():
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while fill(lambda: b"\r\n\r\n" in held):
        head = held.index(b"\r\n\r\n") + 4
        size = next(int(x.split(b":", 1)[1]) for x in bytes(held[:head]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
        end = head + size + 4
        if not fill(lambda end=end: len(held) >= end):
            raise ValueError("the archive ends within a record")
        yield bytes(held[:end])
        del held[:end]


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite ``archives`` (path) below ``folder``; rows (path, index, records).

    The index has a JSON line per record: its name, offset and length in the new archive.
    """
    import pyarrow as pa

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(folder)
        done = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = f"{top}/{uuid.uuid4().hex}"
                offset = n = 0
                with fs.open_input_stream(path) as source, fs.open_output_stream(f"{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{name}.idx", compression=None) as index:
                    for data in records_of(source):
                        fields, _, _ = parse_record(data)
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = packer.compress(data) + packer.flush()
                        out.write(member)
                        index.write((json.dumps({"id": fields.get("WARC-Record-ID"), "offset": offset, "length": len(member)}) + "\n").encode())
                        offset, n = offset + len(member), n + 1
                done.append((f"{name}.warc.gz", f"{name}.idx", n))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "index", "records"])

    fs, top = _fs(folder)
    fs.create_dir(top, recursive=True)
    spread = archives.repartition(max(1, archives.count()), "path")
    return scratch.materialize(spread.mapInArrow(rewrite, "path string, index string, records bigint"), "normalised")


def read_records(archives: DataFrame, uri: str) -> DataFrame:
    """One row per response or revisit of normalised ``archives`` (path, index), read member by member.

    A response's payload is held against its digest, where it has one, and gets its own else;
    records of other kinds (warcinfo, request, metadata) give no row. Only ids of the form
    ``<urn:page:n>`` are page ids.
    """
    import pyarrow as pa

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(uri)
        number = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") else None
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                rows = []
                with fs.open_input_file(path) as source, fs.open_input_stream(index, compression=None) as lines:
                    for line in lines.read().splitlines():
                        at = json.loads(line)
                        fields, http, payload = parse_record(zlib.decompress(source.read_at(at["length"], at["offset"]), 31))
                        kind = fields.get("WARC-Type", "").lower()
                        if kind not in ("response", "revisit"):
                            continue
                        said = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        size = int(said[0]) if said else len(payload)
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        algorithm, _, digest = fields.get("WARC-Payload-Digest", f"sha1:{own}").rpartition(":")
                        if kind == "response" and (len(payload) != size or algorithm.lower() == "sha1" and digest != own):
                            raise ValueError(f"{path} at {at['offset']}: the payload differs from its digest")
                        rows.append((number(fields.get("WARC-Record-ID")), size, digest, kind, number(fields.get("WARC-Refers-To"))))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    spread = archives.repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    first, second = scratch.new_path(spark, "warc"), scratch.new_path(spark, "warc-members")
    normal = normalise_archives(write_archives(pages, first), second)
    scratch.remove(spark, first)
    return read_records(normal, second)


OP9_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as hex from p),
f as (select *, min(page_id) over (partition by hex) as first from d),
bits as (select *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (('0x' || substr('00' || hex, 3 + (i * 5) // 4, 2))::int >> (3 - ((i * 5) % 4)) & 31) + 1, 1)) as l from f)
select page_id, payload_bytes, array_to_string(l, '') as payload_digest,
       case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
       case when first is null or page_id = first then null else first end as refers_to
from bits
"""
