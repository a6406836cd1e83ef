"""WARC 1.1 archives as a PySpark data source.

Writing: each task writes one archive, one gzip member per record. A member's header carries the skip lengths that the
standard's annex on compression describes (extra field "sl": compressed and plain size of the member). Reading: one
partition per archive file; record types and header values that a query asks for are pushed into the scan, each record's
headers are parsed first, and a record that isn't wanted is passed over - by its skip lengths without inflating the rest,
else without keeping it. Payloads are only decoded if a column needs them.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from .common import checkpoint, small_batches
from .files import Written, drop_files, listed, make_folder, store, write_manifest

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, headers map<string,string>, entity_length long, payload_bytes long, payload_sha256 string, payload binary"
)
_HEADER_OF = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
_PAYLOAD = {"payload_bytes", "payload_sha256", "payload"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes | None, digest: str, entity: int, refers_to: str | None) -> bytes:
    """A response or revisit record: HTTP head, then the payload of a response."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {entity}\r\n\r\n".encode() + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(plain: bytes, level: int = 1) -> bytes:
    """One gzip member with its skip lengths."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(plain) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, record_type, target_uri, date, refers_to, payload_digest (hex SHA-256), payload (null for revisits), entity_length."""

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("file_bytes", 1 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = store(self.path)
        out, done, size = None, [], 0
        for batch in iterator:
            for row in zip(*(batch.column(c) for c in ("record_type", "record_id", "target_uri", "date", "payload", "payload_digest", "entity_length", "refers_to")), strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 17\r\n\r\nformat: WARC 1.1\n\r\n\r\n"
                    size += out.write(member(info.encode())) or 0
                one = member(record(*(x.as_py() for x in row)))
                out.write(one)
                size += len(one)
                if size >= self.most:
                    out.close()
                    done.append({"name": name, "bytes": size})
                    out = None
        if out is not None:
            out.close()
            done.append({"name": name, "bytes": size})
        return Written(done)

    def commit(self, messages) -> None:
        write_manifest(self.path, messages)

    def abort(self, messages) -> None:
        drop_files(self.path, messages)


class _Archive(InputPartition):
    def __init__(self, file: dict):
        self.file = file


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.names, self.schema = options["path"], schema.names, schema
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if column not in _HEADER_OF:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", {f.value}))
            elif isinstance(f, In):
                self.tests.append((column, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "has", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Archive(f) for f in listed(self.path, (".warc", ".warc.gz"))] or [_Archive({})]

    def wanted(self, fields: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            has = fields.get(_HEADER_OF[column])
            if has is None or kind == "in" and has not in value or kind == "starts" and not has.startswith(value):
                return False
        return True

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.file:
            return
        schema = to_arrow_schema(self.schema)
        fs, _ = store(self.path)
        rows, size = [], 0
        with fs.open_input_file(partition.file["path"]) as f:
            for fields, body in records(f, self.wanted, bool(_PAYLOAD & set(self.names))):
                rows.append(self.row(fields, body))
                size += len(body)
                if len(rows) >= 4096 or size >= 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def row(self, fields: dict[str, str], body: bytes) -> dict:
        out: dict = {c: fields.get(h) for c, h in _HEADER_OF.items() if c in self.names}
        http = body
        if fields.get("Content-Type", "").startswith("application/http"):
            head, _, http = body.partition(b"\r\n\r\n")
            if "entity_length" in self.names:
                lengths = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                out["entity_length"] = int(lengths[0]) if lengths else None
        elif "entity_length" in self.names:
            out["entity_length"] = int(fields.get("Content-Length", 0))
        if "headers" in self.names:
            out["headers"] = list(fields.items())
        if fields.get("WARC-Type") != "revisit":  # a revisit has no payload of its own
            out |= {k: v() for k, v in (("payload_bytes", lambda: len(http)), ("payload_sha256", lambda: hashlib.sha256(http).hexdigest()), ("payload", lambda: http)) if k in self.names}
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    for x in lines[1:]:
        k, _, v = x.partition(":")
        out[_NAMES.get(k.strip().lower(), k.strip())] = v.strip()
    return out


#: Names of headers don't depend on case: known ones are read as they are written here.
_NAMES = {h.lower(): h for h in (*_HEADER_OF.values(), "Content-Length", "Content-Type", "WARC-Profile")}


def records(f, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each wanted record of an open archive, gzip by record or plain. Without payload, of a block only its start."""
    total = f.size()
    at = 0
    while at < total:
        f.seek(at)
        start = f.read(24)
        if start[:2] == b"\x1f\x8b":
            skip = 0
            if start[3] & 4 and start[12:14] == b"sl":
                skip = struct.unpack("<I", start[16:20])[0]
            inflate = zlib.decompressobj(31)
            plain = b""
            feed = start + f.read((min(skip, 1 << 14) if skip else 1 << 14) - len(start))
            fed = len(feed)
            while b"\r\n\r\n" not in plain and not inflate.eof:
                if not feed:
                    feed = f.read(1 << 14)
                    fed += len(feed)
                    if not feed:
                        raise ValueError("the archive ends within a record")
                plain += inflate.decompress(feed, 1 << 13)
                feed = inflate.unconsumed_tail
            head, _, rest = plain.partition(b"\r\n\r\n")
            fields = _fields(head)
            take = wanted(fields)
            size = int(fields["Content-Length"])
            if skip and (not take or not payload and len(rest) >= min(size, 512)):
                at += skip
            else:
                kept = [rest]
                while not inflate.eof:
                    if not feed:
                        feed = f.read(1 << 18 if not skip else max(1, min(1 << 18, at + skip - (at + fed))))
                        fed += len(feed)
                        if not feed:
                            raise ValueError("the archive ends within a record")
                    part = inflate.decompress(feed, 1 << 20)
                    feed = inflate.unconsumed_tail
                    if take and payload:
                        kept.append(part)
                rest = b"".join(kept)
                at += skip or fed - len(inflate.unused_data)
        else:
            plain = start
            while b"\r\n\r\n" not in plain:
                more = f.read(4096)
                if not more:
                    raise ValueError("the archive ends within a record")
                plain += more
            head, _, rest = plain.partition(b"\r\n\r\n")
            fields = _fields(head)
            take = wanted(fields)
            size = int(fields["Content-Length"])
            if take and payload and len(rest) < size:
                rest += f.read(size - len(rest))
            at += len(head) + 4 + size + 4
        if take:
            yield fields, rest[:size]


def read_warc(spark, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records of an archive, or of all archives below a folder; only the columns named."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").schema(columns).load(path)


def write_warc(pages: DataFrame, path: str, least: int = 100, most_broadcast: int = 200_000) -> None:
    """Writes pages (page_id, url, html) as records: of equal payloads of at least `least` bytes the smallest page_id is the response, the others revisit it.

    A null html is an empty payload. Rows with a null page_id are responses and nothing refers to them; rows that repeat the
    smallest page_id of a payload are responses too. Only digests and ids are shuffled: the html goes straight from the
    scan to the archive, unless there are more revisits than `most_broadcast`.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.length(html).alias("n")).where(F.col("n") >= least)
    keys = keys.where("page_id is not null")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    revisits = checkpoint(keys.join(first, "digest").where("page_id > first").select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "first").distinct())
    if revisits.count() <= most_broadcast:
        revisits = F.broadcast(revisits)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(revisits, (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    rows = rows.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(again, name(F.col("first"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.length("payload").cast("long").alias("entity_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    spark.dataSource.register(Warc)
    make_folder(path)
    rows.write.format("warc").mode("append").save(path)


def page_records(spark, path: str) -> DataFrame:
    """What archives of pages hold: of a response its payload is read and hashed anew, of a revisit its headers tell."""
    found = read_warc(spark, path, "record_id string, record_type string, refers_to string, payload_digest string, entity_length long, payload_bytes long, payload_sha256 string")
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return found.where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"),
        F.coalesce("payload_bytes", "entity_length").alias("payload_bytes"),
        F.coalesce("payload_sha256", F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table, scratch_path

    path = scratch_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    return page_records(spark, path)


SQL = """
with p as (
  select page_id, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as first from pages
)
select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest,
  case when strlen(html) >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when strlen(html) >= 100 and page_id > first then first end as refers_to
from p
"""
