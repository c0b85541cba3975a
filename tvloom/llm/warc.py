"""WARC archives as a Spark data source.

`spark.read.format("warc")` plans file partitions (large archives are cut at
record boundaries), parses the headers of a record first and decides by them;
the payload of a record that isn't wanted is skipped without being decoded.
Records are gzip members of their own that name their length in the member's
header (the skip-lengths field `sl` of the format's annex), so a skipped one is
never inflated beyond its headers. Archives without that field, and plain
`.warc` files, are read too.

Pushed down: equality, IN and null tests on record_type, record_id,
target_uri, content_type, payload_digest and refers_to, and as options `types`
(comma-joined record types), `header.<Name>` (exact value) and
`payload` ("false": no payload is decoded).

`df.write.format("warc")` writes columns record_type, record_id, target_uri,
date, content_type, refers_to, headers (map), payload, and sha1 where the payload is left out. A task writes files
under names of its own; the driver commits them by a manifest for each write, so files of
lost or repeated tasks are never read. An archive is what its manifests name: appending
adds one, overwriting removes those before it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

from .shared import bounded_batches, fresh, table, written

SCHEMA = "record_type string, record_id string, date string, target_uri string, content_type string, payload_digest string, refers_to string, headers map<string,string>, payload binary"
#: Columns that are headers, by name.
NAMES = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
MANIFEST = re.compile(r"_committed-[0-9a-f]+\.json")
ROLL_BYTES = 64_000_000
SPLIT_BYTES = 32_000_000
BATCH_BYTES = 8_000_000
HEAD_BYTES = 4_096
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Block of a response before its payload.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: str) -> str:
    """A header on one line. A value with a line break can't stand there, so it goes in JSON under a name of this writer's own."""
    if "\r" in value or "\n" in value or value != value.strip():
        return f"X-JSON-{name}: {json.dumps(value)}\r\n"
    return f"{name}: {value}\r\n"


def member(headers: dict[str, str], block: bytes, level: int = 1) -> bytes:
    """A record as one gzip member with its skip-lengths."""
    head = "WARC/1.1\r\n" + "".join(_line(name, value) for name, value in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    record = head.encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    # 10 bytes of header, 2 of extra length, 12 of extra field, the body, 8 of trailer
    if 32 + len(body) >= 1 << 32 or len(record) >= 1 << 32:  # the field can't hold it
        return gzip.compress(record, level, mtime=0)
    lengths = struct.pack("<II", 32 + len(body), len(record))
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) + lengths + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str | None, uri: str | None, date: str | None, content_type: str | None, refers_to: str | None, extra: dict[str, str], payload: bytes | None, sha1: bytes | None = None) -> bytes:
    """A record; a response's or revisit's block begins with an HTTP head, and a revisit's block ends there. sha1: of the payload, if it is left out."""
    payload = payload or b""
    headers = {"WARC-Type": kind}
    for name, value in (("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", content_type), ("WARC-Refers-To", refers_to)):
        if value is not None:
            headers[name] = value
    if kind == "revisit":
        headers["WARC-Profile"] = REVISIT
    if kind in ("response", "revisit"):
        headers["WARC-Payload-Digest"] = "sha1:" + (base64.b32encode(sha1).decode() if sha1 else digest(payload))
    headers |= extra
    block = HTTP_HEAD if kind == "revisit" else HTTP_HEAD + payload if kind == "response" else payload
    return member(headers, block)


@dataclass
class Committed(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= ROLL_BYTES:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                extra = dict(row.get("headers") or {})
                size += out.write(record(row["record_type"], row.get("record_id"), row.get("target_uri"), row.get("date"), row.get("content_type"), row.get("refers_to"), extra, row.get("payload"), row.get("sha1"))) or 0
        if out:
            out.close()
        return Committed(files)

    def commit(self, messages: list[Committed | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        before = _manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())
        for manifest in before:
            fs.delete_file(manifest)

    def abort(self, messages: list[Committed | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{root}/{f}")


def _manifests(fs: pyarrow.fs.FileSystem, root: str) -> list[str]:
    """The manifests of an archive; none if it has another writer."""
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    return [x.path for x in found if MANIFEST.fullmatch(x.base_name)]


@dataclass
class Range(InputPartition):
    """The records that begin in these ranges of files."""

    ranges: list[tuple[str, int, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, frozenset | None]] = []  # header name; accepted values, or None: any value
        if "types" in options:
            self.tests.append(("WARC-Type", frozenset(options["types"].split(","))))
        for key, value in options.items():
            if key.lower().startswith("header."):
                self.tests.append((key[7:], frozenset([value])))

    def pushFilters(self, filters):
        for f in filters:
            name = NAMES.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name is None:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((name, frozenset([f.value])))
            elif isinstance(f, In):
                self.tests.append((name, frozenset(f.value)))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, None))
            elif isinstance(f, IsNull):
                self.tests.append((name, frozenset([None])))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        manifests = [] if info.type == pyarrow.fs.FileType.File else _manifests(fs, root)
        if manifests:
            names = []
            for manifest in manifests:
                with fs.open_input_stream(manifest) as file:
                    names += [f"{root}/{f}" for f in json.loads(file.read())]
            infos = fs.get_file_info(names)
        else:
            infos = [info] if info.type == pyarrow.fs.FileType.File else [x for x in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if re.search(r"\.warc(\.gz)?$", x.path)]
        out, held = [Range([])], 0
        for info in sorted(infos, key=lambda x: x.path):
            for begin in range(0, info.size, SPLIT_BYTES):
                end = min(info.size, begin + SPLIT_BYTES)
                if held and held + end - begin > SPLIT_BYTES:
                    out.append(Range([]))
                    held = 0
                out[-1].ranges.append((info.path, begin, end))
                held += end - begin
        return out

    def wanted(self, headers: dict[str, str]) -> bool:
        lower = {k.lower(): v for k, v in headers.items()}
        for name, values in self.tests:
            value = lower.get(name.lower())
            if value is None if values is None else value not in values:
                return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        schema = pa.schema([(n, pa.string()) for n in NAMES] + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, size = [], 0
        for path, begin, end in partition.ranges:
            with fs.open_input_file(path) as file:
                for headers, payload in (gzip_records if _is_gzip(file) else plain_records)(file, begin, end, self.wanted, self.payload):
                    rows.append({n: headers.get(h) for n, h in NAMES.items()} | {"headers": list(headers.items()), "payload": payload})
                    size += len(payload or b"") + 1000
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def _is_gzip(file) -> bool:
    file.seek(0)
    return file.read(2) == b"\x1f\x8b"


def _headers(head: bytes) -> dict[str, str]:
    """Headers before the first empty line; the first line is the version."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon and name.startswith("X-JSON-"):
            out[name[7:].strip()] = json.loads(value)
        elif colon:
            out[name.strip()] = value.strip()
    return out


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """A block without the HTTP head of a response; its digest must hold."""
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("WARC-Type") == "response" else block
    named = headers.get("WARC-Payload-Digest", "")
    if headers.get("WARC-Type") == "response" and named.startswith("sha1:") and named[5:] != digest(payload):
        raise ValueError(f"payload digest of {headers.get('WARC-Record-ID')} doesn't hold")
    return payload


def _first_member(file, begin: int, end: int) -> int | None:
    """Where the first gzip member that holds a record begins, from begin up to end."""
    if begin == 0:
        return 0
    at = begin
    while at < end:
        file.seek(at)
        data = file.read(1 << 20)
        found = data.find(b"\x1f\x8b\x08")
        while 0 <= found < end - at:
            file.seek(at + found)
            try:
                if zlib.decompressobj(31).decompress(file.read(HEAD_BYTES), 5) == b"WARC/":
                    return at + found
            except zlib.error:
                pass
            found = data.find(b"\x1f\x8b\x08", found + 1)
        if len(data) < 1 << 20:
            return None
        at += len(data) - 2
    return None


def gzip_records(file, begin: int, end: int, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records whose member begins in begin..end-1."""
    at = _first_member(file, begin, end)
    total = file.size()
    while at is not None and at < min(end, total):
        file.seek(at)
        data = file.read(HEAD_BYTES)
        length = struct.unpack_from("<I", data, 16)[0] if data[3:4] == b"\x04" and data[12:14] == b"sl" else None
        unpacker = zlib.decompressobj(31)
        record = unpacker.decompress(data)
        while b"\r\n\r\n" not in record and not unpacker.eof:
            data = file.read(HEAD_BYTES)
            record += unpacker.decompress(data)
            if not data:
                break
        head, _, block = record.partition(b"\r\n\r\n")
        headers = _headers(head)
        keep = wanted(headers)
        decode = keep and payloads and headers.get("WARC-Type") != "revisit"
        parts = [block]
        if decode or length is None:
            while not unpacker.eof and (data := file.read(1 << 16)):
                part = unpacker.decompress(data)
                if decode:
                    parts.append(part)
        if keep:
            yield headers, _payload(headers, b"".join(parts)[: int(headers["Content-Length"])]) if decode else None
        at = at + length if length is not None else file.tell() - len(unpacker.unused_data)


def plain_records(file, begin: int, end: int, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of an uncompressed archive. Its records can only be found from the first, so its first range reads them all."""
    if begin:
        return
    at, total = 0, file.size()
    while at < total:
        file.seek(at)
        data = b""
        while b"\r\n\r\n" not in data and (more := file.read(HEAD_BYTES)):
            data += more
        head, _, _ = data.partition(b"\r\n\r\n")
        if not head.strip():
            return
        headers, start = _headers(head), at + len(head) + 4
        length = int(headers.get("Content-Length", 0))
        if wanted(headers):
            decode = payloads and headers.get("WARC-Type") != "revisit"
            if decode:
                file.seek(start)
            yield headers, _payload(headers, file.read(length)) if decode else None
        at = start + length + 4


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _name(id: Column, sha: Column, own: Column) -> Column:
    """A record's id: page id (after a slash; none if it is null), payload and what tells it from others of them."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.concat(F.lit("/"), id.cast("string")), F.lit("")), F.lit(":"), F.substring(sha, 1, 16), F.lit(":"), own, F.lit(">"))


def archive(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", html: str = "html", at_least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row of pages. Of equal payloads of at_least bytes or more, the row of the largest id is the
    response and the others revisit it; all smaller ones are responses. Null html is an empty payload. Record ids name the page."""
    register(pages.sparkSession)
    bounded_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8")
    rows = pages.select(pages[id].alias("id"), pages[url].alias("url"), payload.alias("payload")).withColumn("sha", F.sha2("payload", 256)).withColumn("sha1", F.unhex(F.sha1("payload")))
    # ids and digests alone tell which rows are equal; counts are summed before they move
    slim = written(rows.groupBy("sha", "sha1", "id", "url").agg(F.count(F.lit(1)).alias("times"), F.max(F.octet_length("payload")).alias("bytes")), "payloads")
    same = slim.where(F.col("bytes") >= at_least).groupBy("sha").agg(F.max(F.struct("id", "url")).alias("head"), F.sum("times").alias("n")).where("n > 1")
    heads = written(same.select("sha", F.col("head.id").alias("head_id"), F.col("head.url").alias("head_url"), F.lit(True).alias("copied")), "heads")
    repeated = written(slim.where("times > 1").select(F.col("sha").alias("r_sha"), F.col("id").alias("r_id"), F.col("url").alias("r_url"), "times"), "repeated")

    def records(rows: DataFrame, revisit: Column, own: Column, payload: Column) -> DataFrame:
        return rows.select(
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            _name(F.col("id"), F.col("sha"), own).alias("record_id"),
            F.col("url").alias("target_uri"),
            F.lit(date).alias("date"),
            F.lit("application/http;msgtype=response").alias("content_type"),
            F.when(revisit, _name(F.col("head_id"), F.col("sha"), F.lit("0"))).alias("refers_to"),
            F.create_map().cast("map<string,string>").alias("headers"),
            "sha1",
            payload.alias("payload"),
        )

    again = (F.col("sha") == F.col("r_sha")) & F.col("id").eqNullSafe(F.col("r_id")) & F.col("url").eqNullSafe(F.col("r_url"))
    known = rows.join(heads, "sha", "left").join(repeated, again, "left").drop("r_sha", "r_id", "r_url")
    copied = F.col("copied").isNotNull()
    is_head = copied & F.col("id").eqNullSafe(F.col("head_id")) & F.col("url").eqNullSafe(F.col("head_url"))
    place = F.lower(F.hex(F.xxhash64("url")))
    found = records(known.where("times is null"), copied & ~is_head, F.when(is_head, "0").otherwise(place), F.when(~copied | is_head, F.col("payload")))
    # rows equal in all columns, told apart by number: as many records as there are
    twins = known.where("times is not null").groupBy("sha", "sha1", "id", "url", "head_id", "head_url", "copied", "times").agg(F.any_value("payload").alias("payload"))
    twins = twins.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    first = is_head & (F.col("nth") == 0)
    own = F.when(is_head, F.col("nth").cast("string")).otherwise(F.concat(place, F.lit("-"), F.col("nth").cast("string")))
    found.unionByName(records(twins, copied & ~first, own, F.when(~copied | first, F.col("payload")))).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of the archives under path."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def page_of(name: Column) -> Column:
    """The page id in a record id of `archive`; null for a null one."""
    found = F.regexp_extract(name, r"(?s)^<urn:page:(.*):[0-9a-f]{16}:[0-9a-f-]+>$", 1)
    return F.when(found.startswith("/"), F.substr(found, F.lit(2)))


def revisited(records: DataFrame) -> DataFrame:
    """record_type, record_id, refers_to, payload_digest and payload_bytes of responses and revisits: the size of the payload
    that was read, and for a revisit that of the response it refers to, whose digest has to be its own."""
    slim = records.select("record_type", "record_id", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    slim = written(slim, "records")
    named = slim.where("record_type = 'response'").select(F.col("record_id").alias("r_id"), F.col("payload_bytes").alias("r_bytes"), F.col("payload_digest").alias("r_digest"))
    revisits = slim.where("record_type = 'revisit'")
    wanted = named.join(revisits.select(F.col("refers_to").alias("r_id")).distinct(), "r_id", "left_semi")
    broken = F.raise_error(F.concat(F.lit("revisit without its response: "), F.col("record_id")))
    found = revisits.join(wanted, revisits["refers_to"] == wanted["r_id"], "left")
    found = found.withColumn("payload_bytes", F.when(F.col("payload_digest") == F.col("r_digest"), F.col("r_bytes")).otherwise(broken.cast("long")))
    return slim.where("record_type <> 'revisit'").unionByName(found.select(slim.columns))


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all pages, written and read again; one row per page. Reading decodes each response and holds it to its digest."""
    path = fresh(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return revisited(read(spark, path)).select(
        page_of(F.col("record_id")).cast(kind).alias("page_id"),
        "payload_bytes",
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).cast(kind).alias("refers_to"),
    )
