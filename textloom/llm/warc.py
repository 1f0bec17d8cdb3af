"""WARC archives: a writer with payload revisits and a salvaging reader, as a Spark data source.

``df.write.format("textloom_warc")`` writes one gzip member (or one plain record) per row into archives of bounded size;
the files of a task count only once its commit is in the manifest, so a retried task leaves no second copy behind.
``spark.read.format("textloom_warc")`` reads one archive per partition: those in manifests, or in a folder without a manifest all
files ``*.warc`` and ``*.warc.gz``.  Files that no manifest names are rows of kind ``gap``, or read too with the option
``unlisted``.  Every record is checked: gzip CRC, version line, block
length, block digest, payload digest (SHA-1, SHA-2 or MD5; other algorithms are not checked).  Where a check fails, the reader searches byte by byte for the next member or version line at which a
whole record is valid, goes on from there, and returns the bytes between as a row of kind ``gap`` with the reason.

Defined cases: a null payload is empty; a null record id is written as ``null`` and read as null; control characters in
URLs are percent-encoded; an archive is read whole, so its size (``maxFileBytes`` for those written here) is the bound of a task's memory; a record larger than the size bound gets an archive of its own; no rows give an empty archive set.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

WRITE_SCHEMA = "record_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
READ_SCHEMA = (
    "file string, offset long, length long, kind string, reason string, record_type string, record_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)
ARROW = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("record_type", pa.string())]
    + [("record_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    + [("payload", pa.binary())]
)
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
URN = "urn:textloom:record:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 8 << 20
CHUNK = 1 << 14


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1 of a binary column: each five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_bytes(record_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record; with ``refers_to`` a revisit, which keeps the HTTP head and drops the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    name = "null" if record_id is None else record_id
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(ValueError):
    pass


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Named fields by lower-case name, the first of a name; a line that begins with white space goes on with the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            found[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Damaged("bad header")
        found.setdefault(name, value.strip())
    return found


def matches(data: bytes, written: str) -> bool | None:
    """Whether ``data`` has the digest ``algorithm:value`` (base32 or hexadecimal); None where it is not known how to tell."""
    algorithm, colon, value = written.partition(":")
    name = algorithm.lower().replace("-", "") if colon else "sha1"
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    own, value = hashlib.new(name, data), (value if colon else algorithm).strip()
    return value.lower() == own.hexdigest() or value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The plain record at ``at`` and where it ends; raises ``Damaged``.

    Field names have any case, and the blank after their colon may be missing.  The payload is the block, without the HTTP head where
    the block is an HTTP message.  A block digest is checked, and a payload digest unless the block's holds or the payload is left out.
    """
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header does not end")
    head = _headers(data[at:stop].split(b"\r\n")[1:])
    try:
        size = int(head["content-length"])
        name, kind = head["warc-record-id"], head["warc-type"].lower()
    except (ValueError, KeyError):
        raise Damaged("bad header") from None
    end = stop + 4 + size
    if size < 0 or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block of another length")
    block = data[stop + 4 : end]
    is_http = head.get("content-type", "").lower().startswith("application/http")
    http, blank, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    length = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)", http)
    revisit = kind == "revisit"
    of_block = matches(block, head["warc-block-digest"]) if "warc-block-digest" in head else None
    if of_block is False:
        raise Damaged("block of another digest")
    written = head.get("warc-payload-digest", "")
    if written and not revisit and not of_block and matches(payload, written) is False:
        raise Damaged("payload of another digest")
    number = lambda x: int(m[1]) if (m := re.search(rf"{URN}(\d+|-\d+)>", x)) else None
    record = {
        "record_type": kind,
        "record_id": number(name),
        "url": head.get("warc-target-uri"),
        "payload_bytes": int(length[1]) if revisit and length else len(payload),
        "payload_digest": (written.removeprefix("sha1:") or None) if revisit else digest_of(payload),
        "refers_to": number(head.get("warc-refers-to", "")),
        "payload": None if revisit else payload,
    }
    return record, end + 4


def record_at(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records at ``at`` (a plain one, or all of a gzip member) and where they end; raises ``Damaged``.

    The first record of a member has the member's bytes and the others none.  What is damaged inside a whole member is a gap without
    bytes, and the records after it are recovered.
    """
    if not data.startswith(MAGIC, at):
        record, end = parse(data, at)
        return [record | {"kind": "record", "offset": at, "length": end - at}], end
    unpacker, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and pos < len(data):
            parts.append(unpacker.decompress(data[pos : pos + CHUNK]))
            pos += CHUNK
            if len(parts) == 1 and not VERSION.match(parts[0]):
                raise Damaged("member without a version line")
    except zlib.error:
        raise Damaged("member fails its checks") from None
    if not unpacker.eof:
        raise Damaged("member does not end")
    whole, after = b"".join(parts), min(pos, len(data)) - len(unpacker.unused_data)
    found = list(salvage(whole, plain=True))
    if not any(r["kind"] == "record" for r in found):
        raise Damaged(found[0]["reason"])
    return [r | {"offset": at, "length": 0 if i else after - at} for i, r in enumerate(sorted(found, key=lambda r: r["kind"] == "gap"))], after


def salvage(data: bytes, plain: bool = False) -> Iterator[dict]:
    """All valid records of an archive and the gaps between them; ``plain``: of records that are not compressed."""
    at, bad, reason = 0, None, ""
    start = re.compile((b"" if plain else rb"\x1f\x8b\x08|") + VERSION.pattern)
    while at < len(data):
        try:
            records, end = record_at(data, at)
        except Damaged as why:
            if bad is None:
                bad, reason = at, str(why)
            found = start.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield {"offset": bad, "length": at - bad, "kind": "gap", "reason": reason}
            bad = None
        yield from records
        at = end
    if bad is not None:
        yield {"offset": bad, "length": len(data) - bad, "kind": "gap", "reason": reason}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


@dataclass
class _Archive(InputPartition):
    name: str
    #: the size of a file that no manifest names and that is only reported
    skipped: int | None = None


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, unlisted: bool = False) -> None:
        self.path, self.unlisted = path, unlisted

    def partitions(self) -> list[InputPartition]:
        store, root = _at(self.path)
        files = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        found = [f.path for f in files if f.base_name.startswith("_manifest-")]
        names = [n for f in sorted(found) for n in store.open_input_stream(f, compression=None).read().decode().split("\n") if n]
        listed = set(names)
        others = sorted((f.base_name, f.size) for f in files if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and f.base_name not in listed)
        skip = bool(found) and not self.unlisted
        return [_Archive(n) for n in names] + [_Archive(n, size if skip else None) for n, size in others] or [_Archive("")]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        if partition.skipped is not None:
            row = {"file": partition.name, "offset": 0, "length": partition.skipped, "kind": "gap", "reason": "not in a manifest"}
            yield pa.RecordBatch.from_pylist([row], ARROW)
            return
        store, root = _at(self.path)
        with store.open_input_stream(f"{root}/{partition.name}", compression=None) as f:
            data = f.read()
        rows: list[dict] = []
        held = 0
        for r in salvage(data):
            rows.append({"file": partition.name} | r)
            held += len(r.get("payload") or b"") + 200
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, compress: bool, most: int) -> None:
        self.path, self.compress, self.most = path, compress, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _at(self.path)
        store.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for b in iterator:
            for row in zip(*(b.column(c).to_pylist() for c in ("record_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")), strict=True):
                data = record_bytes(*row[:2], row[2] or b"", *row[3:])
                data = member(data) if self.compress else data
                if out is None or size + len(data) > self.most:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.compress)
                    out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _at(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}") as f:
            f.write("\n".join(n for m in messages if m for n in m.names).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = _at(self.path)
        for n in (n for m in messages if m for n in m.names):
            store.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    """Options: ``compress`` (default true) and ``maxFileBytes`` (default 32 MB) to write, ``unlisted`` (default false) to read."""

    @classmethod
    def name(cls) -> str:
        return "textloom_warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("unlisted", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("compress", "true") == "true", int(self.options.get("maxFileBytes", 32 << 20)))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows of ``WRITE_SCHEMA`` from ``pages(page_id, url, html)``.

    Of the pages with equal payloads of ``min_bytes`` or more, those with the smallest page_id stay responses and the others
    refer to it; repeated rows of that page stay responses too.  Only (digest, page_id) is grouped, with partial minima, so a
    payload that a third of the pages share costs one row per task; the join back splits such a key by its size.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("record_id"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", payload_digest(F.col("payload")))
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("record_id").alias("first_id"))
    other = (F.col("payload_bytes") >= min_bytes) & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    rows = rows.join(first, "payload_digest", "left").withColumn("refers_to", F.when(other, F.col("first_id")))
    return rows.select("record_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "refers_to")


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, compress: bool = True) -> None:
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    out = with_revisits(pages, min_bytes).write.format("textloom_warc").option("compress", str(compress).lower())
    out.mode("append").save(path)


def read_archives(spark: SparkSession, path: str, unlisted: bool = False) -> DataFrame:
    """Records and gaps of all archives of ``path`` (``READ_SCHEMA``); with ``unlisted`` also of those that no manifest names."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("textloom_warc").option("unlisted", str(unlisted).lower()).load(path)
