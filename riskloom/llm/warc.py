"""WARC archives as a PySpark data source, and the writing of pages with revisit records for equal payloads.

An archive is plain text and compressed blocks: record headers are never compressed, and the block of a response holds
its payload with a gzip content coding. So a reader parses headers first, tests the pushed-down predicates on them, and
steps over the block of a record that is not wanted without reading or decoding it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from riskloom.session import checkpointed, run_folder

RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
COMPRESSION = 1
# Columns whose predicates are decided on the headers alone.
HEADER_COLUMNS = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to")
LISTING = "_archives-"  # how the names of listings begin


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI of any store pyarrow knows, and the path in it."""
    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path)


def _urn(page: int | None) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record_bytes(row) -> bytes:
    """One record. `row` has the columns of RECORD; a revisit has no payload and keeps its digest and length in headers."""
    block = b""
    if row["record_type"] == "response":
        coder = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
        body = coder.compress(bytes(row["payload"] or b"")) + coder.flush()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _urn(row["page_id"]),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]) if row["url"] is not None else None,
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "WARC-Payload-Length": str(row["payload_bytes"]),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row["record_type"] == "revisit" else None,
        "WARC-Refers-To": _urn(row["refers_to"]) if row["refers_to"] is not None else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


class Archive(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class WarcWriter(DataSourceWriter):
    """A file for each task attempt; only those of committed attempts are listed, so a repeated task leaves no doubles.

    Each write has a listing of its own, so that appending adds to what earlier writes listed.
    """

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Archive:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.warc"
        with store.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                out.write(record_bytes(row))
        return Archive(name)

    def commit(self, messages: list) -> None:
        store, folder = filesystem(self.path)
        store.create_dir(folder, recursive=True)
        before = _files(store, folder, LISTING) if self.overwrite else []
        with store.open_output_stream(f"{folder}/{LISTING}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(m.name for m in messages if m)).encode())
        for listing in before:
            store.delete_file(listing)

    def abort(self, messages: list) -> None:
        """Without a listing nothing of it is read."""


class OneFile(InputPartition):
    pass


def _files(store, folder: str, prefix: str = "", suffix: str = "") -> list[str]:
    """Paths of the files of a folder whose names begin and end so."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.startswith(prefix) and f.base_name.endswith(suffix))


class WarcReader(DataSourceReader):
    """A partition for each listed file, or for each `.warc` file of a folder without listings. Equality and IN on header columns are tested before a block is touched.

    Option `verify`: responses' lengths and digests are computed from the decoded payload instead of being taken from
    the headers. Option `payload` (default true): whether payloads are returned.
    """

    def __init__(self, path: str, verify: bool, payload: bool):
        self.path, self.verify, self.payload = path, verify, payload
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                have = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if have is None else have & values
            yield f  # Spark tests them again, which is as good and costs little

    def partitions(self):
        store, folder = filesystem(self.path)
        listings, names = _files(store, folder, LISTING), []
        for path in listings:
            with store.open_input_stream(path) as listing:
                names += [f"{folder}/{name}" for name in json.loads(listing.read())]
        return [OneFile(path) for path in (names if listings else _files(store, folder, suffix=".warc"))]

    def read(self, partition):
        store, _ = filesystem(self.path)
        with store.open_input_file(partition.value) as raw:
            size, at = raw.size(), 0
            while at < size:
                head, start = _header(raw, at)
                length = int(head["content-length"])
                at = start + length + 4
                digest = head.get("warc-payload-digest")
                row = {
                    "page_id": _page(head.get("warc-record-id")),
                    "url": head.get("warc-target-uri"),
                    "record_type": head.get("warc-type"),
                    "payload_digest": digest.removeprefix("sha1:") if digest else None,
                    "payload_bytes": int(head["warc-payload-length"]) if "warc-payload-length" in head else None,
                    "refers_to": _page(head.get("warc-refers-to")),
                }
                if any(row[name] not in values for name, values in self.wanted.items()):
                    continue
                body = None
                if (self.verify or self.payload) and row["record_type"] == "response":
                    raw.seek(start)
                    body = _payload(raw.read(length))
                    if self.verify:
                        row["payload_digest"], row["payload_bytes"] = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
                yield (*row.values(), body if self.payload else None)


def _payload(block: bytes) -> bytes:
    """The payload of an HTTP response: what follows its header, unpacked if that says it is packed."""
    head, _, body = block.partition(b"\r\n\r\n")
    return zlib.decompress(body, 31) if re.search(rb"(?im)^content-encoding:[ \t]*(x-)?gzip[ \t]*\r?$", head) else body


def _header(raw, at: int) -> tuple[dict[str, str], int]:
    """The header fields of the record at `at`, by lower-case name, and where its block begins."""
    step, held = 1024, b""
    while (end := held.find(b"\r\n\r\n")) < 0:
        raw.seek(at + len(held))
        more = raw.read(step)
        if not more:
            raise ValueError(f"a WARC header is cut off at byte {at}")
        held, step = held + more, step * 2
    lines = held[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, at + end + 4


class WarcSource(DataSource):
    """`spark.read.format("warc").load(folder)` and `df.write.format("warc").mode("append").save(folder)`; columns as in RECORD."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: T.StructType) -> WarcReader:
        flag = lambda key, default: self.options.get(key, default).lower() == "true"
        return WarcReader(self.options["path"], flag("verify", "false"), flag("payload", "true"))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _base32(digest: F.Column) -> F.Column:
    """Upper-case base32 of a SHA-1 given in hex: every five hex digits are four letters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = lambda i: F.conv(F.substring(digest, 1 + 5 * (i // 4), 5), 16, 10).cast("int")
    letters = [F.substring(F.lit(alphabet), F.shiftright(group(i), 15 - 5 * (i % 4)).bitwiseAND(31) + 1, F.lit(1)) for i in range(32)]
    return F.concat(*letters)


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records (RECORD) of `pages` (page_id, url, html).

    Of equal payloads of `least_bytes` or more, that with the greatest page_id is a response and the others revisit it;
    rows that repeat this page_id and payload are responses too, and so are payloads that no page_id names. Null html
    is empty. Equal payloads are those with the same SHA-1 and length.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur again are joined; stored, so that a hot payload can be split by adaptive execution.
    shared = checkpointed(groups.where("n > 1").drop("n"))
    joined = rows.join(shared, ["sha1", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        _base32(F.col("sha1")).alias("payload_digest"),
        "payload_bytes",
        F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the records of `pages` into archives and reads them back, responses checked against their payloads."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or run_folder(spark, "archives")
    records(pages, least_bytes).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").option("verify", "true").option("payload", "false").load(folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
