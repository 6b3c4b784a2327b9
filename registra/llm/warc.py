"""WARC archives: a writer and a Python data source that reads them.

Writer: one gzip member a record. The member's extra field ``SL`` has the lengths of the member and of the
record, so that a reader can go on to the next record without inflating this one. Records with equal
payloads of at least REVISIT_BYTES bytes: that with the smallest id is the response, the others revisit it
and carry no payload; its digest and length stand in the headers.

Reader (``spark.read.format("warc").load(folder)``): plans partitions from the folder's files by size; a
compressed file of more than PARTITION_BYTES is split, each part beginning with the first member at or
behind its place (a plain file is one partition, read as a stream). It takes equality, IN and prefix
predicates on record_type, target_uri, page_id and payload_digest, inflates a record's headers first, and
inflates the payload only if the record passes and payloads are asked for (option payload, default true).
Members without ``SL`` and plain files are read too, and blocks of all record types but revisits.

payload_digest is the payload's SHA-256 in lower-case hex: from the header where that states one, else
computed where payloads are asked for (a predicate on it then reads the payload), else null. stated_digest is
the header's own value, whatever its algorithm; a payload that is read is compared with it (sha1, sha256, sha512 or
md5, in hex or base32; option verify, default true).

Damaged records: ``damage`` says what is wrong, and what could be read is there: ``digest`` (the payload, with its
own digest), ``truncated`` (the file ends within the record; no payload), ``length`` (no sound Content-Length; no
payload), ``gzip`` (the member doesn't inflate) or ``header`` (no end of the headers, or no WARC record). Reading goes
on with the next member, or in plain files the next line ``WARC/1.``, behind the place of the damage.

Defined results: a null payload is empty; records that share the smallest id are all responses; a record
with a null id sorts last, so that it revisits if any record of its payload has an id, and else is a
response; control characters in a URL are percent-encoded; a null URL has no target; numbers in headers that are
none are null; extra columns are ignored; an empty table gives an empty archive, an empty folder no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PARTITION_BYTES = 32 << 20


def record_uuid(name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16])}>"


def member(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, length: int, refers: int | None) -> bytes:
    """One record as a gzip member."""
    http = (HTTP % length).encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uuid(f'page {page}')}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uuid(f'page {refers}')}", f"X-Refers-To-Page: {refers}"]
    raw = ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 20 + len(body) + 8
    extra = b"SL" + struct.pack("<HQQ", 16, size, len(raw))
    head_ = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head_ + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def write_warc(pages: DataFrame, path: str) -> DataFrame:
    """Archive pages (page_id, url, html) under path; eager. The files written: name, records."""
    from .common import prepare, written

    spark = prepare(pages.sparkSession, 256)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html").withColumns(
        {"digest": F.sha2(payload, 256), "bytes": F.octet_length(payload).cast("bigint")}
    )
    # Which records revisit is found without payloads and met by (id, digest), so that a page that very many records have
    # is spread by their ids when the payloads move.
    known = written(rows.filter(F.col("bytes") >= REVISIT_BYTES).select("page_id", "digest"), "digests")
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = known.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers"))).distinct()
    again = again.select(F.col("page_id").alias("p_"), F.col("digest").alias("d_"), "refers")
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("p_")) & (F.col("digest") == F.col("d_")), "left").drop("p_", "d_")
    joined = joined.withColumn("html", F.when(F.col("refers").isNull(), F.col("html")))
    joined = joined.select("page_id", "url", "html", "digest", "bytes", "refers")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        context, n = TaskContext.get(), 0
        name = f"pages-{context.partitionId():06d}.warc.gz"
        store, folder = fs.FileSystem.from_uri(path)
        own = f"{folder}/_{name}.{context.taskAttemptId()}"
        with store.open_output_stream(own) as f:
            for b in batches:
                for page, url, html, digest, size, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    kind = "response" if refers is None else "revisit"
                    f.write(member(kind, page, url, (html or "").encode() if refers is None else b"", digest, size, refers))
                    n += 1
        if n:
            store.move(own, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [n]})
        else:
            store.delete_file(own)

    made = joined.mapInArrow(write, "name string, records long").collect()
    return spark.createDataFrame(made, "name string, records long")


SCHEMA = (
    "record_type string, record_id string, target_uri string, page_id long, payload_bytes long,"
    " payload_digest string, refers_to long, payload binary, stated_digest string, damage string"
)
_PUSHED = {"record_type", "target_uri", "page_id", "payload_digest"}


class WarcPartition(InputPartition):
    def __init__(self, parts: list[tuple[str, int, int | None]]):
        """(file, from, to) with records that begin there; to is None for the whole file."""
        self.parts = parts


class Damaged(Exception):
    """A record that can't be read further: what is wrong, and the row so far."""

    def __init__(self, kind: str, row: dict | None = None):
        super().__init__(kind)
        self.kind, self.row = kind, row


MAGIC = b"\x1f\x8b\x08"
NEAR = 1 << 20  # bytes looked through at a time for the next record
LONGEST_HEAD = 1 << 20


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify, self.tests = path, payload, verify, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            ours = isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED
            if ours:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path)
        found = sorted(
            (x.path, x.size) for x in store.get_file_info(fs.FileSelector(folder, recursive=True))
            if x.is_file and not x.base_name.startswith((".", "_"))
        )
        out, held, size = [], [], 0
        for p, n in found:
            if n > PARTITION_BYTES and p.endswith(".gz"):
                out += [WarcPartition([(p, at, min(n, at + PARTITION_BYTES))]) for at in range(0, n, PARTITION_BYTES)]
                continue
            if held and size + n > PARTITION_BYTES:
                out.append(WarcPartition(held))
                held, size = [], 0
            held.append((p, 0, None))
            size += n
        return [*out, WarcPartition(held)] if held or not out else out

    def passes(self, row: dict, later: bool = False) -> bool:
        """later: the digest isn't known yet, so that predicates on it are left for later."""
        for f in self.tests:
            if later and f.attribute[0] == "payload_digest":
                continue
            x = row[f.attribute[0]]
            if x is None:
                return False
            if isinstance(f, EqualTo) and x != f.value or isinstance(f, In) and x not in f.value:
                return False
            if isinstance(f, StringStartsWith) and not x.startswith(f.value):
                return False
        return True

    def read(self, partition: WarcPartition) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        kinds = pa.schema(
            [("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
             ("stated_digest", pa.string()), ("damage", pa.string())]
        )
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path, start, end in partition.parts:
            with store.open_input_file(path) as f:
                for row in self.records(f, start, end):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 256 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, kinds)

    def records(self, f, at: int = 0, end: int | None = None) -> Iterator[dict]:
        """The records that begin in [at, end)."""
        size = f.size()
        end = size if end is None else end
        if at:
            at = self.next_member(f, at, size)
        while at < end:
            f.seek(at)
            zipped = f.read(3) == MAGIC
            try:
                row, behind = (self.zipped if zipped else self.plain)(f, at, size)
            except Damaged as e:
                row = e.row or dict.fromkeys(x.split()[0] for x in SCHEMA.split(", "))
                row |= {"damage": e.kind, "payload": None}
                behind = self.next_member(f, at + 1, size) if zipped else self.next_line(f, at + 1, size)
            if row is not None and self.passes(row):
                yield row
            at = behind

    def next_member(self, f, at: int, size: int) -> int:
        """The first place from `at` on where a gzip member with a record begins."""
        while at < size:
            f.seek(at)
            near = f.read(NEAR + 2)
            k = near.find(MAGIC)
            while k >= 0:
                f.seek(at + k)
                try:
                    if zlib.decompressobj(31).decompress(f.read(4096), 16).startswith(b"WARC/1."):
                        return at + k
                except zlib.error:
                    pass
                k = near.find(MAGIC, k + 1)
            at += NEAR
        return size

    def next_line(self, f, at: int, size: int) -> int:
        """The first place from `at` on where a line of a plain file begins with WARC/1."""
        while at < size:
            f.seek(at)
            near = f.read(NEAR + 8)
            k = near.find(b"\nWARC/1.")
            if k >= 0:
                return at + k + 1
            at += NEAR
        return size

    def zipped(self, f, at: int, size: int) -> tuple[dict | None, int]:
        """The record of the gzip member at this place, null if it doesn't pass, and the place behind it."""
        f.seek(at)
        head = f.read(32)
        known = struct.unpack("<Q", head[16:24])[0] if len(head) == 32 and head[3] & 4 and head[12:14] == b"SL" else None
        f.seek(at)
        inflate, raw, taken = zlib.decompressobj(31), bytearray(), 0

        def more(n: int) -> bool:
            """Inflate up to n more bytes."""
            nonlocal taken
            fed = inflate.unconsumed_tail
            if not fed:
                fed = f.read(min(1 << 16, (at + known if known else size) - f.tell()))
                taken += len(fed)
            try:
                out = inflate.decompress(fed, n)
            except zlib.error:
                raise Damaged("gzip", row) from None
            raw.extend(out)
            return bool(out or fed) and not inflate.eof

        row = None
        while b"\r\n\r\n" not in raw and len(raw) < LONGEST_HEAD and more(2048):
            pass
        row, length, body = self.head(bytes(raw), inflate.eof or len(raw) >= LONGEST_HEAD)
        if self.wanted(row):
            while len(raw) < body + length and more(1 << 16):
                pass
            if len(raw) < body + length:
                raise Damaged("truncated", row)
            self.attach(row, bytes(raw[body : body + length]))
        passes = self.passes(row)
        if known and at + known <= size:
            return row if passes else None, at + known
        while not inflate.eof and more(1 << 16):
            raw.clear()
        if not inflate.eof:
            raise Damaged("truncated", row)
        return row if passes else None, at + taken - len(inflate.unused_data)

    def plain(self, f, at: int, size: int) -> tuple[dict | None, int]:
        f.seek(at)
        raw = b""
        while b"\r\n\r\n" not in raw and len(raw) < LONGEST_HEAD and (x := f.read(2048)):
            raw += x
        row, length, body = self.head(raw, len(raw) >= LONGEST_HEAD or at + len(raw) < size)
        if at + body + length > size:
            raise Damaged("truncated", row)
        if self.wanted(row):
            f.seek(at + body)
            self.attach(row, f.read(length))
        behind = at + body + length
        f.seek(behind)
        return row if self.passes(row) else None, behind + (4 if f.read(4) == b"\r\n\r\n" else 0)

    def wanted(self, row: dict) -> bool:
        """Whether the payload has to be read: it is asked for, and the predicates that don't need it pass."""
        if not self.payload or row["record_type"] == "revisit":
            return False
        return self.passes(row, later=row["payload_digest"] is None)

    def head(self, raw: bytes, whole: bool) -> tuple[dict, int, int]:
        """From a record's start: its row without payload, the block's length, where the block begins. whole: there is no
        more of the record to read, so that headers without an end are no headers, and not cut off."""
        if not raw.startswith(b"WARC/1.") and (len(raw) >= 7 or whole):
            raise Damaged("header")
        if b"\r\n\r\n" not in raw:
            raise Damaged("header" if whole else "truncated")
        body = raw.index(b"\r\n\r\n") + 4
        fields, name = {}, ""
        for x in raw[: body - 4].decode(errors="replace").split("\r\n")[1:]:
            if x[:1] in (" ", "\t") and name:  # a folded line
                fields[name] += " " + x.strip()
                continue
            name, _, value = x.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()

        def number(x: str) -> int | None:
            v = fields.get(x, "")
            return int(v) if v.isascii() and v.removeprefix("-").isdigit() and len(v) < 19 else None

        stated = fields.get("warc-payload-digest") or None
        found = _digest(stated)
        row = {
            "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
            "target_uri": fields.get("warc-target-uri"), "page_id": number("x-page-id"),
            "payload_bytes": number("x-payload-length"), "payload_digest": found[1].hex() if found and found[0] == "sha256" else None,
            "refers_to": number("x-refers-to-page"), "payload": None, "stated_digest": stated, "damage": None,
        }
        length = number("content-length")
        if length is None or length < 0:
            raise Damaged("length", row)
        return row, length, body

    def attach(self, row: dict, block: bytes) -> None:
        http = (block.startswith(b"HTTP/") or row["record_type"] == "request") and b"\r\n\r\n" in block
        payload = block[block.index(b"\r\n\r\n") + 4 :] if http else block
        found = _digest(row["stated_digest"])
        if self.verify and found and hashlib.new(found[0], payload).digest() != found[1]:
            row["damage"] = "digest"
        row |= {"payload": payload, "payload_digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload)}


def _digest(stated: str | None) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a stated digest; null where they aren't known. A bare one of 64 hex digits is SHA-256."""
    name, colon, value = (stated or "").partition(":")
    if not colon:
        name, value = "sha256", name
    name = name.strip().lower().replace("-", "")
    if name not in {"sha1", "sha256", "sha512", "md5"}:
        return None
    size = hashlib.new(name).digest_size
    value = value.strip()
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (ValueError, binascii.Error):
        return None
    return (name, raw) if len(raw) == size else None


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        yes = lambda x: str(self.options.get(x, "true")).lower() == "true"
        return WarcReader(self.options["path"], yes("payload"), yes("verify"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The archives under path. Predicates reach the source by a session option, which stays, as plans are made after this
    returns."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch, table

    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
