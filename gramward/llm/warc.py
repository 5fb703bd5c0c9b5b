"""WARC archives: a writer with revisit records, and a salvage reader.

The reader takes gzip members (or plain records) one by one from a file it reads forward. Where one fails its checks, it
searches for the next place where a valid member or version line begins, goes on there, and logs
the bytes between as a gap. A large archive is read by several tasks, each from its own place on.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramward.llm.common import materialise, scratch_path, slices, spread

#: Payloads below this many bytes are never deduplicated; an archive is closed beyond so many bytes.
REVISIT_BYTES, ARCHIVE_BYTES = 100, 8 << 20
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
_GZIP = b"\x1f\x8b\x08"
_PAGE = re.compile(r"<urn:page:(-?\d+)>")
#: Headers without which there is no record.
MANDATORY = ("warc-record-id", "warc-type", "warc-date")
#: Bytes of an archive that one task reads, and that are asked of the file at once.
RANGE_BYTES, READ_BYTES = 64 << 20, 1 << 18


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the response's headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url or '')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    head = VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass")
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str] = field(repr=False)
    block: bytes = field(repr=False)


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Source:
    """A file of random access (``size()``, ``read_at(count, at)``) that is read forward in blocks, of which two are held."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.held: dict[int, bytes] = {}
        self.next: dict[bytes, int] = {}

    def block(self, number: int) -> bytes:
        if number not in self.held:
            if len(self.held) > 1:
                self.held.pop(min(self.held, key=lambda k: -abs(k - number)))
            at = number * READ_BYTES
            self.held[number] = bytes(self.file.read_at(min(READ_BYTES, self.size - at), at))
        return self.held[number]

    def read(self, at: int, count: int) -> bytes:
        stop = min(at + count, self.size)
        parts = []
        while at < stop:
            number, start = divmod(at, READ_BYTES)
            part = self.block(number)[start : start + stop - at]
            parts.append(part)
            at += len(part)
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def find(self, what: bytes, at: int) -> int:
        """The first place of ``what`` from ``at`` on, the size if there is none. What was found ahead is not searched again."""
        known = self.next.get(what, -1)
        if known >= at:
            return known
        found = self.size
        while at < self.size:
            part = self.read(at, READ_BYTES)
            place = part.find(what)
            if place >= 0:
                found = at + place
                break
            at += max(1, len(part) - len(what) + 1) if at + len(part) < self.size else len(part)
        self.next[what] = found
        return found


class Buffer:
    """Bytes in memory as a file."""

    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, count: int, at: int) -> bytes:
        return self.data[at : at + count]


def _header(source: Source, at: int) -> tuple[dict[str, str], int]:
    """Headers by lower-case name, and where the block begins. It ends at the first line that is none, so damage is not read far."""
    headers, text, stop, first, seen, count = {}, b"", at, True, 0, 4096
    while True:
        end = text.find(b"\r\n", seen)
        if end < 0:
            more = source.read(stop, count)
            if not more:
                raise ValueError("header does not end")
            seen, text, stop, count = max(0, len(text) - 1), text + more, stop + len(more), 2 * count
            continue
        seen = 0
        line, text = text[:end], text[end + 2 :]
        if first:
            if not _VERSION_LINE.fullmatch(line + b"\r\n"):
                raise ValueError("no version line")
            first = False
        elif not line:
            return headers, stop - len(text)
        else:
            name, colon, value = line.decode("utf-8", "surrogatepass").partition(":")
            if not colon:
                raise ValueError("malformed header")
            headers[name.strip().lower()] = value.strip()


def parse(source: Source, at: int = 0) -> tuple[Record, int]:
    """The plain record at ``at`` and where it ends; ValueError where a check fails."""
    if not _VERSION_LINE.match(source.read(at, 10)):
        raise ValueError("no version line")
    headers, begin = _header(source, at)
    if any(name not in headers for name in MANDATORY):
        raise ValueError("mandatory header missing")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdecimal()):
        raise ValueError("no content length")
    end = begin + int(size)
    if end + 4 > source.size or source.read(end, 4) != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = source.read(begin, end - begin)
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError("block digest differs")
    return Record(at, end + 4 - at, headers, block), end + 4


def _member(source: Source, at: int) -> tuple[Record, int]:
    """The record of the gzip member at ``at``, checked by its CRC, and where the member ends. Only a slice is given to zlib at a time."""
    unpack, plain, stop = zlib.decompressobj(31), [], at
    while not unpack.eof:
        some = source.read(stop, 1 << 14)
        if not some:
            raise ValueError("gzip member does not end")
        try:
            plain.append(unpack.decompress(some))
        except zlib.error as why:
            raise ValueError(f"gzip: {why}") from None
        stop += len(some)
    end = stop - len(unpack.unused_data)
    whole = Source(Buffer(b"".join(plain)))
    found, stop = parse(whole)
    if stop != whole.size:
        raise ValueError("more than a record in a member")
    return Record(at, end - at, found.headers, found.block), end


def salvage(data: bytes | Source, first: int = 0, last: int | None = None) -> Iterator[Record | Gap]:
    """Every valid record of an archive in order, and the gaps between; together they cover all bytes.

    With ``first`` and ``last`` only records that begin there, as read from ``first`` on; a gap before the first of them is told too.
    """
    source = data if isinstance(data, Source) else Source(Buffer(data))
    at = gap = first
    last = source.size if last is None else last
    reason = ""
    while at < last:
        read = _member if source.read(at, 3) == _GZIP else parse
        try:
            found, end = read(source, at)
        except (ValueError, UnicodeDecodeError) as why:
            reason = reason or str(why)
            at = min(source.find(_GZIP, at + 1), source.find(b"WARC/", at + 1))
            continue
        if gap < at:
            yield Gap(gap, at - gap, reason)
        yield found
        at = gap = end
        reason = ""
    at = min(at, source.size)
    if gap < min(last, at):
        yield Gap(gap, min(last, at) - gap, reason)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with payload, payload_digest and refers_to.

    Equal payloads of at least 100 bytes refer to their smallest page_id; rows of that page_id
    itself, rows with a null one, and smaller payloads refer to none. Only digests that occur twice meet the pages: a written
    table, which is broadcast while it is small; beyond that each payload is shuffled once, and Spark splits the
    partition of a page that a third of the table copies.
    """
    full = spread(pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")))
    full = full.withColumn("payload_digest", F.sha2("payload", 256))
    large = full.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    twice = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = materialise(twice.select("payload_digest", "first"), "digests")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return full.join(twice, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", refers.cast("long").alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write gzip archives, a record for each row, into ``folder``; the manifest ``archive, records, bytes``.

    Archives are named by partition and attempt, so that no two attempts of a task write one file.
    The manifest lists those of the attempts that count; what a lost one left is not in it (see
    ``read_back``). ``folder`` is a URI of any file system that pyarrow knows.
    """
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        scheme = folder.rstrip("/").removesuffix(root.rstrip("/"))
        store.create_dir(root, recursive=True)
        task, number, held, count, out = TaskContext.get(), 0, io.BytesIO(), 0, []

        def close() -> None:
            nonlocal number, held, count
            if not count:
                return
            name = f"{root}/part-{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.warc.gz"
            with store.open_output_stream(name, compression=None) as file:
                file.write(held.getvalue())
            out.append((f"{scheme}{name}", count, held.tell()))
            number, held, count = number + 1, io.BytesIO(), 0

        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                plain = record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"])
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                held.write(pack.compress(plain) + pack.flush())
                count += 1
                if held.tell() >= archive_bytes:
                    close()
        close()
        columns = list(zip(*out, strict=True)) or [[], [], []]
        kinds = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    return pages.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, schema)


KINDS = {
    "archive": "string", "byte_offset": "long", "byte_length": "long", "gap": "string", "page_id": "long", "url": "string",
    "record_type": "string", "refers_to": "long", "payload": "binary", "payload_bytes": "long", "payload_digest": "string",
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _page(value: str) -> int | None:
    found = _PAGE.fullmatch(value)
    return int(found[1]) if found else None


def _row(path: str, found: Record | Gap, payloads: bool) -> dict:
    base = dict.fromkeys(KINDS) | {"archive": path, "byte_offset": found.offset, "byte_length": found.length}
    if isinstance(found, Gap):
        return base | {"gap": found.reason}
    head, _, payload = found.block.partition(b"\r\n\r\n")
    digest = found.headers.get("warc-payload-digest", "").partition(":")[2]
    kind = found.headers.get("warc-type", "")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        return base | {"gap": "payload digest differs"}
    return base | {
        "page_id": _page(found.headers.get("warc-record-id", "")), "url": found.headers.get("warc-target-uri"), "record_type": kind,
        "refers_to": _page(found.headers.get("warc-refers-to", "")), "payload": payload if kind == "response" and payloads else None,
        "payload_bytes": len(payload) if kind == "response" else int(length[1]) if length else None, "payload_digest": digest,
    }


def _open(path: str) -> Source:
    store, root = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")
    return Source(_At(store.open_input_file(root)))


class _At:
    def __init__(self, file: pa.NativeFile):
        self.file = file

    def size(self) -> int:
        return self.file.size()

    def read_at(self, count: int, at: int) -> bytes:
        return self.file.read_at(count, at)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of few bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["payload"] or b"")
        if len(held) == 256 or size > 8 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of ``archives(archive, bytes)``, see ``read_warc``.

    An archive of up to ``RANGE_BYTES`` is read by one task, record by record. A larger one is read by ranges: each task
    looks for the first valid record of its range and reads those that begin in it, to their end. Then, archive by
    archive, the offsets of all ranges (not the payloads) are put in order: a record that begins within an earlier one
    was found inside its payload and goes, and what no record covers is a gap.
    """
    spark = archives.sparkSession
    schema = pa.schema([(n, _ARROW[k]) for n, k in KINDS.items()])
    kinds = ", ".join(f"{n} {k}" for n, k in KINDS.items())
    rows = archives.select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("bytes") - 1, F.lit(0)) / RANGE_BYTES))).alias("k"))
    tasks = rows.agg(F.count("*")).first()[0]
    rows = rows.repartition(max(1, min(tasks, 1 << 16)))  # dealt evenly: few and large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = size <= RANGE_BYTES
                found = salvage(_open(path), k * RANGE_BYTES, None if whole else min(size, (k + 1) * RANGE_BYTES))
                yield from _batches((_row(path, x, payloads) for x in found if whole or isinstance(x, Record)), schema)

    small = rows.where(F.col("bytes") <= RANGE_BYTES).mapInArrow(run, kinds)
    large = rows.where(F.col("bytes") > RANGE_BYTES)
    if not archives.where(F.col("bytes") > RANGE_BYTES).head(1):
        return small
    found = materialise(large.mapInArrow(run, kinds), "ranges")
    spans = found.select("archive", "byte_offset", "byte_length").union(
        archives.where(F.col("bytes") > RANGE_BYTES).select("archive", "bytes", F.lit(0).cast("long"))
    ).repartition("archive").sortWithinPartitions("archive", "byte_offset")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each archive, the offsets that stand (kept) and the gaps between."""
        now, at = None, 0
        for batch in slices(batches, 8192):
            out = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != now:
                    now, at = path, 0
                if offset < at:
                    continue
                if offset > at:
                    out.append((path, at, offset - at, False))
                if length:
                    out.append((path, offset, length, True))
                at = offset + length
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["archive", "byte_offset", "byte_length", "kept"])

    standing = materialise(spans.mapInArrow(resolve, "archive string, byte_offset long, byte_length long, kept boolean"), "standing")
    kept = found.join(standing.where("kept").select("archive", "byte_offset"), ["archive", "byte_offset"], "left_semi").select(*KINDS)

    def reasons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A gap is read once more: for its reason, and for records that a range began within."""
        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches((_row(path, x, payloads) for x in salvage(_open(path), offset, offset + length)), schema)

    gaps = standing.where("not kept").select("archive", "byte_offset", "byte_length").repartition("archive", "byte_offset").mapInArrow(reasons, kinds)
    return small.union(kept).union(gaps)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records and gaps of all archives in ``folder``, of any size.

    Columns: archive, byte_offset, byte_length, gap (null for a record, else why), page_id, url,
    record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest. A response
    whose payload differs from its digest is a gap. A folder without archives gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(folder)
    return read_archives(files.select(F.col("path").alias("archive"), F.col("length").alias("bytes")))


def read_back(manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records of the manifest's archives.

    Archives that it does not list, as those of lost attempts, are not read.
    """
    found = read_archives(manifest.select("archive", "bytes"), payloads=False).where("gap is null")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each row, as read back from archives.

    Null html is an empty payload; repeated rows are records each, and all rows of the smallest
    page_id of a payload are responses. A null page_id is a response with a null id. Gaps, of which a sound store
    has none, are no rows here; ``read_warc`` has them. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    uri = folder if ":" in folder else f"file://{folder}"
    return read_back(materialise(write_warc(with_revisits(pages), uri), "manifest"))
