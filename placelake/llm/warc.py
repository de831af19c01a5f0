"""Conversion of legacy ARC archives to WARC.

An ARC file opens with a version block whose second line gives the version, and so the fields of the
header line of each record: five in version 1, ten in version 2. The last field is the length of the
content that follows. Every record becomes a WARC record with an identifier made from its archive and
place, the date in WARC's form, the type of its content and the digests of block and payload; equal
payloads are written once, other records revisit them.

Archives hold many records, plain or gzipped (as one member, or one per record), and are decompressed piece by
piece while they are read: a task holds an archive's stored bytes, one record and one batch of rows. What can't
be read of an archive, damaged or cut off, becomes a row with its ``error`` after the records that stand before
it; no archive fails the job. WARC files open with a ``warcinfo`` record and have one gzip member per record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

# The header lines of the two versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 32 << 20
"""What a WARC file holds before compression, or one record where that is longer."""
ARC_BYTES = 8 << 20
"""What an archive of ``write_arcs`` holds, or one record where that is longer."""
PIECE = 1 << 16
"""Bytes that are decompressed at once."""
BATCH_BYTES = 8 << 20
"""Payload bytes after which a batch of rows is passed on."""
RECORD = "archive string, position int, key long, url string, date string, mime string, digest string, payload_bytes long, head binary, payload binary, error string"
READ = "key long, record_id string, record_type string, target_uri string, date string, refers_to long, payload_digest string, payload_bytes long, payload binary, error string"
_KEY = re.compile(rb"(?im)^X-Source-Key:[ \t]*(-?[0-9]{1,19})[ \t]*\r?$")
_END = zlib.compress(b"", wbits=31)  # an empty gzip member


def _pieces(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive, plain or gzipped in any number of members, at most PIECE at a time."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + PIECE] for i in range(0, len(data), PIECE))
        return
    at = 0
    while at < len(data):
        member, fed = zlib.decompressobj(31), b""
        while not member.eof:
            piece = fed or data[at : at + PIECE]
            at += 0 if fed else len(piece)
            out = member.decompress(piece, PIECE)
            if not piece and not out and not member.eof:
                raise ValueError("a gzip member is cut off")
            fed = member.unconsumed_tail
            if out:
                yield out
        at -= len(member.unused_data)


class Stream:
    """An archive read from its start on; ``offset`` is the place in its decompressed bytes."""

    def __init__(self, data: bytes) -> None:
        self._pieces, self._buffer, self.offset = _pieces(data), bytearray(), 0

    def _fill(self, n: int) -> bool:
        while len(self._buffer) < n:
            piece = next(self._pieces, None)
            if piece is None:
                return False
            self._buffer += piece
        return True

    def take(self, n: int) -> bytes:
        if n < 0 or not self._fill(n):
            raise ValueError(f"a record of {n} bytes at {self.offset} is longer than its file")
        out = bytes(self._buffer[:n])
        del self._buffer[:n]
        self.offset += n
        return out

    def until(self, sign: bytes) -> bytes:
        """What stands before ``sign``, which is passed over."""
        start = 0
        while (cut := self._buffer.find(sign, start)) < 0:
            start = max(0, len(self._buffer) - len(sign) + 1)
            if not self._fill(len(self._buffer) + 1):
                raise ValueError(f"the header at {self.offset} has no end")
        return self.take(cut + len(sign))[:cut]

    def more(self, blanks: bytes = b"\r\n") -> bool:
        """Whether anything but ``blanks`` is left; those before it are passed over."""
        while self._fill(1):
            if self._buffer[0] not in blanks:
                return True
            self.take(1)
        return False


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the content of each record of an ARC file, its version block left out.

    Fields of a header line are cut from the right, so that a URL may hold spaces. Raises ValueError or zlib.error
    for a missing or unknown version, a header line of another form, a length beyond the file or damaged gzip, after
    the records that stand before it.
    """
    stream, version = Stream(data), 0
    while stream.more():
        at = stream.offset
        line = stream.until(b"\n").rstrip(b"\r").decode("utf-8", "surrogateescape")
        names = ARC_FIELDS[version or 1]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdecimal():
            raise ValueError(f"the header line at {at} hasn't {len(names)} fields that end in a length: {line[:80]!r}")
        content = stream.take(int(values[-1]))
        if version:
            yield dict(zip(names, values, strict=True)), content
            continue
        number = content.split(None, 1)[:1]
        if not line.startswith("filedesc:") or not number or not number[0].isdigit():
            raise ValueError("an ARC file starts with its version block")
        version = int(number[0])
        if version not in ARC_FIELDS:
            raise ValueError(f"ARC version {version} is unknown")


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    """``YYYYMMDDhhmmss``, or a prefix of it from the year on, in WARC's form."""
    d = (arc_date if arc_date.isdecimal() and len(arc_date) >= 4 else "1970").ljust(14, "0")
    month, day = (x if x != "00" else "01" for x in (d[4:6], d[6:8]))
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP head, with the empty line that ends it, and the payload; no head where the content has none."""
    if content.startswith(b"HTTP/"):
        cut = content.find(b"\r\n\r\n")
        if cut >= 0:
            return content[: cut + 4], content[cut + 4 :]
    return b"", content


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {StringType: pa.string(), IntegerType: pa.int32(), LongType: pa.int64(), BinaryType: pa.binary()}
    return [(f.name, kinds[type(f.dataType)]) for f in StructType.fromDDL(schema).fields]


def _batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most 256 rows, and about BATCH_BYTES of their binary columns."""
    heavy = [i for i, (_, kind) in enumerate(fields) if kind == pa.binary()]

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(row[i] or b"") for i in heavy)
        if len(held) == 256 or size >= BATCH_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def source_key(head: bytes) -> int | None:
    """The number in an HTTP head's X-Source-Key, if it has one that fits a long."""
    found = _KEY.search(head)
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def parse_arcs(arcs: DataFrame) -> DataFrame:
    """``arcs(archive, arc)``, each an ARC file, plain or gzipped -> a row per record, see RECORD.

    ``position`` is a record's place in its archive, ``key`` the X-Source-Key of its HTTP head or null. An archive that can't
    be read to its end has a last row with an ``error`` and nulls. A null or empty archive has no rows.
    """
    fields = _arrow(RECORD)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                archive, arc = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                position = 0
                try:
                    for f, content in arc_records(arc or b""):
                        head, payload = split_http(content)
                        url, mime = (f[c].encode("utf-8", "surrogateescape").decode("utf-8", "replace") for c in ("URL", "Content-type"))
                        yield archive, position, source_key(head), url, warc_date(f["Archive-date"]), mime, _digest(payload), len(payload), head, payload, None
                        position += 1
                except (ValueError, zlib.error) as e:
                    yield archive, position, *[None] * 8, str(e).encode("utf-8", "replace").decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), fields)

    return arcs.select("archive", "arc").mapInArrow(run, RECORD)


def read_arcs(spark: SparkSession, path: str, glob: str = "*.arc*") -> DataFrame:
    """The records of all ARC files under ``path``, see ``parse_arcs``; their archive is the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return parse_arcs(files.select(F.col("path").alias("archive"), F.col("content").alias("arc")))


def resolve_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``first`` (archive, position, key), null for responses: the record that a revisit refers to.

    Of records with equal payloads of at least ``least_bytes``, that with the smallest key is the response; null keys come last, and
    archive and position decide between equal ones. The others revisit it, but records with its very key, which are
    responses too. Rows with an ``error`` are no records and go.
    """
    good = records.where("error IS NULL")
    first = good.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "archive", "position")).alias("_first"), F.count("*").alias("_n")
    ).where("_n > 1").select("digest", F.struct("_first.archive", "_first.position", "_first.key").alias("_first"))
    itself = (F.col("archive").eqNullSafe(F.col("_first.archive")) & (F.col("position") == F.col("_first.position"))) | F.coalesce(F.col("key") == F.col("_first.key"), F.lit(False))
    revisit = F.col("_first").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~itself
    return good.join(first, "digest", "left").withColumn("first", F.when(revisit, F.col("_first"))).drop("_first")


def record_id(archive: str | None, position: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'placelake:{archive}:{position}')}>"


def _record(kind: str, lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _warc_record(row: dict, info: str) -> bytes:
    head, first = row["head"], row["first"]
    kind = "revisit" if first is not None else "response" if head else "resource"
    block = head + (row["payload"] if first is None else b"")
    lines = [f"WARC-Record-ID: {record_id(row['archive'], row['position'])}", f"WARC-Date: {row['date']}", f"WARC-Target-URI: {' '.join(row['url'].split())}", f"WARC-Warcinfo-ID: {info}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else row['mime']}", f"WARC-Payload-Digest: sha1:{row['digest']}", f"WARC-Block-Digest: sha1:{_digest(block)}"]
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first['archive'], first['position'])}"]
        lines += [f"X-Refers-To-Key: {first['key']}"] if first["key"] is not None else []
    # extension fields: what a payload's length was, and which source a record came from
    lines += [f"X-Payload-Length: {row['payload_bytes']}", *([f"X-Source-Key: {row['key']}"] if row["key"] is not None else [])]
    return _record(kind, lines, block)


def _warc_files(created: str, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per WARC file: a warcinfo record, then records until ``file_bytes`` are reached, each a gzip member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, files, info = bytearray(), 0, 0, ""
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if not out:
                    info = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'placelake:{created}:{TaskContext.get().partitionId()}:{files}')}>"
                    block = f"software: placelake\r\nformat: WARC File Format 1.1\r\nisPartOf: partition {TaskContext.get().partitionId()}\r\n".encode()
                    lines = [f"WARC-Record-ID: {info}", f"WARC-Date: {created}", "Content-Type: application/warc-fields", f"WARC-Block-Digest: sha1:{_digest(block)}"]
                    out += zlib.compress(_record("warcinfo", lines, block), wbits=31)
                record = _warc_record(row, info)
                out += zlib.compress(record, wbits=31)
                size += len(record)
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], ["value"])
                    out, size, files = bytearray(), 0, files + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], ["value"])

    return run


def _write_files(files: DataFrame, path: str, suffix: str) -> None:
    """Write ``files(value)``, each a gzipped file, through Spark's own text writer and commit protocol.

    The writer ends each line, so each file, with a separator: an empty gzip member, which readers pass over. It gives
    names that end in .txt; these are then changed on the driver, a call per file. A partition without rows leaves no file.
    """
    spark = files.sparkSession
    text = files.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", _END.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "part-*.txt")):
        if status.getLen():
            system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, status.getPath().getName().removesuffix(".txt") + suffix))
        else:
            system.delete(status.getPath(), False)


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write records of ``resolve_revisits`` as files *.warc.gz, each a warcinfo record and about ``file_bytes`` of others, a gzip member per record. Without records the folder stays empty."""
    created = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = records.select("archive", "position", "key", "url", "date", "mime", "digest", "payload_bytes", "head", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "first")
    _write_files(rows.mapInArrow(_warc_files(created, file_bytes), "value binary"), path, ".warc.gz")


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields, names in lower case, and the block of each record of a WARC file; raises ValueError or zlib.error where it is damaged or cut off."""
    stream = Stream(data)
    while stream.more():
        version, *lines = stream.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not fields.get("content-length", "").isdecimal():
            raise ValueError(f"no length in the record before {stream.offset}")
        yield fields, stream.take(int(fields["content-length"]))


def _read(data: bytes) -> Iterator[tuple]:
    try:
        for f, block in warc_records(data):
            name = f.get("warc-record-id")
            if f.get("warc-type") == "warcinfo":
                continue
            if f.get("warc-block-digest", "").startswith("sha1:") and "sha1:" + _digest(block) != f["warc-block-digest"]:
                yield None, name, *[None] * 7, "the block hasn't its digest"
                continue
            payload = split_http(block)[1] if f.get("content-type", "").startswith("application/http") else block
            whole = f.get("warc-type") != "revisit"
            digest = _digest(payload) if whole else f.get("warc-payload-digest", "").removeprefix("sha1:")
            key, refers, size = (int(f[c]) if re.fullmatch("-?[0-9]{1,18}", f.get(c, "")) else None for c in ("x-source-key", "x-refers-to-key", "x-payload-length"))
            yield key, name, f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"), refers, digest, len(payload) if whole else size, payload if whole else None, None
    except (ValueError, zlib.error) as e:
        yield *[None] * 9, str(e)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under ``path``, gzipped or not, see READ; payload is null for revisits, digests are recomputed.

    A record whose block hasn't its digest, and the rest of a file that is damaged or cut off, is a row with an ``error``.
    """
    fields = _arrow(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for batch in batches for content in batch.column(0) for row in _read(content.as_py())), fields)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, READ)


def _arc_record(row: dict, version: int, name: str, offset: int) -> bytes:
    key = f"X-Source-Key: {row['key']}\r\n" if row["key"] is not None else ""
    content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(row['payload'] or b'')}\r\n\r\n".encode() + (row["payload"] or b"")
    line = [re.sub(r"\s", "%20", row["url"] or ""), "0.0.0.0", row["date"] or "-", "text/html"]
    line += ["200", "-", "-", str(offset), name] if version == 2 else []
    return " ".join([*line, str(len(content))]).encode("utf-8", "surrogateescape") + b"\n" + content + b"\n"


def arc_archives(pages: DataFrame, archive_bytes: int = ARC_BYTES, versions: tuple[int, ...] = (1, 2), gzip: bool = False) -> DataFrame:
    """(archive, arc): ``pages(key, url, date, payload)`` as ARC files of many records, about ``archive_bytes`` each, of the versions in turn.

    Null payloads are empty, spaces in a URL are written as %20, as crawlers did, and a key goes into the HTTP head. With ``gzip``
    each record is a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "url", "date", "payload")
        out, offset, n = bytearray(), 0, 0

        def add(record: bytes) -> None:
            nonlocal out, offset
            out += zlib.compress(record, wbits=31) if gzip else record
            offset += len(record)

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([bytes(out)], pa.binary())], ["archive", "arc"])

        for batch in batches:
            for i in range(batch.num_rows):
                if not out:
                    version, name = versions[n % len(versions)], f"pages-{TaskContext.get().partitionId():06d}-{n:06d}.arc{'.gz' if gzip else ''}"
                    info = f"{version} 0 placelake\n{' '.join(ARC_FIELDS[version])}\n\n"
                    add(f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {len(info)}\n{info}".encode())
                add(_arc_record({c: batch.column(j)[i].as_py() for j, c in enumerate(names)}, version, name, len(out)))
                if offset >= archive_bytes:
                    yield archive()
                    out, offset, n = bytearray(), 0, n + 1
        if out:
            yield archive()

    return pages.select("key", "url", "date", F.col("payload").cast("binary").alias("payload")).mapInArrow(run, "archive string, arc binary")


def write_arcs(pages: DataFrame, path: str, archive_bytes: int = ARC_BYTES, versions: tuple[int, ...] = (1, 2)) -> None:
    """Write ``arc_archives`` as files *.arc.gz, a gzip member per record."""
    _write_files(arc_archives(pages, archive_bytes, versions, gzip=True).select(F.col("arc").alias("value")), path, ".arc.gz")
