"""WARC archives: written whole, normalised to a member for each record with an offset index, and read back.

Writers put a partition's records into monolithic gzip files, as crawlers without seekable output do. The normaliser
inflates such a file once, from front to back in bounded memory, rewrites every record as a gzip member of its own,
and writes a sidecar index of offsets. Readers go by the sidecar, so one record is one seek and one small inflate.
Every attempt of a task writes files of its own name, and only those that its committed result names are read: a task
that runs twice, or beside a twin, in whatever order of rows, never mixes its bytes with another's offsets. Files of
attempts that failed stay in the folder until it is removed.
"""

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import saved, shared_dir, short_batches

#: Uncompressed bytes after which a writer begins another file.
FILE_BYTES = 128 << 20
_READ, _INFLATED = 1 << 18, 1 << 20
#: Records of an archive that are read in one go.
RANGE = 1000
#: Bytes of archives for each task that reads.
TASK_BYTES = 32 << 20
_LEVEL = 2
_EPOCH = "1970-01-01T00:00:00Z"
RANGES = "file string, start long, length long, records long, bytes long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A page's record has the same id wherever it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


@dataclass
class Record:
    """A record's headers, in order, and its block."""

    headers: dict[str, str]
    block: bytes = b""

    def head(self) -> bytes:
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}", "", ""]
        return "\r\n".join(lines).encode()

    def body(self) -> bytes:
        return self.head() + self.block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> Record:
    """A response with the payload, or a revisit that refers to the response with an equal payload and has none."""
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": _EPOCH}
    if url is not None:
        headers["WARC-Target-URI"] = "".join(c if c > " " else "%%%02X" % ord(c) for c in url)
    headers["WARC-Payload-Digest"] = f"sha1:{digest}"
    headers["Page-Id"] = "" if page_id is None else str(page_id)
    headers["Payload-Length"] = str(len(payload))
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first), "Refers-To-Page": str(first)}
    headers["Content-Type"] = "application/http; msgtype=response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return Record(headers, http + (b"" if revisit else payload))


class Parser:
    """Records out of a stream of bytes that comes in any portions."""

    def __init__(self):
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[Record]:
        self.held += data
        while (end := self.held.find(b"\r\n\r\n")) >= 0:
            lines = self.held[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            stop = end + 4 + int(headers.pop("Content-Length"))
            if len(self.held) < stop + 4:
                return
            yield Record(headers, bytes(self.held[end + 4 : stop]))
            del self.held[: stop + 4]

    def close(self) -> None:
        if self.held:
            raise ValueError("the last record is cut off")


def inflated(file) -> Iterator[bytes]:
    """The content of a gzip file, of one member or more, in portions of at most _INFLATED bytes but for the last."""
    member = zlib.decompressobj(31)
    while data := file.read(_READ):
        while data:
            yield member.decompress(data, _INFLATED)
            if member.eof:
                data, member = member.unused_data, zlib.decompressobj(31)
            else:
                data = member.unconsumed_tail
    yield member.flush()


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Folder:
    """A shared folder by its URI, in any store that pyarrow can open."""

    uri: str
    _fs: object = field(default=None, repr=False)

    def _at(self, name: str) -> tuple[pyarrow.fs.FileSystem, str]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")
        return fs, f"{root}/{name}"

    def read(self, name: str):
        fs, path = self._at(name)
        return fs.open_input_stream(path, compression=None, buffer_size=_READ)

    def read_at(self, name: str):
        fs, path = self._at(name)
        return fs.open_input_file(path)

    def write(self, name: str):
        """A file that gets its name when it is closed."""
        fs, path = self._at(name)
        fs.create_dir(os.path.dirname(path), recursive=True)
        return _Pending(fs, path)

    def remove(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete_file(path)


class _Pending:
    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.fs, self.path, self.own = fs, path, f"{path}.{uuid.uuid4().hex}"
        self.stream = fs.open_output_stream(self.own, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.size += len(data)
        return self.size

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind:
            self.fs.delete_file(self.own)
        else:
            self.fs.move(self.own, self.path)


def write_monolithic(folder: Folder, name: str, records: Iterable[Record]) -> int:
    """One gzip stream over all records; returns how many."""
    n = 0
    with folder.write(name) as file:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        for record in records:
            file.write(packer.compress(record.head()))
            file.write(packer.compress(record.block))
            file.write(packer.compress(b"\r\n\r\n"))
            n += 1
        file.write(packer.flush())
    return n


def normalise(folder: Folder, source: str, target: str) -> Iterator[tuple[str, int, int, str, str]]:
    """Rewrite every record of a gzip file as a member of its own; yields the index and writes it beside the target."""
    parser, at = Parser(), 0
    with folder.write(target) as file, folder.write(f"{target}.idx") as index:
        for data in inflated(folder.read(source)):
            for record in parser.feed(data):
                member = _gzip(record.body())
                end = file.write(member)
                row = (target, at, end - at, record.headers["WARC-Record-ID"], record.headers["WARC-Type"])
                index.write(_line(row[1:]))
                yield row
                at = end
        parser.close()


def read_record(file, offset: int, length: int) -> Record:
    """The record at a place of the index."""
    parser = Parser()
    data = b"".join(inflated(io.BytesIO(file.read_at(length, offset))))
    (record,) = parser.feed(data)
    parser.close()
    return record


def _page_result(record: Record) -> tuple:
    """page_id, payload_bytes, digest, kind and refers_to as the archive has them; a response's digest is checked."""
    h = record.headers
    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["Payload-Length"])
    if h["WARC-Type"] == "response":
        payload = record.block.split(b"\r\n\r\n", 1)[1]
        size = len(payload)
        if payload_digest(payload) != digest:
            raise ValueError(f"{h['WARC-Record-ID']} has another payload than its digest says")
    number = lambda x: int(x) if x else None
    return number(h["Page-Id"]), size, digest, h["WARC-Type"], number(h.get("Refers-To-Page"))


def planned(pages: DataFrame) -> DataFrame:
    """Pages with the least page_id of an equal payload; payloads are grouped by digest and length, not by text.

    Each digest's least page is a partial aggregate; the join back is one that Spark can split where it is skewed.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
    least = keyed.groupBy("sha1", "size").agg(F.min("page_id").alias("first"))
    return keyed.join(least, ["sha1", "size"]).select("page_id", "url", "payload", "first", (~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))


def _ranges(index: Iterator[tuple[str, int, int, str, str]], most: int = RANGE) -> Iterator[tuple[str, int, int, int, int]]:
    """Where runs of RANGE records lie in the sidecar: file, start and length there, records, and their bytes."""
    file, start, length, records, size = None, 0, 0, 0, 0
    for file, *row in index:
        length, records, size = length + len(_line(row)), records + 1, size + row[1]
        if records == most:
            yield file, start, length, records, size
            start, length, records, size = start + length, 0, 0, 0
    if records:
        yield file, start, length, records, size


def _line(row: Iterable[object]) -> bytes:
    return ("\t".join(map(str, row)) + "\n").encode()


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Write the pages to normalised archives under uri; returns the runs of their sidecars (RANGES).

    Its rows must be saved before they are read twice: computing them again writes other files.
    """
    folder = Folder(uri)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        rows = (row for batch in batches for row in zip(*(batch[k].to_pylist() for k in ("page_id", "url", "payload", "first", "revisit"))))
        row, n = next(rows, None), 0
        while row is not None:
            name = f"{own}-{n:04d}.warc.gz"

            def records() -> Iterator[Record]:
                nonlocal row
                size = 0
                while row is not None and size < FILE_BYTES:
                    page_id, url, payload, first, revisit = row
                    record = page_record(page_id, url, payload, payload_digest(payload), first, revisit)
                    size += len(record.head()) + len(record.block)
                    yield record
                    row = next(rows, None)

            write_monolithic(folder, f"whole/{name}", records())
            for found in _ranges(normalise(folder, f"whole/{name}", f"records/{name}")):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in found], ["file", "start", "length", "records", "bytes"])
            folder.remove(f"whole/{name}")
            n += 1

    return short_batches(planned(pages)).mapInArrow(run, RANGES)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(ranges: DataFrame, uri: str) -> DataFrame:
    """Each record of the ranges, read by the offset that its sidecar tells."""
    folder = Folder(uri)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, length in zip(*(batch[k].to_pylist() for k in ("file", "start", "length"))):
                lines = folder.read_at(f"{name}.idx").read_at(length, start).decode().splitlines()
                file = folder.read_at(name)
                found = [_page_result(read_record(file, *map(int, line.split("\t")[:2]))) for line in lines]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    tasks = -(-(ranges.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES)
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(tasks, cores), "file", "start").mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for each page under the shared folder, and read all of them back.

    Of pages with equal payloads (null: empty) the least page_id is the response, the others revisit it. Rows that
    repeat the least page_id are responses too. A null page_id comes after all others: such a page is a response only
    if all of its payload's pages lack an id. Columns besides page_id, url and html aren't read.
    """
    uri = shared_dir(pages.sparkSession)
    return read_archives(saved(write_archives(pages, uri)), uri)
