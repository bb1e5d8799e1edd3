"""Operator 12: web archives whose records are gzip members of their own, with an index of where each lies.

Pages are first written as archives that are one gzip stream each, the form in which a whole file can only be read from its start. The normaliser
inflates each stream once, a record at a time, writes every record as its own member, and beside the archives an index
with a row for each record: its file, offset and length. Readers then go to any record, or read any part of a file, without the rest.

Equal payloads (SHA-256) of at least `LEAST` bytes are kept once: the record with the smallest page id is the response; the normaliser turns the
others into revisits, which name it and have the payload's digest and length but not the payload. Only digests and ids are shuffled, never payloads;
a payload that a third of all pages share is joined apart (`vectors.with_key`).

Files are written under names of the task's attempt, and what the index lists is what Spark has committed, so lost executors and repeated tasks
leave at most files that nothing names. They go to the shared folder, or a folder that is given, by the store's own interface: hdfs, s3 or local.

Null html: an empty payload. Null or odd urls: `urn:page:<id>`, or with their spaces and control characters escaped. Rows with a null page id
are revisits where another row has the payload. Rows that repeat id and payload: one is the response, the others revisit it. Very long
payloads are copied through in pieces. Empty table: no archives, no rows. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, slices, tidy
from weftline.llm.vectors import with_key
from weftline.shared import store

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Bytes of payload after which an archive is closed.
ARCHIVE_BYTES = 64 << 20
#: Bytes of members that are read at once, and of a block that are copied at once.
PIECE = 4 << 20
#: Tasks that rewrite or read archives, at most; with fewer archives, or fewer times 4 PIECE bytes, one for each.
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RAW = "file string, ordinal long, page_id long, url string, payload_digest string, payload_bytes long"
INDEX = "file string, offset long, length long, page_id long, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(file: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{ordinal}')}>"


def header(fields: dict[str, str | int | None]) -> bytes:
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode("utf-8", "surrogatepass") + b"\r\n"


def parsed(lines: bytes) -> dict[str, str]:
    """Names in lower case, and values."""
    pairs = (x.partition(":") for x in lines.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def target(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0]), url) if url else f"urn:page:{'' if page_id is None else page_id}"


def http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def response(page_id: int | None, url: str | None, payload: bytes, digest: str, file: str, ordinal: int) -> list[bytes]:
    head = http(len(payload))
    fields = {"WARC-Type": "response", "WARC-Record-ID": record_id(file, ordinal), "WARC-Date": DATE, "WARC-Target-URI": target(url, page_id), "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-ID": page_id, "Content-Type": "application/http; msgtype=response", "Content-Length": len(head) + len(payload)}
    return [header(fields), head, payload, END]


class Member:
    """A gzip member that is written to out as it is fed; the same bytes give the same member."""

    def __init__(self, out: BinaryIO, level: int):
        self.out, self.zip, self.length = out, zlib.compressobj(level, zlib.DEFLATED, 31), 0

    def _put(self, data: bytes) -> None:
        self.length += len(data)
        self.out.write(data)

    def write(self, data: bytes) -> None:
        self._put(self.zip.compress(data))

    def close(self) -> int:
        self._put(self.zip.flush())
        return self.length


def _name(kind: str, k: int) -> str:
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId():012x}-{k:04d}.warc.gz"


def _written(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        out, whole, name, files, ordinal, held = None, None, "", 0, 0, 0
        for b in batches:
            for part in slices(b, 2, 8 << 20):
                rows = []
                for page_id, url, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if out is None:
                        name, ordinal, held = _name("stream", files), 0, 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        whole, files = Member(out, 1), files + 1
                    digest = hashlib.sha256(payload).hexdigest()
                    for piece in response(page_id, url, payload, digest, name, ordinal):
                        whole.write(piece)
                    rows.append((name, ordinal, page_id, url, digest, len(payload)))
                    ordinal, held = ordinal + 1, held + len(payload)
                    if held >= most:
                        whole.close()
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pydict(dict(zip(_names(RAW), zip(*rows, strict=True), strict=True)), _arrow(RAW))
        if out is not None:
            whole.close()
            out.close()

    return run


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if kind == "long" else pa.string()) for n, kind in (x.split() for x in ddl.split(", "))])


def write_streams(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", most: int = ARCHIVE_BYTES) -> DataFrame:
    """Lazily: a row for each page, as it is written to archives in folder that are one gzip stream each."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    return p.mapInArrow(tidy(_written(folder, most)), RAW)


def repeats(raw: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """file and ordinal of the records whose payload another has to keep, and that one's page_id, url, file and ordinal, under `first`."""
    large = raw.filter(F.col("payload_bytes") >= least)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "ordinal", "url")).alias("first")
    same = scratch.save(large.groupBy("payload_digest").agg(F.count("*").alias("n"), first).filter("n > 1"), "same")
    total = same.agg(F.sum("n")).first()[0] or 0
    rows = large.select("file", "ordinal", "payload_digest")
    return with_key(rows, same, "payload_digest", total).filter("file != first.file or ordinal != first.ordinal").select("file", "ordinal", "first")


def _records(stream: BinaryIO) -> Iterator[dict[str, str]]:
    """Headers of the records of an inflated stream; the caller reads each one's block, of its Content-Length, before the next."""
    while line := stream.readline():
        if line != VERSION:
            raise ValueError(f"no record begins here: {line[:40]!r}")
        lines = [line]
        while (line := stream.readline()) not in (b"\r\n", b""):
            lines.append(line)
        yield parsed(b"".join(lines))
        if stream.read(4) != END:
            raise ValueError("a record doesn't end where its length says")


def _revisit(fields: dict[str, str], head: bytes, first: dict) -> list[bytes]:
    own = {"WARC-Type": "revisit", "WARC-Record-ID": fields["warc-record-id"], "WARC-Date": fields["warc-date"], "WARC-Target-URI": fields["warc-target-uri"], "WARC-Profile": IDENTICAL, "WARC-Refers-To": record_id(first["file"], first["ordinal"]), "WARC-Refers-To-Target-URI": target(first["url"], first["page_id"])}
    own |= {"WARC-Refers-To-Date": DATE, "WARC-Payload-Digest": fields["warc-payload-digest"], "X-Page-ID": fields.get("x-page-id"), "X-Refers-To-Page-ID": first["page_id"], "Content-Type": fields["content-type"], "Content-Length": len(head)}
    return [header(own), head, END]


def _copied(stream: BinaryIO, n: int, put) -> None:
    while n:
        piece = stream.read(min(n, PIECE))
        if not piece:
            raise ValueError("the stream ends within a record")
        put(piece)
        n -= len(piece)


def _own_members(source: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (from_, at), (to, root) = store(source), store(folder)
        to.create_dir(root, recursive=True)
        rows = (r for b in batches for part in slices(b, 0, 1 << 16) for r in part.to_pylist())
        for k, (file, changes) in enumerate(itertools.groupby(rows, key=lambda r: r["file"])):
            name, offset, index = _name("pages", k), 0, []
            change = next((c for c in changes if c["ordinal"] is not None), None)  # each file has a row without ordinal, first
            with from_.open_input_stream(f"{at}/{file}", compression=None) as packed, gzip.GzipFile(fileobj=packed) as stream, to.open_output_stream(f"{root}/{name}", compression=None) as out:
                for ordinal, fields in enumerate(_records(stream)):
                    member, n, kind = Member(out, 6), int(fields["content-length"]), fields["warc-type"]
                    if change and change["ordinal"] == ordinal:
                        head = []
                        while not head or head[-1] not in (b"\r\n", b""):
                            head.append(stream.readline())
                        _copied(stream, n - sum(map(len, head)), lambda _: None)
                        for piece in _revisit(fields, b"".join(head), change["first"]):
                            member.write(piece)
                        change, kind = next(changes, None), "revisit"
                    else:
                        member.write(header({_PROPER.get(f, f): v for f, v in fields.items()}))
                        _copied(stream, n, member.write)
                        member.write(END)
                    length = member.close()
                    index.append((name, offset, length, int(fields["x-page-id"]) if "x-page-id" in fields else None, kind))
                    offset += length
                    if len(index) == 10_000:
                        yield _index(index)
                        index = []
            if index:
                yield _index(index)

    return run


#: Names as the format writes them.
_PROPER = {
    "warc-type": "WARC-Type", "warc-record-id": "WARC-Record-ID", "warc-date": "WARC-Date", "warc-target-uri": "WARC-Target-URI", "warc-payload-digest": "WARC-Payload-Digest",
    "x-page-id": "X-Page-ID", "content-type": "Content-Type", "content-length": "Content-Length",
}


def _index(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(_names(INDEX), zip(*rows, strict=True), strict=True)), _arrow(INDEX))


def normalised(files: DataFrame, source: str, folder: str, changes: DataFrame | None = None) -> DataFrame:
    """Lazily: the index, as the archives of source that files (file) names are rewritten to folder with a member for each record.

    changes (file, ordinal, first) says which records, by their place in their file, become revisits of which. A task holds a record's piece and a
    change at a time, not a file.
    """
    first = "struct<page_id: bigint, file: string, ordinal: bigint, url: string>"
    d = files.select("file", F.lit(None).cast("long").alias("ordinal"), F.lit(None).cast(first).alias("first"))
    if changes is not None:
        d = d.unionByName(changes.select("file", "ordinal", F.struct(*(F.col(f"first.{c}") for c in ("page_id", "file", "ordinal", "url"))).alias("first")))
    tasks = min(max(1, files.count()), MOST_TASKS)  # said in numbers: the rows are few, and would else be put together in a task or two
    return d.repartitionByRange(tasks, "file").sortWithinPartitions("file", F.col("ordinal").asc_nulls_first()).mapInArrow(tidy(_own_members(source, folder)), INDEX)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        for file, own in itertools.groupby(rows, key=lambda r: r[0]):
            with fs.open_input_file(f"{root}/{file}") as f:
                for start, run_of in _runs(own):
                    f.seek(start)
                    data = memoryview(f.read(sum(run_of)))
                    out, at = [], 0
                    for n in run_of:
                        out.append(read_member(data[at : at + n]))
                        at += n
                    yield pa.RecordBatch.from_pydict(dict(zip(_names(RECORDS), zip(*out, strict=True), strict=True)), _arrow(RECORDS))

    return run


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[int, list[int]]]:
    """Members that lie next to one another, up to PIECE bytes of them: where they start, and their lengths."""
    start, lengths, end = 0, [], 0
    for _, offset, length in rows:
        if lengths and (offset != end or end - start + length > PIECE):
            yield start, lengths
            lengths = []
        if not lengths:
            start = offset
        lengths.append(length)
        end = offset + length
    if lengths:
        yield start, lengths


def read_member(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the record in a member; its payload is held against its digest."""
    raw = gzip.decompress(data)
    at = raw.index(END) + len(END)
    fields = parsed(raw[:at])
    end = at + int(fields["content-length"])
    if raw[end:] != END:
        raise ValueError("a record doesn't end where its length says")
    body = raw.index(END, at, end) + len(END)
    size, digest = int(parsed(raw[at:body])["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response":
        payload = memoryview(raw)[body:end]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of record {fields['warc-record-id']} isn't what was written")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("x-page-id"), size, digest, fields["warc-type"], number("x-refers-to-page-id")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that index lists, read from the archives in folder at their offsets, parts of a file in different tasks."""
    i = index.select("file", "offset", "length")
    tasks = min(max(1, -(-(i.agg(F.sum("length")).first()[0] or 0) // (4 * PIECE))), MOST_TASKS)
    i = i.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return i.mapInArrow(tidy(_read(folder)), RECORDS)


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST, **columns) -> tuple[DataFrame, str]:
    """Writes the archives of pages to folder, or to the shared folder, and their index beside them; the index, and the folder of the archives."""
    scratch = Scratch(pages.sparkSession)
    streams, folder = scratch.path("streams"), folder or scratch.path("archives")
    raw = scratch.save(write_streams(pages, streams, **columns), "raw")
    changes = repeats(raw, scratch, least)
    files = scratch.save(raw.select("file").distinct(), "files")
    normalised(files, streams, f"{folder}/warc", changes).write.parquet(f"{folder}/index")
    scratch.forget(streams)
    return read_index(pages.sparkSession, folder), f"{folder}/warc"


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives."""
    return read_records(*archive(pages, **how))
