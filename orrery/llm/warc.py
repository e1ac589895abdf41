"""WARC archives and a two-level capture index.

Writing: every task writes gzip members, one for each record, to a file of its
own in the shared folder, under a name no other attempt uses; where its records
lie is a row of a Parquet table, which Spark commits only for the attempt that
won. Of records with equal payloads of ``revisit_from`` bytes or more, those
with the largest id are responses and the others revisits of it.

Index: captures sorted by reversed-host URL key and id are written as compressed
blocks of ``block_lines`` lines. Each index part, a range of keys, has a sparse
directory of its blocks' first keys; the parts' first keys are the top level.
A lookup searches the parts, the part's directory and the block, each by
bisection, and so reads one directory (kept), one block and one record by range.
The driver holds one row for each index part, whose number is set by the rows
a part holds, never the directories.

Lookups of many keys are dealt out by ranges of keys, and the records found are
read in the order in which they lie in the archives. A key with very many
captures is spread over parts, as the id is part of the order.

Defined results: a null payload is empty; a null URL has the key ``-``; rows
without an id are written and found without one, and are responses unless they
revisit; repeated rows are records of their own (all of the largest id are
responses, and all are if none of a payload's rows has an id); an empty table
makes an archive without records; columns other than the three are not carried.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import shared

REVISIT_FROM = 1000
BLOCK_LINES = 1000
PART_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"
#: Bytes of records that one task reads back, and rows that it looks up or reads.
READ_BYTES, READ_ROWS = 64 << 20, 20_000
#: In an index, what stands for no id: it comes before all of 64 bits. In a search, what stands for any.
NO_ID, ANY_ID = -(1 << 63) - 1, None


def _place(page_id: int | None) -> int:
    return NO_ID if page_id is None else page_id


def url_key(url: str | None) -> str:
    """The reversed-host key: ``http://www.example.com/a?b`` is ``com,example,www)/a?b``."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.replace("\t", "%09").replace("\n", "%0A")
    if not host:
        return url.replace("\t", "%09").replace("\n", "%0A")
    tail = "" if port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{port}"
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + (parts.path or "/") + query


def record(
    url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE
) -> bytes:
    """A response record, or a revisit record if ``refers_to`` is given, before compression."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '-').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(fields).encode() + _CRLF * 2 + body + _CRLF * 2


@dataclass(frozen=True)
class Record:
    """A record read back. ``payload`` is None for a revisit."""

    page_id: int | None
    record_type: str
    url: str
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def parsed(data: bytes) -> Record:
    """The record in one gzip member; ValueError if it isn't whole or its payload's digest is wrong."""
    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(body) :] != _CRLF * 2:
        raise ValueError("not a whole WARC record")
    http, _, payload = body.partition(_CRLF * 2)
    size = int(http.decode().rpartition("Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")

    def number(name: str) -> int | None:
        named = fields.get(name, "<urn:page:none>")[len("<urn:page:") : -1]
        return None if named == "none" else int(named)

    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return Record(
        number("WARC-Record-ID"),
        fields["WARC-Type"],
        fields["WARC-Target-URI"],
        payload if fields["WARC-Type"] == "response" else None,
        size,
        digest,
        number("WARC-Refers-To"),
    )


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _read(uri: str, offset: int, length: int) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


class _Writer:
    """A file of this attempt's own, made when the first bytes are written."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.uri = f"{folder}/part-{uuid.uuid4().hex}.{suffix}"
        self.stream, self.at = None, 0

    def write(self, data: bytes) -> tuple[int, int]:
        if self.stream is None:
            fs, path = opened(self.uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.stream = fs.open_output_stream(path, compression=None)
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


def _gzip(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); returns the captures:

    key, page_id, file, offset, length of each.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    t = shared.Tables(pages.sparkSession)
    groups = (
        rows.where(F.octet_length("payload") >= revisit_from)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    # read from a table, both sides of the join are plain exchanges, and a payload that very many share can be split
    known = rows.join(t.write(groups, "groups"), "digest", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, "warc.gz")
        for batch in batches:
            rows = []
            payloads = batch.column("payload")
            for i, (page, url, digest, first) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first")), strict=True)
            ):
                refers = first if first is not None and first != page else None
                data = record(url, page, payloads[i].as_buffer().to_pybytes(), digest, refers)
                rows.append((url_key(url), page, out.uri, *out.write(_gzip(data))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, _CAPTURE, strict=True)],
                schema=_CAPTURE,
            )
        out.close()

    made = known.select("page_id", "url", "payload", "digest", "first").mapInArrow(
        write, "key string, page_id long, file string, offset long, length long"
    )
    captures = t.write(made, "captures")
    t.keep_only(captures)
    return captures


@dataclass(frozen=True)
class Index:
    """The top level: first (key, page_id) of each part in order, and where its directory is."""

    firsts: list[tuple[str, int]]
    directories: list[tuple[str, int, int]]

    def save(self, uri: str) -> None:
        fs, path = opened(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path, compression=None) as f:
            f.write(json.dumps({"firsts": self.firsts, "directories": self.directories}).encode())

    @classmethod
    def load(cls, uri: str) -> Index:
        fs, path = opened(uri)
        with fs.open_input_file(path) as f:
            found = json.loads(f.read())
        return cls([tuple(x) for x in found["firsts"]], [tuple(x) for x in found["directories"]])

    def search(self, key: str, place: int | None = ANY_ID) -> Iterator[tuple[str, int | None, str, int, int]]:
        """(key, page_id, file, offset, length) of the captures of a key, or of one id of it, or of none (``NO_ID``)."""
        low = (key, NO_ID if place is ANY_ID else place)
        matches = lambda line: line[0] == key and place in (ANY_ID, line[1])
        part = max(0, bisect_left(self.firsts, low) - 1)
        for where in self.directories[part:]:
            firsts, blocks = _directory(*where)
            block = max(0, bisect_left(firsts, low) - 1)
            for at in blocks[block:]:
                lines = _block(*at)
                i = bisect_left(lines, low, key=lambda x: x[:2])
                if i == len(lines):
                    continue  # equal lines may begin the next block
                while i < len(lines) and matches(lines[i]):
                    yield lines[i][0], None if lines[i][1] == NO_ID else lines[i][1], *lines[i][2:]
                    i += 1
                if i < len(lines):
                    return


@lru_cache(maxsize=16)
def _directory(uri: str, offset: int, length: int) -> tuple[list, list]:
    rows = json.loads(zlib.decompress(_read(uri, offset, length), wbits=31))
    return [(k, p) for k, p, *_ in rows], [(uri, o, n) for _, _, o, n in rows]


@lru_cache(maxsize=16)
def _block(uri: str, offset: int, length: int) -> list[tuple[str, int, str, int, int]]:
    lines = zlib.decompress(_read(uri, offset, length), wbits=31).decode().split("\n")
    split = (x.split("\t") for x in lines)
    return [(k, int(p), f, int(o), int(n)) for k, p, f, o, n in split]


def _parts(df: DataFrame, n_rows: int, part_rows: int) -> int:
    return max(1, -(-n_rows // part_rows), min(n_rows // READ_ROWS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def write_index(
    captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, part_rows: int = PART_ROWS
) -> Index:
    """Writes the blocks and directories of the captures, and returns the top level, which is saved too."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, "cdx.gz")
        directory: list[tuple[str, int, int, int]] = []
        held: list[tuple] = []

        def flush() -> None:
            data = "\n".join("\t".join(map(str, x)) for x in held)
            directory.append((*held[0][:2], *out.write(_gzip(data.encode()))))
            held.clear()

        for batch in batches:
            for key, page_id, *where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((key, _place(page_id), *where))
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if directory:
            at, n = out.write(_gzip(json.dumps(directory).encode()))
            key, place = directory[0][:2]
            columns = [[key], [None if place == NO_ID else place], [out.uri], [at], [n]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, _CAPTURE.types, strict=True)], schema=_CAPTURE
            )
        out.close()

    n = captures.count()
    order = ["key", "page_id", "file", "offset"]
    parts = (
        captures.select("key", "page_id", "file", "offset", "length")
        .repartitionByRange(_parts(captures, n, part_rows), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(write, "key string, page_id long, file string, offset long, length long")
    )
    t = shared.Tables(captures.sparkSession)
    rows = sorted((r["key"], _place(r["page_id"]), *r[2:]) for r in t.write(parts, "parts").collect())  # one for each part
    t.keep_only()
    index = Index([r[:2] for r in rows], [r[2:] for r in rows])
    index.save(f"{folder}/top.json")
    return index


def lookup(index: Index, keys: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The captures (key, page_id, file, offset, length) of distinct ``keys``: key, page_id."""
    shared_index = keys.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found = []
            for asked in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                if asked != last:
                    found += shared_index.value.search(asked[0], _place(asked[1]))
                last = asked
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, _CAPTURE, strict=True)], schema=_CAPTURE
            )

    dealt = keys.repartitionByRange(_parts(keys, keys.count(), part_rows), "key", "page_id")
    found = dealt.sortWithinPartitions("key", "page_id").mapInArrow(
        search, "key string, page_id long, file string, offset long, length long"
    )
    return shared.written(found, "found")  # once: what orders the records by place looks at them twice


def read_records(captures: DataFrame) -> DataFrame:
    """The records at these places: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        schema = pa.schema(
            [
                ("page_id", pa.int64()),
                ("url", pa.string()),
                ("record_type", pa.string()),
                ("payload", pa.binary()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("refers_to", pa.int64()),
            ]
        )
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for file, offset, length in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if file != name:
                        fs, path = opened(file)
                        name, f = file, fs.open_input_file(path)
                    rows.append(parsed(f.read_at(length, offset)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([getattr(r, c.name) for r in rows], type=c.type) for c in schema], schema=schema
                )

    size, rows = captures.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(1, -(-size // READ_BYTES), -(-rows // READ_ROWS))
    return (
        captures.select("file", "offset", "length")
        .repartitionByRange(tasks, "file", "offset")
        .sortWithinPartitions("file", "offset")
        .mapInArrow(
            read,
            "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string,"
            " refers_to long",
        )
    )


def keys_of(pages: DataFrame) -> DataFrame:
    """The key and id of each page, as they are in the index."""

    @F.arrow_udf("string")
    def key(urls: pa.Array) -> pa.Array:
        return pa.array([url_key(u.as_py()) for u in urls], type=pa.string())

    return pages.select(key("url").alias("key"), F.col("page_id").cast("long").alias("page_id"))


def archive(spark: SparkSession, pages: DataFrame, revisit_from: int = REVISIT_FROM) -> tuple[Index, DataFrame]:
    """Archives ``pages`` in the shared folder: the index, and the captures it was made of."""
    captures = write_archives(pages, shared.folder(spark, "warc"), revisit_from)
    return write_index(captures, shared.folder(spark, "cdx")), captures
