"""WARC archives of pages and a two-level capture index.

`write_archives` writes one gzip member per record.  Of equal payloads the page with the smallest id gets a response
record, the others revisit records that refer to it.  Only payload digests that occur more than once are joined to the
pages, so pages are shuffled at most by that join, where a skewed digest can be split.

`write_index` sorts the captures by reversed-host URL key (and page), writes them as compressed blocks of lines, and
keeps a sparse directory of each index file: the first key of every block and its place.  `lookup` finds the index
file among the files' first keys (at most MAX_FILES of them), the block in the file's directory and the line in the
block, each by binary search, and reads one block.  `read_records` orders the places found by archive and offset and
reads and parses exactly those ranges.

Archives and index lie in the shared folder; every attempt of a task writes files of its own, and only files named by
the committed captures and directory count, so a lost executor leaves no wrong record.

Defined cases: a null html is an empty payload; a null url has the empty key; repeated rows get a record each, those
with the smallest id of equal payloads are all responses; a null page_id counts as larger than any other and refers to
the smallest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import fresh_path, written

ROLL_BYTES = 64 << 20
BLOCK_LINES = 2048
LINES_PER_FILE = 250_000
MAX_FILES = 4096
# Keys that a lookup task bisects, and bytes of archives that a task reads back.
KEYS_PER_TASK = 4096
READ_BYTES = 4 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Reversed-host key: `com,example,www)/path?query`; A-Z of the host in lower case."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tail = F.regexp_extract(rest, "(?s)^[^/?#]*(.*)$", 1)
    return F.when(F.instr(F.coalesce(url, F.lit("")), "://") > 0, F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), tail)).otherwise(F.coalesce(url, F.lit("")))


def captured(pages: DataFrame) -> DataFrame:
    """(page_id, url, surt, payload, sha1, first): first is the page that carries the payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", url_key(F.col("url")).alias("surt"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    repeated = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    return rows.join(repeated, "sha1", "left").select("page_id", "url", "surt", "payload", "sha1", F.coalesce("first", "page_id").alias("first"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, first: int | None) -> bytes:
    """One record, compressed."""
    revisit = page_id != first
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page: {first}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a compressed record; a payload is checked against its digest."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Page-Id"), size, digest, fields["WARC-Type"], number("X-Refers-To-Page")


def opened(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the records; (surt, page_id, file, offset, length) of each."""
    store, root = opened(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        out, name, offset = None, "", 0
        for batch in batches:
            files, offsets, lengths = [], [], []
            for page_id, url, payload, sha1, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "sha1", "first"))):
                if out is None or offset >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packed = record(page_id, url, payload, sha1, first)
                out.write(packed)
                files.append(name)
                offsets.append(offset)
                lengths.append(len(packed))
                offset += len(packed)
            yield pa.RecordBatch.from_arrays([batch["surt"], batch["page_id"], pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                                             ["surt", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return written(rows.mapInArrow(run, "surt string, page_id bigint, file string, offset bigint, length bigint"), "warc-captures")


def key_of(surt: str, page_id: int | None) -> tuple:
    """Sort key of a capture: bytes of the URL key, then the page, null first."""
    return surt.encode(), page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write compressed blocks of sorted captures and each file's sparse directory; (file, surt, page_id): first keys of the files."""
    store, root = opened(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        name, out, directory, lines, offset = uuid.uuid4().hex, None, [], [], 0

        def flush() -> None:
            nonlocal out, offset
            out = out or store.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            packed = packer.compress("\n".join(json.dumps(x) for x in lines).encode()) + packer.flush()
            out.write(packed)
            directory.append([*lines[0][:2], offset, len(packed)])
            offset += len(packed)
            lines.clear()

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("surt", "page_id", "file", "offset", "length"))):
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if directory:
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx", compression=None) as idx:
                idx.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]], pa.string()), pa.array([directory[0][1]], pa.int64())], ["file", "surt", "page_id"])

    files = max(1, min(MAX_FILES, -(-captures.count() // LINES_PER_FILE)))
    ordered = captures.repartitionByRange(files, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return written(ordered.mapInArrow(run, "file string, surt string, page_id bigint"), "warc-directory")


class Index:
    """Binary search from the files' first keys to a line; keeps the last directory and block it read."""

    def __init__(self, folder: str, firsts: list[tuple[tuple, str]]):
        self.store, self.root = opened(folder)
        self.keys, self.files = [k for k, _ in firsts], [f for _, f in firsts]
        self.file, self.place, self.stream = "", None, None

    def find(self, key: tuple) -> Iterator[list]:
        """All lines with the key; equal keys may run over the ends of blocks and files."""
        at = max(0, bisect_left(self.keys, key) - 1)
        while at < len(self.files) and self.keys[at] <= key:
            self._open(self.files[at])
            block = max(0, bisect_left(self.blocks, key) - 1)
            while block < len(self.blocks) and self.blocks[block] <= key:
                self._load(block)
                for line in self.lines[bisect_left(self.line_keys, key):bisect_right(self.line_keys, key)]:
                    yield line
                block += 1
            at += 1

    def _open(self, file: str) -> None:
        if file != self.file:
            with self.store.open_input_stream(f"{self.root}/{file}.idx", compression=None) as idx:
                self.directory = json.loads(zlib.decompress(idx.read()))
            self.blocks = [key_of(*x[:2]) for x in self.directory]
            self.stream = self.store.open_input_file(f"{self.root}/{file}.cdx.gz")
            self.file, self.place = file, None

    def _load(self, block: int) -> None:
        if self.place != block:
            _, _, offset, length = self.directory[block]
            self.stream.seek(offset)
            self.lines = [json.loads(x) for x in zlib.decompress(self.stream.read(length), 31).split(b"\n")]
            self.line_keys = [key_of(*x[:2]) for x in self.lines]
            self.place = block


def lookup(keys: DataFrame, folder: str, files: DataFrame) -> DataFrame:
    """(file, offset, length) of all captures of the keys (surt, page_id), one row per capture."""
    firsts = sorted((key_of(r.surt, r.page_id), r.file) for r in files.collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, firsts)
        for batch in batches:
            found = [line[2:] for surt, page_id in zip(batch["surt"].to_pylist(), batch["page_id"].to_pylist()) for line in index.find(key_of(surt, page_id))]
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])

    # The keys are small, the lookups behind them are not: without a number Spark would put them into few tasks by their size.
    keys = written(keys.distinct(), "warc-keys")
    ordered = keys.repartitionByRange(max(1, -(-keys.count() // KEYS_PER_TASK)), "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return ordered.mapInArrow(run, "file string, offset bigint, length bigint")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Read the ranges in archive order: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        name, stream = "", None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    name, stream = file, store.open_input_file(f"{root}/{file}")
                stream.seek(offset)
                rows.append(parse(stream.read(length)))
            columns = zip(*rows) if rows else ([], [], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # A place is a few bytes and stands for a whole record, so the tasks are cut by the bytes to read.
    places = written(places, "warc-places")
    size = places.agg(F.sum("length")).first()[0] or 0
    ordered = places.repartitionByRange(max(1, -(-size // READ_BYTES)), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look every page up and read its record back."""
    archives, index = fresh_path(spark, "warc"), fresh_path(spark, "cdx")
    captures = write_archives(captured(pages), archives)
    files = write_index(captures, index)
    keys = pages.select(url_key(F.col("url")).alias("surt"), "page_id")
    return read_records(lookup(keys, index, files), archives)
