"""WARC files: a writer and a salvage reader.

The reader takes a file as a chain of records: gzip members (.gz) or plain
records. Where a record fails its checks (version line, headers, length, gzip
CRC, block digest), it searches on for the next member magic or version line
that begins a record which passes all of them, and logs the bytes between as a
gap. Files are read through a window, never whole; a record is held whole, with
headers of any length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.shared import new_path, written

FILE_BYTES = 16 << 20
CHUNK = 1 << 18
#: Tasks at most for each shuffle partition of the session.
TASKS = 4
HEAD = 1 << 16
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")


class Bad(Exception):
    """What is wrong with the bytes at a place."""


def block_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def differs(said: str, block: bytes) -> bool:
    """Whether a digest, in base 32 or 16, is not that of block; those of other kinds than DIGESTS are not checked."""
    kind, _, value = said.partition(":")
    if (kind := kind.strip().lower().replace("-", "")) not in DIGESTS:
        return False
    own = hashlib.new(kind, block).digest()
    return value.strip().upper().rstrip("=") not in (base64.b32encode(own).decode().rstrip("="), own.hex().upper())


def record_bytes(record_id: str, url: str | None, block: bytes) -> bytes:
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: {block_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, whole: bool, begin: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and size of the record that begins at a place of data; with whole, data must hold nothing after it."""
    if not VERSION.match(data, begin):
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", begin)
    if end < 0:
        raise Bad("no end of headers")
    headers = {}
    for line in data[begin:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("malformed header")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise Bad("no content length")
    size = int(headers["content-length"])
    block = data[end + 4 : end + 4 + size]
    after = end + 8 + size
    if data[end + 4 + size : after] != b"\r\n\r\n":
        raise Bad("truncated or wrong length")
    if whole and len(data) != after:
        raise Bad("bytes after the record")
    if differs(headers.get("warc-block-digest", ""), block):
        raise Bad("block digest differs")
    return headers, block, after - begin


class Salvage:
    """Records and gaps of one file, by random access through read_at(offset, size)."""

    def __init__(self, read_at, size: int, zipped: bool):
        self.read_at, self.size, self.zipped = read_at, size, zipped
        self.window, self.window_at = b"", 0
        self.no_end_from = size  # no headers end at this place or later

    def bytes_at(self, at: int, size: int) -> bytes:
        if not (self.window_at <= at and at + size <= self.window_at + len(self.window)):
            self.window, self.window_at = self.read_at(at, max(size, 4 * CHUNK)), at
        return self.window[at - self.window_at : at - self.window_at + size]

    def records(self, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
        """Headers and blocks of what begins at a place, a member or a record, and its size."""
        return self.member(at) if self.zipped else self.plain(at)

    def plain(self, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
        if at >= self.no_end_from:
            raise Bad("no end of headers")
        size, end = HEAD, -1
        while end < 0:
            head = self.bytes_at(at, min(size, self.size - at))
            if not VERSION.match(head):
                raise Bad("no version line")
            end = head.find(b"\r\n\r\n")
            if end < 0 and size >= self.size - at:
                self.no_end_from = at
                raise Bad("no end of headers")
            size *= 4
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*(?:\r\n|\Z)", head[:end])
        if not length:
            raise Bad("no content length")
        total = end + 8 + int(length[1])
        if at + total > self.size:
            raise Bad("truncated or wrong length")
        headers, block, _ = parse_record(self.bytes_at(at, total), True)
        return [(headers, block)], total

    def member(self, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
        if self.bytes_at(at, min(3, self.size - at)) != MAGIC:
            raise Bad("no member magic")
        inflate, parts, pos, step = zlib.decompressobj(31), [], at, 1 << 13
        try:
            while not inflate.eof:
                chunk = self.bytes_at(pos, min(step, self.size - pos))
                step = min(CHUNK, 2 * step)
                if not chunk:
                    raise Bad("truncated member")
                parts.append(inflate.decompress(chunk))
                if pos == at and not b"WARC/".startswith(parts[0][:5]):
                    raise Bad("no version line")
                pos += len(chunk)
        except zlib.error as e:
            raise Bad("damaged member") from e
        data, found, begin = b"".join(parts), [], 0
        while begin < len(data) or not found:
            headers, block, total = parse_record(data, False, begin)
            found.append((headers, block))
            begin += total
        return found, pos - len(inflate.unused_data) - at

    def candidates(self, at: int):
        """Places >= at where a record may begin, in order."""
        overlap = 16
        while at < self.size:
            data = self.bytes_at(at, min(CHUNK + overlap, self.size - at))
            ends = at + len(data) >= self.size
            if self.zipped:
                found, i = [], data.find(MAGIC)
                while i >= 0:
                    found.append(i)
                    i = data.find(MAGIC, i + 1)
            else:
                found = [m.start() for m in VERSION.finditer(data)]
            limit = len(data) if ends else CHUNK
            yield from (at + i for i in found if i < limit)
            at += limit

    def run(self):
        """("record", start, length, headers, block) and ("gap", start, length, reason), in the order of the file."""
        at = 0
        while at < self.size:
            try:
                found, total = self.records(at)
            except Bad as bad:
                reason, start = str(bad), at
                at, found = self.size, None
                for place in self.candidates(start + 1):
                    try:
                        found, total = self.records(place)
                    except Bad:
                        continue
                    at = place
                    break
                yield "gap", start, at - start, reason
                if found is None:
                    return
            for headers, block in found:
                yield "record", at, total, headers, block
            at += total


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


FIELDS = "file string, kind string, start long, length long, reason string, record_id string, url string, block binary"


def salvaged(paths: DataFrame) -> DataFrame:
    """(file, kind, start, length, reason, record_id, url, block) from (path): a row for each record and each gap.

    Records have a null reason; gaps have null record_id, url and block. An
    empty file has neither; a file of damage alone is one gap. Records of one
    gzip member have its start and length; a member is taken whole or not at
    all. Headers may have any length. Block digests of the kinds DIGESTS, in
    base 32 or 16, are checked, others are not. Null paths are passed over; a
    path that is listed twice is read twice. A missing file is an error. A file
    is read by one task, which may read several; other columns are not read.
    """

    def run(batches):
        names = [f.split()[0] for f in FIELDS.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = opened(path)
                file, rows, held = path.rsplit("/", 1)[-1], [], 0
                with fs.open_input_file(inner) as f:
                    for kind, start, length, *rest in Salvage(lambda at, n: f.read_at(n, at), f.size(), path.endswith(".gz")).run():
                        if kind == "gap":
                            rows.append((file, kind, start, length, rest[0], None, None, None))
                        else:
                            rows.append((file, kind, start, length, None, rest[0].get("warc-record-id", "").strip("<>") or None, rest[0].get("warc-target-uri"), rest[1]))
                            held += len(rest[1])
                        if held > 4 << 20 or len(rows) >= 10_000:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    listed = paths.select("path").where("path is not null")
    tasks = min(listed.count(), TASKS * int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(max(1, tasks)).mapInArrow(run, FIELDS)


def damaged(data: bytes, key: str) -> bytes:
    """data with its middle overwritten, or without its last third, for one key in 32 each; else as it is."""
    kind = hashlib.md5(key.encode("utf-8")).digest()[0] >> 3
    if kind == 0:
        third = len(data) // 3
        return data[:third] + bytes(x ^ 0x5A for x in data[third : 2 * third]) + data[2 * third :]
    return data[: len(data) * 2 // 3] if kind == 1 else data


def archived(pages: DataFrame, harm: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to WARC files of about file_bytes of text in the shared folder; gives their (path).

    Half of the files have a gzip member a record, half are plain. A null html
    is written as an empty block, a null url without a target URI. With harm,
    damaged() is applied to each record. Files are written under another name
    and moved, so that a task that runs twice leaves one whole file.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = pages.select("page_id", "url", "html")
    total = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n = 2 * max(1, math.ceil(total / file_bytes / 2))

    def write(batches):
        done, current, out, fs, tmp, inner = [], None, None, None, "", ""

        def close():
            if out is not None:
                out.close()
                fs.move(tmp, inner)

        for batch in batches:
            for number, page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if number != current:
                    close()
                    current = number
                    path = f"{folder}/{number:06d}.warc" + (".gz" if number % 2 else "")
                    done.append(path)
                    fs, inner = opened(path)
                    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    tmp = f"{inner}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp)
                data = record_bytes(f"urn:page:{'' if page_id is None else page_id}", url, (html or "").encode("utf-8"))
                if current % 2:
                    data = gzip.compress(data, compresslevel=1, mtime=0)
                out.write(damaged(data, f"{page_id} {url}") if harm else data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    file = F.pmod(F.xxhash64("page_id", "url"), F.lit(n)).cast("int").alias("file")
    placed = rows.select(file, "page_id", "url", "html").repartition(n, "file").sortWithinPartitions("file", "page_id", "url", "html")
    return written(placed.mapInArrow(write, "path string"), "warc-list")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC files of which some are damaged, and what salvaged() reads of them."""
    files = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), harm=True)
    found = salvaged(files)
    page = F.expr("try_cast(substring(record_id, length('urn:page:') + 1) as bigint)").alias("page_id")
    return found.select("file", "kind", "start", "length", "reason", page, "url", F.decode("block", "UTF-8").alias("html"))


QUERIES = {"op5_warc": op5_warc}
SQL: dict[str, str] = {}
