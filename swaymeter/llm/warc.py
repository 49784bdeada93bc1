"""WARC archives with a two-level capture index: sorted reversed-host keys in compressed blocks, a sparse directory of the
blocks, binary search in it, then range reads."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swaymeter.llm.common import cut, new_folder, pick, qualified

#: Payloads of at least so many bytes are stored once; later captures of the same payload refer to the first.
REVISIT_BYTES = 0
#: Captures in one compressed block of the index; the directory has one entry a block.
BLOCK = 1000
LEVEL = 3
#: Open archives and decoded index parts that a reading task keeps.
OPEN_FILES, OPEN_SHARDS = 16, 2
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
LEAST_ID = -(1 << 63)


def reversed_host_key(url: Column) -> Column:
    """`https://www.example.org:8080/a?b` as `org,example,www:8080)/a?b`, lower-case host; what has no host stays as it
    is; null is empty."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)((?::[0-9]*)?)(.*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(text, pattern, 1)), r"\.")), ",")
    return F.when(F.regexp_extract(text, pattern, 1) != "", F.concat(host, F.regexp_extract(text, pattern, 2), F.lit(")"), F.regexp_extract(text, pattern, 3))).otherwise(text)


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder given as a URI or as a plain path."""
    return arrow_fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (arrow_fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{url}')}>"


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-coded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, code: str, first: tuple[int, str | None] | None) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page `first` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha1:{code}", "Content-Type: application/http; msgtype=response",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"Content-Length: {len(block)}",
    ]
    if first:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*first)}", f"WARC-Refers-To-Target-URI: {_line(first[1] or '')}", f"X-Refers-To-Page-ID: {first[0]}"]
    pack = zlib.compressobj(LEVEL, wbits=31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class Capture(NamedTuple):
    """What a record says of its page."""

    page_id: int | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None


def parse(member: bytes) -> Capture:
    """Reads one gzip member back. A response's digest is computed from its payload and must equal the one stored."""
    raw = zlib.decompress(member, wbits=31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    code, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != code):
        raise ValueError(f"damaged record of page {head['X-Page-ID']}")
    number = lambda name: int(head[name]) if head.get(name, "").strip() else None
    return Capture(number("X-Page-ID"), size, code, kind, number("X-Refers-To-Page-ID") if kind == "revisit" else None)


class _Write:
    """Writes the rows of a task into one archive and tells where each record lies.

    The file's name is new in every attempt, so a repeated task never touches what another has written; only files named
    by the committed rows count.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(self.folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                places = []
                for page_id, key, url, html, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (html or "").encode()
                    first = None if first_id is None else (first_id, first_url)
                    member = record(page_id, url, payload, digest(payload), first)
                    out = out or system.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(member)
                    places.append((key, LEAST_ID if page_id is None else page_id, name, at, len(member)))
                    at += len(member)
                columns = list(zip(*places, strict=True)) or [()] * 5
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "id", "file", "at", "size"])
        finally:
            if out:
                out.close()


def write_archives(pages: DataFrame, folder: str, min_revisit: int = REVISIT_BYTES) -> DataFrame:
    """Writes one record per row of `pages` (page_id, url, html) and returns (key, id, file, at, size) per record.

    Payloads are the html in UTF-8, null being empty. Of equal payloads of at least `min_revisit` bytes, the rows with
    the smallest page_id are responses and the others revisits of it. Groups with only null ids are all responses. The
    groups of two or more, ids only, are found by a combinable aggregate and stored before pages are joined to them, so
    that Spark can split a payload that a third of all pages share.
    """
    page = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha"))
    big = page.where(F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= min_revisit)
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    groups = big.groupBy("sha").agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    groups = cut(groups.select("sha", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    told = page.join(groups, "sha", "left")
    again = F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(True))
    rows = told.select("page_id", reversed_host_key(F.col("url")).alias("key"), "url", "html", F.when(again, F.col("first_id")).alias("first_id"), F.when(again, F.col("first_url")).alias("first_url"))
    system, path = opened(f"{folder}/archives")
    system.create_dir(path, recursive=True)
    places = rows.mapInArrow(_Write(f"{folder}/archives"), "key string, id long, file string, at long, size long")
    places.write.parquet(f"{folder}/captures")
    return pages.sparkSession.read.schema(places.schema).parquet(f"{folder}/captures")


class _Index:
    """Cuts the sorted captures of a task into compressed blocks of one file, the sparse directory of the blocks at its
    end, and tells the file's first key: (key, id, shard, directory_at, size)."""

    def __init__(self, folder: str, block: int):
        self.folder, self.block = folder, block

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(self.folder)
        name, out, at, directory, rows = f"{uuid.uuid4().hex}.idx", None, 0, [], []

        def flush() -> None:
            nonlocal out, at, rows
            if rows:
                out = out or system.open_output_stream(f"{path}/{name}", compression=None)
                packed = zlib.compress("\n".join(json.dumps(r) for r in rows).encode(), LEVEL)
                out.write(packed)
                directory.append((rows[0][0], rows[0][1], at, len(packed)))
                at, rows = at + len(packed), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                if len(rows) >= self.block:
                    flush()
        flush()
        found = []
        if out:
            packed = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(packed)
            out.close()
            found = [(directory[0][0], directory[0][1], name, at, len(packed))]
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "id", "shard", "at", "size"])


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sorts captures by (key, id) into index files below `folder` and returns one row per file with its first key.

    The range sort deals by key and id together, so a host with a third of all captures is spread like any other.
    """
    system, path = opened(f"{folder}/index")
    system.create_dir(path, recursive=True)
    ordered = captures.select("key", "id", "file", "at", "size").repartitionByRange("key", "id").sortWithinPartitions("key", "id", "file", "at")
    shards = ordered.mapInArrow(_Index(f"{folder}/index", block), "key string, id long, shard string, at long, size long")
    shards.write.parquet(f"{folder}/shards")
    return captures.sparkSession.read.schema(shards.schema).parquet(f"{folder}/shards")


class Index:
    """Finds captures by two binary searches, over the files' first keys and over a file's block directory, and reads
    just the blocks and records asked for. `shards`: sorted (key, id, file, directory_at, size)."""

    def __init__(self, folder: str, shards: list[tuple[bytes, int, str, int, int]]):
        self.system, self.path = opened(folder)
        self.shards, self.firsts = shards, [(s[0], s[1]) for s in shards]
        self.files: OrderedDict[str, object] = OrderedDict()
        self.directories: OrderedDict[int, tuple[list, list]] = OrderedDict()
        self.block: tuple[tuple[int, int] | None, list] = (None, [])

    def read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= OPEN_FILES:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.system.open_input_file(f"{self.path}/{name}")
        self.files.move_to_end(name)
        return self.files[name].read_at(size, at)

    def _directory(self, shard: int) -> tuple[list, list]:
        if shard not in self.directories:
            if len(self.directories) >= OPEN_SHARDS:
                self.directories.popitem(last=False)
            _, _, name, at, size = self.shards[shard]
            rows = json.loads(zlib.decompress(self.read(f"index/{name}", at, size)))
            self.directories[shard] = ([(r[0].encode(), r[1]) for r in rows], rows)
        return self.directories[shard]

    def _block(self, shard: int, k: int) -> list:
        if self.block[0] != (shard, k):
            _, _, at, size = self._directory(shard)[1][k]
            lines = zlib.decompress(self.read(f"index/{self.shards[shard][2]}", at, size)).decode().split("\n")
            self.block = ((shard, k), [json.loads(x) for x in lines])
        return self.block[1]

    def find(self, key: str, page_id: int) -> Iterator[tuple[str, int, int]]:
        """(file, at, size) of all captures under one key and id."""
        wanted = (key.encode(), page_id)
        shard = max(0, bisect_right(self.firsts, wanted) - 1)
        if not self.shards:
            return
        k = max(0, bisect_left(self._directory(shard)[0], wanted) - 1)
        while k < len(self._directory(shard)[1]):
            block = self._block(shard, k)
            for row in block[bisect_left(block, wanted, key=lambda r: (r[0].encode(), r[1])) :]:
                if (row[0].encode(), row[1]) != wanted:
                    return
                yield row[2], row[3], row[4]
            k += 1

    def close(self) -> None:
        for file in self.files.values():
            file.close()


class _Read:
    def __init__(self, folder: str, shards: list[tuple[bytes, int, str, int, int]]):
        self.folder, self.shards = folder, shards

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, before = Index(self.folder, self.shards), None
        try:
            for batch in batches:
                found = []
                for wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if wanted != before:
                        found += (parse(index.read(f"archives/{name}", at, size)) for name, at, size in index.find(*wanted))
                    before = wanted
                columns = list(zip(*found, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(Capture._fields))
        finally:
            index.close()


#: The files of an index are as many as the partitions of its sort; their first keys go to every reading task.
MAX_SHARDS = 1_000_000


def read_captures(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture whose (key, id) is in `wanted`.

    Repeated requests give their captures once. Requests are sorted like the index, so that a task decodes each block
    that it needs once and holds one block at a time. They are dealt to as many tasks as the index has files, or as the
    session deals shuffled rows to, whatever their few bytes: the work is in the records that they ask for.
    """
    rows = spark.read.parquet(f"{folder}/shards").limit(MAX_SHARDS + 1).collect()
    if len(rows) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} index files")
    shards = sorted((r["key"].encode(), r["id"], r["shard"], r["at"], r["size"]) for r in rows)
    tasks = max(1, len(shards), int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = wanted.select("key", "id").repartitionByRange(tasks, "key", "id").sortWithinPartitions("key", "id")
    return asked.mapInArrow(_Read(folder, shards), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = REVISIT_BYTES) -> DataFrame:
    """Writes archives and index of `pages` below `folder` and reads every page back through the index.

    One row per row of `pages`: rows of equal id and url are all found under their one key. Null urls lie under the
    empty key, null ids before all others; an empty table gives an empty result.
    """
    folder = qualified(pages.sparkSession, folder)
    slim = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))
    build_index(write_archives(slim, folder, min_revisit), folder)
    wanted = slim.select(reversed_host_key(F.col("url")).alias("key"), F.coalesce("page_id", F.lit(LEAST_ID)).alias("id"))
    return read_captures(pages.sparkSession, folder, wanted)


def op1_warc(pages: DataFrame) -> DataFrame:
    return archive_and_read(pages, new_folder(pages.sparkSession, "warc"))
