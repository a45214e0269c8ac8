"""Web archives, and a two-level capture index to read single records back.

Tasks write WARC files, one gzip member for each record. The index sorts captures by their reversed-host
URL into compressed blocks of lines; beside each index file lies a sparse directory with the first key of
every block. A lookup searches the first keys of the files, then the directory, then the block, each by
bisection, and reads the record's byte range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.frames import keyed
from weftline.session import cut_lineage, measured_side, scratch_path

ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 3000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7F]")
_CAPTURE = "part long, row long, page_id long, key string, file string, offset long, length long"

_INDEX = "file string, first_key string, first_part long, first_row long, lines long"
_FOUND = "part long, row long, file string, offset long, length long"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder in shared storage and the path within it."""
    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Host labels in reverse order, lower-cased, then path and query; empty without a URL."""
    if not url:
        return ""
    safe = _UNSAFE.sub(lambda m: quote(m[0]), url)
    try:
        parts = urlsplit(safe)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return safe
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit keeps the response's HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_UNSAFE.sub(lambda m: quote(m[0]), url or '')}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {name.lower(): value for name, _, value in pairs}, rest


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload or None) of one record.

    A response whose payload doesn't fit its length or digest is an error.
    """
    head, rest = _headers(data)
    http, payload = _headers(rest[: int(head["content-length"])])
    kind, size = head["warc-type"], int(http["content-length"])
    name = head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        return _page(head["warc-record-id"]), size, name, kind, _page(head["warc-refers-to"]), None
    if len(payload) != size or sha1_base32(payload) != name:
        raise ValueError(f"damaged record {head['warc-record-id']}")
    return _page(head["warc-record-id"]), size, name, kind, None, payload


class _Member:
    """A file of gzip or zlib members in the shared folder, under a name no other attempt uses."""

    def __init__(self, folder: str, ending: str):
        system, path = place(folder)
        system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.{ending}"
        self.stream = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        at, self.size = self.size, self.size + len(data)
        return at, len(data)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _named(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(part, row, page_id, url, payload): pages under the two numbers that tell their rows apart."""
    rows, (part, row) = keyed(pages)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return rows.select(
        F.col(part).alias("part"), F.col(row).alias("row"), F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"), payload.alias("payload"),
    )


def _revisits(named: DataFrame, least_bytes: int) -> DataFrame:
    """(part, row, refers_to) of rows whose payload another row has under a smaller page id.

    Payloads are hashed once; digests, not pages, are counted and joined.
    """
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "part", "row")
    hashed = named.where(F.length("payload") >= least_bytes).select(F.sha1("payload").alias("sha1"), rank.alias("rank"))
    small = cut_lineage(hashed)
    first = cut_lineage(small.groupBy("sha1").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1"))
    met = small.join(first, "sha1").where("rank.part <> first.part OR rank.row <> first.row")
    return met.select("rank.part", "rank.row", F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit"))


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record for each row of ``pages`` and gives the captures
    (part, row, page_id, key, file, offset, length).

    Only files of finished tasks are named in the captures. Of equal payloads of at least
    ``least_bytes``, the smallest page id (null last, then the first row) is the response. Null pages are
    empty payloads.
    """
    named = _named(pages, page_id, url, html)
    # Few revisits are broadcast by their measured bytes; with many, pages and revisits meet by row.
    marked = named.join(measured_side(_revisits(named, least_bytes)), ["part", "row"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if archive is None or archive.size > archive_bytes:
                    if archive is not None:
                        archive.stream.close()
                    archive = _Member(folder, "warc.gz")
                made = record(r["page_id"], r["url"], r["payload"], r["refers_to"], bool(r["revisit"]))
                out.append((r["part"], r["row"], r["page_id"], url_key(r["url"]), archive.name, *archive.add(_gzip(made))))
            yield _batch(out, _CAPTURE)
        if archive is not None:
            archive.stream.close()

    return cut_lineage(marked.mapInArrow(run, _CAPTURE))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    fields = [part.split(" ") for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [n for n, _ in fields]
    )


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes sorted index files with their directories and gives (file, first_key, first_part, first_row, lines) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, directory, lines, total, first = None, [], [], 0, None

        def flush() -> None:
            packed = zlib.compress("".join(f"{k} {p} {r} {rest}\n" for k, p, r, rest in lines).encode())
            directory.append((*lines[0][:3], *index.add(packed)))
            lines.clear()

        for batch in batches:
            for c in batch.to_pylist():
                if index is None:
                    index, first = _Member(folder, "cdx"), (c["key"], c["part"], c["row"])
                lines.append((c["key"], c["part"], c["row"], json.dumps({n: c[n] for n in ("file", "offset", "length")})))
                total += 1
                if len(lines) == block_lines:
                    flush()
        if index is not None:
            if lines:
                flush()
            index.stream.close()
            system, path = place(folder)
            with system.open_output_stream(f"{path}/{index.name}.dir", compression=None) as out:
                out.write(json.dumps(directory).encode())
            yield _batch([(index.name, *first, total)], _INDEX)

    ordered = captures.repartitionByRange("key", "part", "row").sortWithinPartitions("key", "part", "row")
    return cut_lineage(ordered.mapInArrow(run, _INDEX))


class _Shard:
    """One index file: its directory in memory, one block at a time."""

    def __init__(self, folder: str, name: str):
        system, path = place(folder)
        with system.open_input_file(f"{path}/{name}.dir") as held:
            self.directory = [tuple(x) for x in json.loads(held.read())]
        self.firsts = [x[:3] for x in self.directory]
        self.file = system.open_input_file(f"{path}/{name}")
        self.at, self.keys, self.lines = -1, [], []

    def find(self, wanted: tuple[str, int, int]) -> dict | None:
        at = bisect.bisect_right(self.firsts, wanted) - 1
        if at < 0:
            return None
        if at != self.at:
            offset, length = self.directory[at][3:]
            text = zlib.decompress(self.file.read_at(length, offset)).decode()
            self.lines = [line.split(" ", 3) for line in text.split("\n")[:-1]]
            self.keys = [(k, int(p), int(r)) for k, p, r, _ in self.lines]
            self.at = at
        found = bisect.bisect_left(self.keys, wanted)
        hit = found < len(self.keys) and self.keys[found] == wanted
        return json.loads(self.lines[found][3]) if hit else None


def lookup(wanted: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """(part, row, file, offset, length) of wanted captures (key, part, row); those not in the index are left out.

    Gathered at the driver: the first key of each index file, of which there are as many as partitions.
    """
    top = sorted((r["first_key"], r["first_part"], r["first_row"], r["file"]) for r in index.collect())
    firsts, names = [t[:3] for t in top], [t[3] for t in top]

    @F.pandas_udf("int")
    def shard(keys: pd.Series, parts: pd.Series, rows: pd.Series) -> pd.Series:
        found = [bisect.bisect_right(firsts, wanted) - 1 for wanted in zip(keys, parts, rows, strict=True)]
        return pd.Series(found, dtype="int32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["shard"] != at:
                    at, held = r["shard"], _Shard(folder, names[r["shard"]])
                if (hit := held.find((r["key"], r["part"], r["row"]))) is not None:
                    out.append((r["part"], r["row"], hit["file"], hit["offset"], hit["length"]))
            yield _batch(out, _FOUND)

    placed = wanted.select("key", "part", "row", shard("key", "part", "row").alias("shard")).where("shard >= 0")
    dealt = placed.repartition(_tasks(wanted), "shard").sortWithinPartitions("shard", "key", "part", "row")
    return dealt.mapInArrow(run, _FOUND)


def _tasks(df: DataFrame) -> int:
    """The session's shuffle partitions, named, since few bytes here stand for long reads elsewhere."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_records(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records at captures (file, offset, length), with their payloads if asked for.

    A file's ranges are read by one task, in order.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = place(folder)
        name, held = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    name, held = r["file"], system.open_input_file(f"{path}/{r['file']}")
                found = parsed(zlib.decompress(held.read_at(r["length"], r["offset"]), 31))
                out.append(found if payloads else found[:5])
            yield _batch(out, schema)

    dealt = captures.select("file", "offset", "length").repartition(_tasks(captures), "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Writes archives and index of ``pages`` (page_id, url, html) and reads every record back through the index.

    One row for each row of ``pages``, repeated rows too (all but the first revisit it). Null URLs have an
    empty key, null pages an empty payload, null ids stay null. An empty table gives no row; other columns are ignored.
    """
    folder = folder or scratch_path(pages.sparkSession, "archive")
    captures = write_archives(pages, folder, least_bytes=least_bytes)
    index = write_index(captures, folder)
    return read_records(lookup(captures.select("key", "part", "row"), index, folder), folder, payloads)
