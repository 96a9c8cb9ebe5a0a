"""Web archives in ZIP packages: written by Spark tasks, read back by byte ranges.

A package is a ZIP file with one stored member ``archive/data.warc.gz`` of
records compressed one by one, and a stored index ``indexes/index.cdxj`` with
the place of each record. Reading never extracts a member:

1. the end of a package gives its central directory, by the ZIP64 records
   where numbers need them, and the directory gives the members' places;
2. indexes are read in splits of ``INDEX_BYTES``, each by its own task;
3. records are read in blocks of ``BLOCK_BYTES``, neighbours by one request.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the
largest id (then the largest url, then the later row) holds the payload; the others
are revisits that name it.

Scale: payloads are written once beside their digests, so that row numbers are
fixed, and reach their package by a join on the digest. Digests of at least a
thousandth of the rows are broadcast, a thousand at most, and their rows are not
brought together. Tasks close a package at ``PACKAGE_BYTES``, and memory holds
the index lines of one package. A manifest names the packages of finished
tasks; what a lost task left behind is not in it. Packages lie in any file system Arrow
can open, such as the shared folder of the cluster.

Defined results: a null html is an empty payload, a null id is left out of the
record and smaller than any other, a null url has no target. Repeated rows are records of their own.
No rows give no packages. A member that is compressed, an unknown directory or
a payload that does not match its digest raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribemill.llm.common import file_partitions, join_counted
from scribemill.session import stage

MIN_REVISIT = 1000
PACKAGE_BYTES = 64 << 20
INDEX_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Pages carry no time of capture.
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the WARC and ZIP formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END_64, LOCATOR_64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
LARGEST_COMMENT = 65_535
NO_16, NO_32 = 0xFFFF, 0xFFFFFFFF
RECORDS = (
    "path string, offset long, record_id string, record_type string, page_id string, url string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


# Writing


def record_urn(number: int) -> str:
    return f"<{uuid.UUID(int=number).urn}>"


def warc_record(number: int, page_id: str | None, url: str | None, size: int, digest: bytes, payload: bytes | None, refers_to: int | None) -> bytes:
    """One compressed record: a response with its payload, or a revisit of another record."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_urn(number)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_urn(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def index_key(url: str | None) -> str:
    """The url with its host in reverse order, under which an index is sorted."""
    parts = urlsplit(quote(url or "", safe="!#$%&'()*+,/:;=?@~-._"))
    host = ",".join(reversed(parts.netloc.lower().split(":")[0].split(".")))
    return f"{host}){parts.path}" + (f"?{parts.query}" if parts.query else "")


class PackageWriter:
    """Streams records into one package; only its index lines stay in memory."""

    def __init__(self, out):
        self.package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        self.member = self.package.open(ARCHIVE, "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, record: bytes, url: str | None, digest: bytes) -> None:
        place = {"url": url, "digest": "sha1:" + base64.b32encode(digest).decode(), "offset": self.size, "length": len(record), "filename": ARCHIVE.split("/")[1]}
        self.lines.append(f"{index_key(url)} {DATE.translate(str.maketrans('', '', '-:TZ'))} {json.dumps(place)}\n")
        self.member.write(record)
        self.size += len(record)

    def close(self) -> int:
        self.member.close()
        with self.package.open(INDEX, "w", force_zip64=True) as member:
            for line in sorted(self.lines):
                member.write(line.encode())
        self.package.close()
        return len(self.lines)


def write_packages(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write one record per page under ``folder`` and return the manifest: path and records of each package."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).cast("string").alias("page_id"), F.col(id_column).alias("rank"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    numbered = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long"), "number": F.monotonically_increasing_id()})
    numbered = stage(numbered, "payloads")
    groups = numbered.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("rank", "url", "number")).alias("first"))
    groups = stage(groups.where("n > 1").select("digest", "n", F.col("first.number").alias("holder")), "groups")
    joined = join_counted(numbered, groups, "digest", "n", "number")
    refers_to = F.when(F.col("holder") != F.col("number"), F.col("holder"))
    # A revisit travels without its payload.
    records = joined.select("number", "page_id", "url", "bytes", "digest", F.when(refers_to.isNull(), F.col("payload")).alias("payload"), refers_to.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        out = writer = name = None

        def finished() -> pa.RecordBatch:
            n = writer.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "records"])

        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                number, page_id, target, size, digest, body, holder = (c[i].as_py() for c in columns)
                if writer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{root}/{name}")
                    writer = PackageWriter(out)
                sha1 = bytes.fromhex(digest)
                writer.add(warc_record(number, page_id, target, size, sha1, body, holder), target, sha1)
                if writer.size >= package_bytes:
                    yield finished()
                    writer = None
        if writer is not None:
            yield finished()

    return stage(records.mapInArrow(write, "path string, records long"), "manifest")


# Reading


class _Range:
    """Byte ranges of one file."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = store.open_input_file(name)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


def directory_place(read: Callable[[int, int], bytes], size: int) -> tuple[int, int, int]:
    """Start and length of the central directory, and how far the package is shifted by bytes before it."""
    length = min(size, 22 + LARGEST_COMMENT)
    tail = read(size - length, length)
    at = tail.rfind(END)
    # The mark may also stand in the comment that ends the file.
    while at >= 0 and (at + 22 > length or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != length):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    entries, span, start = struct.unpack_from("<HII", tail, at + 10)
    end = size - length + at
    locator = read(end - 20, 20) if end >= 20 else b""
    if not locator.startswith(LOCATOR_64):
        if entries == NO_16 or NO_32 in (span, start):
            raise ValueError("a ZIP64 directory without its locator")
    else:
        # Some writers add the 64-bit record without need; the directory ends before it either way.
        stated = struct.unpack_from("<Q", locator, 8)[0]
        # Bytes before the package shift it; without an extension the record ends right before its locator.
        for end_64 in (stated, end - 20 - 56):
            record = read(end_64, 56) if 0 <= end_64 <= end - 76 else b""
            if record.startswith(END_64):
                break
        else:
            raise ValueError("a ZIP64 locator without its directory")
        span, start = struct.unpack_from("<QQ", record, 40)
        end = end_64
    if span + start > end:
        raise ValueError("a central directory beyond the end of its file")
    return end - span, span, end - span - start


def directory_entries(read: Callable[[int, int], bytes], at: int, span: int, shift: int, chunk: int = 1 << 20) -> Iterator[tuple[str, int, int, int]]:
    """Name, method, stored size and place of the local header of each member. The directory is read in pieces."""
    held, done, end = b"", 0, at + span
    while True:
        while len(held) < done + 46 or len(held) < done + 46 + sum(struct.unpack_from("<HHH", held, done + 28)):
            if at >= end:
                if done < len(held):
                    raise ValueError("a broken entry in the central directory")
                return
            piece = read(at, min(chunk, end - at))
            held, done, at = held[done:] + piece, 0, at + len(piece)
        mark, method, stored, full, names, extras, comments, header = struct.unpack_from("<4s6xH8xIIHHH8xI", held, done)
        if mark != ENTRY:
            raise ValueError("a broken entry in the central directory")
        done += 46
        name, extra, place = held[done : done + names], held[done + names : done + names + extras], 0
        while place + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, place)
            if kind == 1:  # the 64-bit form of those numbers that did not fit, in this order
                numbers = iter(struct.unpack_from(f"<{length // 8}Q", extra, place + 4))
                full = next(numbers) if full == NO_32 else full
                stored = next(numbers) if stored == NO_32 else stored
                header = next(numbers) if header == NO_32 else header
            place += 4 + length
        yield name.decode("utf-8", "replace"), method, stored, header + shift
        done += names + extras + comments


def members(packages: DataFrame) -> DataFrame:
    """Columns path, name, at, size: where the bytes of each archive and index member of the packages (path) lie."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file, found = _Range(path), []
                for name, method, size, header in directory_entries(file.read, *directory_place(file.read, file.size)):
                    if name.endswith("/") or not name.startswith(("archive/", "indexes/")):
                        continue
                    if method:
                        raise ValueError(f"{path}: {name} is compressed, only stored members can be read by ranges")
                    local = file.read(header, 30)
                    if not local.startswith(LOCAL):
                        raise ValueError(f"{path}: {name} has no local header")
                    found.append((path, name, header + 30 + sum(struct.unpack_from("<HH", local, 26)), size))
                file.close()
                columns = list(zip(*found)) or [[], [], [], []]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "name", "at", "size"])

    paths = packages.select("path").repartition(file_partitions(packages.sparkSession), "path")
    return paths.mapInArrow(find, "path string, name string, at long, size long")


def split_lines(read: Callable[[int, int], bytes], at: int, size: int, lo: int, hi: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a member that start in its bytes lo to hi."""
    # The line that holds the byte before the split belongs to the split before.
    place = start = max(lo - 1, 0)
    skipping, rest = lo > 0, b""
    while place < size and start < hi:
        piece = read(at + place, min(chunk, size - place))
        place += len(piece)
        *lines, rest = (rest + piece).split(b"\n")
        for line in lines:
            if line and start < hi and not skipping:
                yield line
            skipping = False
            start += len(line) + 1
    if rest and start < hi and not skipping:
        yield rest


def index_entries(found: DataFrame) -> DataFrame:
    """Columns path, name, offset, length: the records that the index members name. ``found`` is what ``members`` returns."""
    splits = found.where(F.col("name").startswith("indexes/")).withColumn(
        "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(INDEX_BYTES).cast("long")))
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, size, lo in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                file, out = _Range(path), []
                for line in split_lines(file.read, at, size, lo, min(lo + INDEX_BYTES, size)):
                    place = json.loads(line.decode().split(" ", 2)[2])
                    out.append((path, "archive/" + place["filename"], int(place["offset"]), int(place["length"])))
                file.close()
                columns = list(zip(*out)) or [[], [], [], []]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "name", "offset", "length"])

    dealt = splits.select("path", "at", "size", "lo").repartition(file_partitions(found.sparkSession), "path", "lo")
    return dealt.mapInArrow(parse, "path string, name string, offset long, length long")


def _headers(block: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the rest begins."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record without the end of its header")
    lines = block[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def parse_record(path: str, offset: int, data: bytes) -> tuple:
    """A row of ``RECORDS`` from the bytes of one record."""
    data = gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data
    fields, start = _headers(data)
    block = data[start : start + int(fields["content-length"])]
    http, body = _headers(block)
    payload, kind = block[body:], fields["warc-type"]
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    if kind == "revisit":
        size, payload = int(http["content-length"]), None
    else:
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{path}, {offset}: the payload does not match its digest")
    return (path, offset, fields["warc-record-id"], kind, fields.get("x-page-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, digest, payload)


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of the packages (path), see ``RECORDS``; a revisit has no payload of its own."""
    found = stage(members(packages), "members")
    entries = index_entries(found).withColumn("block", F.floor(F.col("offset") / BLOCK_BYTES))
    # Every record of a block has bytes in it, so the list is bounded; an index may name a record twice.
    blocks = entries.groupBy("path", "name", "block").agg(F.sort_array(F.collect_set(F.struct("offset", "length"))).alias("places"))
    blocks = blocks.join(found.select("path", "name", "at"), ["path", "name"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in RECORDS.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split(" ")[1]] for c in RECORDS.split(", ")]

        def packed(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path, at, places in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                file, run, rows, held = _Range(path), [], [], 0
                for place in [*[(p["offset"], p["length"]) for p in places], None]:
                    if run and (place is None or place[0] != run[-1][0] + run[-1][1]):
                        data = file.read(at + run[0][0], run[-1][0] + run[-1][1] - run[0][0])
                        for offset, length in run:
                            rows.append(parse_record(path, offset, data[offset - run[0][0] : offset - run[0][0] + length]))
                            held += len(rows[-1][-1] or b"")
                            if held > BLOCK_BYTES:
                                yield packed(rows)
                                rows, held = [], 0
                        run = []
                    if place is not None:
                        run.append(place)
                file.close()
                if rows:
                    yield packed(rows)

    dealt = blocks.select("path", "at", "places", "block").repartition(file_partitions(packages.sparkSession), "path", "block")
    return dealt.select("path", "at", "places").mapInArrow(fetch, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` without payloads; a revisit has the id, size and digest of the record it refers to, ``refers_to`` being its page id."""
    flat = stage(records.drop("payload"), "records")
    named = flat.where("refers_to is not null").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    held = flat.where("refers_to is null").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("holder"), F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest")
    )
    holders = stage(named.join(held, "refers_to"), "holders")
    joined = join_counted(flat, holders, "refers_to", "n", "record_id")
    lost = F.col("refers_to").isNotNull() & F.col("held_digest").isNull()
    digest = F.when(lost, F.raise_error(F.concat(F.lit("no record "), F.col("refers_to"))).cast("string")).otherwise(F.coalesce("held_digest", "payload_digest"))
    return joined.select(
        "path", "offset", "record_id", "record_type", "page_id", "url",
        F.col("holder").alias("refers_to"), F.coalesce("held_bytes", "payload_bytes").alias("payload_bytes"), digest.alias("payload_digest"),
    )


def archive_pages(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages as packages under ``folder``, read them back, and return one row per record."""
    kind = pages.schema[id_column].dataType
    manifest = write_packages(pages, folder, id_column, url, html)
    found = resolve_revisits(read_packages(manifest))
    return found.select(
        F.col("page_id").cast(kind).alias(id_column), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
