"""WARC archives of pages: one gzip member per record, written in tasks and read back in sequence.

Archives are files of WARC 1.1 in a shared folder. A record's block is an HTTP response whose body
is the page; a page whose body another record holds is a revisit with the HTTP header alone. The
reader goes through an archive once: it inflates a member piece by piece, frames the block by its
``Content-Length`` and checks both digests, so neither a record nor an archive is ever whole in memory.

A task writes an archive under a name of its own and lists it in its result once it is complete.
The list is a table that Spark commits, so what a lost or repeated task leaves is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import octets, slices, staged
from ledgerloom.session import shared_folder

LEAST_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
PIECE = 1 << 16
HEADER_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_URN = re.compile(r"<urn:ledgerloom:page:(-?\d+|none):(\d+)>\Z")


class Damaged(ValueError):
    """A member that is cut off, not WARC, wrongly framed, or whose digest differs."""


def opened(path: str):
    """A seekable file of any filesystem that Arrow knows (local, HDFS, object stores)."""
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


# Writing


def _digest(parts: Iterable[bytes]) -> str:
    sha = hashlib.sha1()
    for part in parts:
        sha.update(part)
    return "sha1:" + base64.b32encode(sha.digest()).decode()


def _uri(url: str) -> tuple[str, bool]:
    """The URL for a header line, and if it had to be escaped: control characters and spaces may not stand there."""
    if not re.search(r"[\x00-\x20\x7f]", url):
        return url, False
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url), True


def _unescaped(uri: str) -> str:
    return re.sub(r"%(0[0-9A-F]|1[0-9A-F]|20|25|7F)", lambda m: chr(int(m[1], 16)), uri)


def record(fields: list[tuple[str, str]], block: list[bytes]) -> bytes:
    """One gzip member: header lines, the block's digest and length, the block."""
    lines = [*fields, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(sum(map(len, block))))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    gzip = zlib.compressobj(wbits=31)
    return b"".join([*map(gzip.compress, [head.encode("utf-8", "surrogateescape"), *block, b"\r\n\r\n"]), gzip.flush()])


def _page_id(page: int | None, row: int) -> str:
    return f"<urn:ledgerloom:page:{'none' if page is None else page}:{row}>"


def page_record(page: int | None, row: int, url: str | None, body: bytes, refers: tuple[int | None, int] | None, date: str) -> bytes:
    """The record of a page: a response with the body, or a revisit of the page and row in ``refers``."""
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _page_id(page, row)), ("WARC-Date", date)]
    if url is not None:
        uri, escaped = _uri(url)
        fields += [("WARC-Target-URI", uri), *([("X-Target-URI-Escaped", "yes")] if escaped else [])]
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _page_id(*refers))]
    fields += [("WARC-Payload-Digest", _digest([body])), ("Content-Type", "application/http;msgtype=response")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return record(fields, [head] if refers is not None else [head, body])


class Archive:
    """A file under a name of its own, complete once it is closed."""

    def __init__(self, folder: str, date: str):
        self.system, inside = fs.FileSystem.from_uri(folder)
        self.system.create_dir(inside, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        self.path, self.inside = f"{folder}/{name}", f"{inside}/{name}"
        self.out = self.system.open_output_stream(f"{self.inside}.open", compression=None)
        self.records = self.size = 0
        self.add(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                         ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], [b"format: WARC File Format 1.1\r\n"]))

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.records, self.size = self.records + 1, self.size + len(member)

    def close(self) -> dict:
        self.out.close()
        self.system.move(f"{self.inside}.open", self.inside)
        return {"path": self.path, "n_records": self.records, "n_bytes": self.size}


def write_warc(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row into archives in ``folder``; ``path``, ``n_records``, ``n_bytes`` of each archive.

    Of equal bodies of ``least`` bytes or more, the row with the largest id is the response and the
    others revisit it; null is the smallest id, and of rows with one id and one body one is the
    response. Shorter bodies are always responses. A null body is empty; a null URL is left out. An
    empty table gives no archives. Other columns are not read. Bodies count as equal if their SHA-256
    and their length agree.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), text.alias("body")).select(
        F.monotonically_increasing_id().alias("row"), "*", F.octet_length("body").cast("long").alias("n"),
        F.unhex(F.sha2("body", 256)).alias("sha"))
    rows = staged(rows, "warc-pages", compression="zstd")  # row numbers are fixed from here on
    large = rows.filter(F.col("n") >= least).select("sha", "n", "page", "row")
    # Combined in each task before the shuffle; a table, so that a body of very many rows can be split in the join.
    kept = large.groupBy("sha", "n").agg(F.max(F.struct("page", "row")).alias("keep"), F.count("*").alias("times"))
    kept = staged(kept.filter("times > 1").select("sha", "n", "keep"), "warc-repeated")
    again = large.join(kept, ["sha", "n"]).filter("row <> keep.row").select("row", "keep")
    rows = rows.select("row", "page", "url", "body").join(again, "row", "left").select(
        "page", "row", "url", "body", F.col("keep.page").alias("to_page"), F.col("keep.row").alias("to_row"))
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for cut in slices(batch, "body"):
                ids = (cut.column(k).to_pylist() for k in ("page", "row", "to_page", "to_row"))
                urls = [None if u is None else u.decode("utf-8", "surrogateescape") for u in cut.column("url").cast(pa.binary()).to_pylist()]
                for page, row, to_page, to_row, link, body in zip(*ids, urls, octets(cut.column("body"))):
                    archive = archive or Archive(folder, date)
                    archive.add(page_record(page, row, link, body, None if to_row is None else (to_page, to_row), date))
                    if archive.size >= archive_bytes:
                        yield pa.RecordBatch.from_pylist([archive.close()], schema=schema)
                        archive = None
        if archive:
            yield pa.RecordBatch.from_pylist([archive.close()], schema=schema)

    return staged(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-archives")


# Reading


class Members:
    """The gzip members of a file, each inflated piece by piece."""

    def __init__(self, file, piece: int = PIECE):
        self.file, self.piece = file, piece
        self.raw, self.end, self.held = b"", 0, b""

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.file.read(self.piece)
            self.end += len(self.raw)
        return bool(self.raw)

    def open(self) -> bool:
        """Begin the member at the current place; false at the end of the file."""
        if not self._more():
            return False
        self.offset, self.held = self.end - len(self.raw), b""
        self.gzip = zlib.decompressobj(wbits=31)
        return True

    def some(self) -> bytes:
        """The next bytes of the member, ``piece`` at most; nothing at its end."""
        if self.held:
            out, self.held = self.held, b""
            return out
        while not self.gzip.eof:
            try:
                out = self.gzip.decompress(self.raw, self.piece)
            except zlib.error as error:
                raise Damaged(f"not inflatable: {error}") from error
            self.raw = self.gzip.unused_data if self.gzip.eof else self.gzip.unconsumed_tail
            if out:
                return out
            if not self.gzip.eof and not self._more():
                raise Damaged("the file ends inside a member")
        return b""

    def head(self) -> bytes:
        """All up to an empty line, without it; the rest is held."""
        found = b""
        while (at := found.find(b"\r\n\r\n")) < 0:
            if len(found) > HEADER_BYTES or not (more := self.some()):
                raise Damaged("a header does not end")
            found += more
        self.held = found[at + 4:] + self.held
        return found[:at]

    def take(self, size: int, sink: Callable[[bytes], None]) -> None:
        """Hand exactly ``size`` bytes to ``sink``, piece by piece."""
        while size:
            part = self.some()
            if not part:
                raise Damaged("a member is shorter than its length says")
            self.held = part[size:] + self.held if len(part) > size else self.held
            sink(part[:size])
            size -= min(size, len(part))

    def seek_magic(self, after: int) -> None:
        """Go to the next place behind ``after`` where a member may begin, or to the end of the file."""
        self.file.seek(after)
        self.raw, self.end, self.held = b"", after, b""
        tail = b""
        while self._more():
            at = (tail + self.raw).find(_MAGIC)
            if at >= 0:
                place = self.end - len(self.raw) - len(tail) + at
                self.file.seek(place)
                self.raw, self.end = b"", place
                return
            tail, self.raw = (tail + self.raw)[-2:], b""


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    pairs = (line.partition(":") for line in lines)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}


def _length(fields: dict[str, str]) -> int:
    if not re.fullmatch(r"\d+", fields.get("content-length", "")):
        raise Damaged("no content length")
    return int(fields["content-length"])


def _agrees(said: str | None, sha: bytes) -> bool:
    """If a digest header is that of ``sha``: base32 or hex; other algorithms are not checked."""
    name, _, value = (said or "").partition(":")
    return name.lower() != "sha1" or value.lower() == sha.hex() or value.upper() == base64.b32encode(sha).decode()


def _one(members: Members, payload: bool) -> dict:
    """The record of an opened member, its digests checked; ``payload`` asks for the body as well."""
    version, fields = _fields(members.head())
    if not version.startswith("WARC/"):
        raise Damaged("not a WARC record")
    size, kind = _length(fields), fields.get("warc-type", "")
    whole, body, kept = hashlib.sha1(), hashlib.sha1(), []
    length = 0

    def on_body(part: bytes) -> None:
        nonlocal length
        length += len(part)
        whole.update(part)
        body.update(part)
        if payload:
            kept.append(part)

    rest, http = size, {}
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http") and kind in ("response", "revisit"):
        head = members.head()
        rest -= len(head) + 4
        if rest < 0:
            raise Damaged("a header is longer than its block")
        whole.update(head + b"\r\n\r\n")
        http = _fields(head)[1]
    members.take(rest, on_body)
    after = b""
    while part := members.some():
        after += part[:5 - len(after)]
    if after != b"\r\n\r\n":
        raise Damaged("a block does not end where its length says")
    if not _agrees(fields.get("warc-block-digest"), whole.digest()):
        raise Damaged("the block's digest differs")
    digest = body.hexdigest()
    if kind == "revisit":  # its payload is elsewhere; the headers tell of it
        digest, length = _hex(fields.get("warc-payload-digest")), int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    elif not _agrees(fields.get("warc-payload-digest"), body.digest()):
        raise Damaged("the payload's digest differs")
    url = fields.get("warc-target-uri")
    if url is not None:
        url = _unescaped(url) if fields.get("x-target-uri-escaped") == "yes" else url
        url = url.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return {"offset": members.offset, "record_id": fields.get("warc-record-id"), "record_type": kind, "url": url,
            "payload_bytes": length, "payload_digest": digest, "refers_to_id": fields.get("warc-refers-to"),
            "payload": b"".join(kept) if payload and kind != "revisit" else None, "error": None}


def _hex(said: str | None) -> str | None:
    """A SHA-1 digest header as hex; null without one."""
    name, _, value = (said or "").partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def records(file, payload: bool = False, strict: bool = True, piece: int = PIECE) -> Iterator[dict]:
    """The records of an archive in sequence.

    A damaged member raises ``Damaged`` with its place; unless ``strict``, it gives one row with
    ``error``, and reading goes on at the next member that is a record.
    """
    members, lost = Members(file, piece), False
    while members.open():
        try:
            found = _one(members, payload)
        except (Damaged, ValueError) as error:
            if strict:
                raise Damaged(f"record at byte {members.offset}: {error}") from error
            if not lost:
                yield {"offset": members.offset, "error": str(error)}
            lost = True
            members.seek_magic(members.offset + 1)
        else:
            lost = False
            yield found


_RECORDS = "path string, offset long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to_id string, payload binary, error string"


def read_warc(archives: DataFrame, payload: bool = False, strict: bool = True) -> DataFrame:
    """The records of the archives in column ``path``, one archive after another in each task.

    ``payload`` adds the bodies (null otherwise, and for revisits). ``payload_bytes`` and
    ``payload_digest`` (SHA-1, hex) are those read; those of a revisit are what its headers say of the
    whole payload. A null or missing path fails; an empty list gives no records.
    """
    schema = pa.schema([
        (n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (c.split() for c in _RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                with opened(path) as file:
                    for one in records(file, payload, strict):
                        held.append(one | {"path": path})
                        size += 200 + len(one.get("payload") or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    each = archives.select("path")
    return each.repartition(max(1, each.count())).mapInArrow(run, _RECORDS)


def roundtrip(pages: DataFrame, **names: str) -> DataFrame:
    """Write the archives to the shared folder and read every page back from them.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` (the
    response's page) of each row; see ``write_warc`` for nulls, ties and short bodies.
    """
    spark = pages.sparkSession
    found = read_warc(write_warc(pages, shared_folder(spark, "warc"), **names))

    def page(column: str):
        return F.regexp_extract(column, r"^<urn:ledgerloom:page:(-?\d+|none):\d+>$", 1).try_cast("long")

    return found.filter("record_type <> 'warcinfo'").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
ranked AS (
  SELECT *, strlen(html) AS n, row_number() OVER (PARTITION BY html ORDER BY page_id DESC) AS k,
         max(page_id) OVER (PARTITION BY html) AS newest
  FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n < {LEAST_BYTES} OR k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= {LEAST_BYTES} AND k > 1 THEN newest END AS refers_to
FROM ranked"""
