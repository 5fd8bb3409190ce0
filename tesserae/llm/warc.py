"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

An archive is a series of gzip members, a record in each. The reader checks each member (its checksum, its record
header, the lengths, the fields and the payload digest); after a failed check it looks for the next member that inflates
to a record, or, in an uncompressed archive, for the next version line, and logs the gap it had to pass over. Where
the end of a damaged record is certain, because its member inflates or its length leads to a version line or to the end
of the archive, all of it is quarantined: what its payload quotes is never read as a record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Payloads of so many bytes and more are stored once.
REVISIT_FROM = 1000
#: An archive is closed at this size.
ARCHIVE_BYTES = 64 << 20
#: Members are inflated by so many bytes at a time.
STEP = 1 << 16
NUMBER = re.compile("[0-9]{1,18}")
SHA1 = re.compile("sha1:[A-Z2-7]{32}")
DATE = "2024-01-01T00:00:00Z"


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


class Damaged(ValueError):
    """A check failed; where the record ends is certain."""

    def __init__(self, reason: str, end: int):
        super().__init__(reason)
        self.end = end


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def _head(pairs: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs).encode() + b"\r\n"


def sha1_label(payload_sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(payload_sha1_hex)).decode()


def record_bytes(page_id: int, url: str, payload: bytes, sha1_hex: str, refers_to: int | None, compress: bool = True) -> bytes:
    """A response or, with refers_to, a revisit record. A revisit keeps the full payload's length in an extension field."""
    body = b"" if refers_to is not None else payload
    clean = re.sub(r"[\x00-\x20\x7f]+", "%20", url)
    pairs = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", clean), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1_label(sha1_hex)), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        pairs += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + body
    raw = _head([*pairs, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=1, mtime=0) if compress else raw


def parse(raw: bytes, at: int = 0, whole: bool = False) -> tuple[Record, int]:
    """The record at a place, and where it ends. ValueError if a check fails, Damaged if the record's end is certain."""
    m = VERSION.match(raw, at)
    end = raw.find(b"\r\n\r\n", at)
    if not m or end < 0:
        raise ValueError("no version line or header")
    headers = {}
    for line in raw[m.end() : end].decode("utf-8", "replace").split("\r\n"):
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError("a header line has no colon")
        headers[k.strip()] = v.strip()
    length = headers.get("Content-Length", "")
    if not NUMBER.fullmatch(length):
        raise ValueError("no content length")
    block = raw[end + 4 : end + 4 + int(length)]
    stop = end + 4 + int(length)
    if len(block) < int(length) or raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("the block is cut short")
    stop += 4
    if whole and stop != len(raw):
        raise ValueError("bytes after the record")
    cut = block.find(b"\r\n\r\n")
    record = Record(headers, block[cut + 4 :] if cut >= 0 else block)
    try:
        _check(record)
    except ValueError as e:
        if stop == len(raw) or VERSION.match(raw, stop):
            raise Damaged(str(e), stop) from None
        raise
    return record, stop


def _check(record: Record) -> None:
    """ValueError if a response's payload has another digest, or fields of a revisit cannot be read."""
    kind, want = record.headers.get("WARC-Type"), record.headers.get("WARC-Payload-Digest", "")
    if kind == "response" and want.startswith("sha1:") and want != sha1_label(hashlib.sha1(record.payload).hexdigest()):
        raise ValueError("the payload digest differs")
    if kind == "revisit":
        if not SHA1.fullmatch(want):
            raise ValueError("a revisit without a digest of its payload")
        if not NUMBER.fullmatch(record.headers.get("X-Payload-Length", "0")):
            raise ValueError("a payload length is no number")


def _deflated(view: memoryview, at: int) -> int | None:
    """Where a member of which only the checksum or the length is wrong ends, if another member or nothing follows."""
    if bytes(view[at : at + 4]) != MAGIC + b"\0":
        return None
    inflate, at = zlib.decompressobj(-15), at + 10
    try:
        while at < len(view) and not inflate.eof:
            piece = view[at : at + STEP]
            inflate.decompress(piece)
            at += len(piece)
    except zlib.error:
        return None
    end = at - len(inflate.unused_data) + 8
    return end if inflate.eof and (end == len(view) or bytes(view[end : end + 3]) == MAGIC) else None


def _member(data: bytes, at: int) -> tuple[Record, int]:
    """The record in the gzip member at a place, and where the member ends. ValueError if a check fails, Damaged if the
    member inflates."""
    inflate, out, view, start = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while at < len(data) and not inflate.eof:
            piece = view[at : at + STEP]
            out.append(inflate.decompress(piece))
            at += len(piece)
    except zlib.error as e:
        end = _deflated(view, start)
        raise Damaged(f"member: {e}", end) if end else ValueError(f"member: {e}") from None
    if not inflate.eof:
        raise ValueError("the member is cut short")
    end = at - len(inflate.unused_data)
    try:
        return parse(b"".join(out), whole=True)[0], end
    except ValueError as e:
        raise Damaged(str(e), end) from None


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive, compressed or not, and a Gap for each stretch of bytes passed over."""
    at, lost, why = 0, None, ""
    packed = data[:2] == MAGIC[:2] or (not VERSION.match(data) and data.find(MAGIC) >= 0 and not VERSION.search(data))
    while at < len(data):
        try:
            record, end = _member(data, at) if packed else parse(data, at)
        except ValueError as e:
            if lost is None:
                lost, why = at, str(e)
            if isinstance(e, Damaged):
                at = e.end
                continue
            if packed:
                at = data.find(MAGIC, at + 1)
            else:
                m = VERSION.search(data, at + 1)
                at = m.start() if m else -1
            if at < 0:
                break
            continue
        if lost is not None:
            yield Gap(lost, at, why)
            lost = None
        yield record
        at = end
    if lost is not None:
        yield Gap(lost, len(data), why)


def _open(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _normal(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


MANIFEST = "archive string, n_records long, n_bytes long"
READ = "archive string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, gap_start long, gap_end long, gap_reason string"


def plan(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages (page_id, url, html) with the digest and, for all but the last of equal payloads, whom it revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    last = rows.where(F.col("bytes") >= REVISIT_FROM).groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1").select("digest", "bytes", "last")
    last = scratch.table(last, "copies")  # read back, so that a digest with very many copies is a splittable join
    return rows.join(last, ["digest", "bytes"], "left")


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Writes archives into a folder and returns their manifest. Each attempt of a task writes files of its own; only
    those in the manifest count, so a repeated task leaves no record twice."""
    folder = _normal(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []
        for pdf in frames:
            for page_id, url, html, digest, last in zip(pdf["page_id"].array, pdf["url"], pdf["html"], pdf["digest"], pdf["last"].array, strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                number = "" if pd.isna(page_id) else int(page_id)
                refers = None if pd.isna(last) or number == "" or int(last) == number else int(last)
                data = record_bytes(number, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield pd.DataFrame(done, columns=["archive", "n_records", "n_bytes"])

    return planned.select("page_id", "url", "html", "digest", F.col("last").cast("long").alias("last")).mapInPandas(run, MANIFEST)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives named in manifest (archive), and a row for each gap (page_id and digest null)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in READ.split(", ")]
        for pdf in frames:
            for path in pdf["archive"]:
                store, place = _open(path)
                with store.open_input_stream(place) as f:
                    data = f.read()
                rows = []
                for x in salvage(data):
                    if isinstance(x, Gap):
                        rows.append((path, None, None, None, None, None, None, x.start, x.end, x.reason))
                    else:
                        rows.append((path, *fields(x), None, None, None))
                    if len(rows) >= 5_000:
                        yield _frame(rows, columns)
                        rows = []
                yield _frame(rows, columns)

    return manifest.select("archive").mapInPandas(run, READ)


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to", "gap_start", "gap_end")})


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", urn or "")
    return int(m[1]) if m else None


def fields(record: Record) -> tuple:
    """page_id, payload bytes, digest, type, refers_to, url; all but a revisit's are computed from the payload."""
    h, kind = record.headers, record.headers.get("WARC-Type")
    if kind != "revisit":
        n, digest = len(record.payload), hashlib.sha1(record.payload).hexdigest()
    else:
        n, digest = int(h.get("X-Payload-Length", 0)), base64.b32decode(h.get("WARC-Payload-Digest", "")[5:]).hex()
    return _page(h.get("WARC-Record-ID")), n, digest, kind, _page(h.get("WARC-Refers-To")), h.get("WARC-Target-URI")


def roundtrip(pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in the shared folder and reads them back: a row per page.

    A null html is an empty payload, a null url an empty one. A null page_id gives a record without a number: it is
    always a response. Of repeated rows with equal page_id and payload all are responses if their page_id is the
    largest of the equal payloads. Very long payloads are records like any other; an archive holds one of them at most
    past its size. An empty table gives an empty one; other columns are left out. Gaps, which archives just written
    do not have, are rows with gap_start, gap_end and gap_reason.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    manifest = scratch.table(write(plan(pages, scratch), scratch.folder("archives")), "manifest")
    # one task per archive at most: an archive has at most ARCHIVE_BYTES and a record
    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism + 1000))
    return read_archives(manifest.repartition(n, "archive"))
