"""Web archives: a gzip member per record, written by tasks and read back one record after the other.

An archive is kept as rows of (archive, part, members), each part a run of whole members of about PART_BYTES. Spark writes
and commits these rows, so archives can lie in any store that Spark reaches and a lost task leaves no half archive. The
parts of an archive, end to end, are a .warc.gz file; export_files() writes them as such.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

PART_BYTES = 1 << 20
#: Payloads of fewer bytes are always written whole.
LEAST_SHARED = 100
#: Bytes given to the decompressor at a time.
CHUNK = 1 << 16
_END = b"\r\n\r\n"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + block + _END) + gz.flush()


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool, date: str, level: int = 6) -> bytes:
    """The gzip member of one page: a response with its payload, or a revisit with the response's headers alone."""
    payload = (html or "").encode()
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        # a line feed in a url must not end the header
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _member(headers, block, level)


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of each gzip member of a stream, decompressed piece by piece."""
    gz, out, fed = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            out.append(gz.decompress(chunk))
            fed = True
            chunk = b""
            if gz.eof:
                chunk = gz.unused_data
                yield b"".join(out)
                gz, out, fed = zlib.decompressobj(31), [], False
    if fed:
        raise ValueError("the archive ends inside a gzip member")


def _fits(content: bytes, digest: str | None) -> bool:
    """Whether a digest header is that of content: SHA-256 or SHA-1, in hexadecimal or base32; other kinds and absent ones are not checked."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() not in ("sha1", "sha256"):
        return True
    found = hashlib.new(kind.lower(), content).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and payload of each record in order; frames and such digests as it has are verified.

    Records without an HTTP message, such as warcinfo, have no HTTP headers, and their block is the payload.
    """
    for content in members(chunks):
        head, _, rest = content.partition(_END)
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["Content-Length"])
        block = rest[:n]
        if len(block) < n or rest[n:] != _END:
            raise ValueError("a record's length is not that of its header")
        if not _fits(block, headers.get("WARC-Block-Digest")):
            raise ValueError("a block's digest is not that of its header")
        if not headers.get("Content-Type", "").startswith("application/http"):
            yield headers, {}, block
            continue
        http, _, payload = block.partition(_END)
        if headers["WARC-Type"] == "response" and not _fits(payload, headers.get("WARC-Payload-Digest")):
            raise ValueError("a payload's digest is not that of its header")
        yield headers, {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])}, payload


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of all rows of pages, as rows (archive, part, members).

    Of rows whose payloads are equal and have LEAST_SHARED bytes or more, those with the smallest id are responses, the
    others revisits of it; a null id is larger than any other. Null html is an empty payload, a null url an empty one.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= LEAST_SHARED, F.sha2("html", 256)))
    # written first, so that Spark knows its size: small, it is broadcast; else the join deals out both sides
    first = materialize(rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    joined = rows.join(first, "digest", "left").select("id", "url", "html", "first", (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, part, waiting, held = None, 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [archive], "part": pa.array([part], pa.int32()), "members": [b"".join(waiting)]})

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for page_id, url, html, of, revisit in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    if archive is None:  # the same in each attempt of a task that sees the same first page
                        archive = f"pages-{hashlib.sha256(f'{page_id} {url}'.encode()).hexdigest()[:16]}.warc.gz"
                    waiting.append(record(page_id, url, html, of, revisit, date))
                    held += len(waiting[-1])
                    if held >= PART_BYTES:
                        yield out()
                        part, waiting, held = part + 1, [], 0
        if waiting:
            yield out()

    return joined.mapInArrow(run, "archive string, part int, members binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every response and revisit of the archives: page_id, url, payload_bytes and payload_digest (of the full payload), record_type, refers_to.

    Records of other programs have no page_id where theirs is no page's; a revisit's bytes and digest are those its headers
    tell, null where they tell none or no SHA-256. Records of other types are verified and left out.
    """

    def number(uri: str) -> int | None:
        x = uri.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if uri.startswith("<urn:page:") and x.lstrip("-").isdigit() else None

    def row(h: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if h["WARC-Type"] == "revisit":
            told, kind = http.get("Content-Length", ""), h.get("WARC-Payload-Digest", "").partition(":")
            size, digest = int(told) if told.isdigit() else None, kind[2] if kind[0] == "sha256" else None
        return number(h.get("WARC-Record-ID", "")), h.get("WARC-Target-URI", ""), size, digest, h["WARC-Type"], number(h.get("WARC-Refers-To", ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column(0):
                view = stream.as_buffer()
                records = read_records(view.slice(i, min(CHUNK, view.size - i)).to_pybytes() for i in range(0, view.size, CHUNK))
                found = [row(*r) for r in records if r[0]["WARC-Type"] in ("response", "revisit")]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("members").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive's parts as folder/archive-part.warc.gz, each a whole file; folder is one that all executors mount."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                to = Path(folder) / f"{r['archive'].removesuffix('.warc.gz')}-{r['part']:05d}.warc.gz"
                own = to.with_name(f".{to.name}-{id(r)}")
                own.write_bytes(r["members"])
                own.replace(to)  # a second attempt writes the same bytes
                yield pa.RecordBatch.from_pydict({"path": [str(to)], "bytes": [len(r["members"])]})

    return archives.mapInArrow(run, "path string, bytes long")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """read_archives() of the .warc.gz files at path."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("members")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(materialize(write_archives(table(spark, sf_dir, "pages")))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op6_warc": """
with p as (select page_id, coalesce(html, '') html, octet_length(encode(coalesce(html, ''))) n from pages),
     f as (select html, min(page_id) first from p where n >= 100 group by html having count(*) > 1)
select p.page_id, cast(p.n as bigint) payload_bytes, sha256(p.html) payload_digest,
       case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end record_type,
       case when f.first is null or f.first = p.page_id then null else f.first end refers_to
from p left join f on p.html = f.html"""
}
