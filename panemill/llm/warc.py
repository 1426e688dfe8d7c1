"""WARC archives: writing pages, normalising whole-file gzip, and reading back by a sidecar index.

Archives that were compressed as one gzip stream cannot be read from the middle.  ``normalise`` inflates such a file
once, as a stream, writes every record anew as a gzip member of its own, and beside the archive an index of offsets;
``read`` then fetches single members.  Every step hands on a manifest of the files of its successful tasks, so what a
lost or repeated task leaves behind is never read; memory holds one record and a bounded piece of the stream, whatever the archive's size and packing.

Files are reached by their URI from the tasks (local or shared mounts, HDFS, S3).

Cases: null HTML is an empty payload; a null URL leaves its header out; a URL is read back as it was, whatever its characters; a null page_id never is a response that others
refer to unless the whole group has none; repeated rows of the largest page_id are all responses; other columns are not
read; no pages give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.llm.common import maybe_broadcast, remove, scratch_path, written

#: Bytes of records after which a task begins another archive.
ROLL = 32 << 20
#: Groups of equal payloads that may be broadcast at most; more are joined by shuffle.
BROADCAST_GROUPS = 500_000
CHUNK = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of a URL beside letters and digits that need no encoding.
SAFE = ":/?#[]@!$&()*+,;=%~"
DATE = "1970-01-01T00:00:00Z"
_LENGTH = re.compile(rb"^Content-Length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
        if quote(url, safe=SAFE) != url:  # characters that a header can't hold as they are
            head.append(f"X-Page-URL: {base64.b64encode(url.encode()).decode()}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed stream."""
    held = bytearray()
    chunks, need = iter(chunks), 0
    while True:
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            length = _LENGTH.search(held, 0, end + 2)
            if not held.startswith(b"WARC/") or not length:
                raise ValueError("not a WARC record")
            need = end + 4 + int(length[1]) + 4
        if end >= 0 and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            continue
        chunk = next(chunks, None)
        if chunk is None:
            if held.strip():
                raise ValueError("archive ends within a record")
            return
        held += chunk


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file, of one member or of many, in pieces of ``CHUNK`` bytes at most, however well it is packed."""
    engine = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield engine.decompress(data, CHUNK)
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data
                engine = zlib.decompressobj(31)
    while not engine.eof and (piece := engine.decompress(b"", CHUNK)):
        yield piece


def fields(whole: bytes) -> dict:
    """Headers of a record by lower-case name, and its block."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    found = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    found = {k.lower(): v for k, v in found.items()}
    return found | {"block": rest[: int(found["content-length"])]}


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def roles(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """id, url, html, and for pages whose payload is found again the id of its response (else null)."""
    key = F.sha1(F.coalesce(F.col("html"), F.lit("")))
    groups = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= revisit_from).groupBy(key.alias("sha")).agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = maybe_broadcast(written(groups, "groups"), BROADCAST_GROUPS)
    return pages.withColumn("sha", key).join(groups, "sha", "left").select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("top")), F.col("top")).alias("top"))


def write_whole(pages: DataFrame, folder: str) -> DataFrame:
    """Writes (id, url, html, top) as archives of one gzip stream each; their URIs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, stream, engine, size = None, None, None, 0
        for batch in batches:
            for page_id, url, html, top in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if stream is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    files, path = _open(uri)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    stream, engine, size = files.open_output_stream(path, compression=None), zlib.compressobj(3, zlib.DEFLATED, 31), 0
                whole = record(page_id, url, (html or "").encode(), top, top is not None)
                stream.write(engine.compress(whole))
                size += len(whole)
                if size >= ROLL:
                    stream.write(engine.flush())
                    stream.close()
                    stream = None
                    yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["uri"])
        if stream is not None:
            stream.write(engine.flush())
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["uri"])

    return written(pages.select("id", "url", "html", "top").mapInArrow(run, "uri string"), "manifest")


def _dealt(manifest: DataFrame) -> DataFrame:
    """One file a task, up to a bound."""
    return manifest.repartition(max(1, min(manifest.count(), 10_000)))


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites the archives of a manifest with a member for each record, and an index beside each; their URIs.

    A line of the index: offset, bytes, record id, type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for batch in batches for u in batch.column(0).to_pylist()):
            source, path = _open(uri)
            made = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            files, to = _open(made)
            files.create_dir(to.rpartition("/")[0], recursive=True)
            at, lines = 0, io.StringIO()
            with source.open_input_stream(path, compression=None) as stream, files.open_output_stream(to, compression=None) as out:
                for whole in records(inflated(stream)):
                    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = engine.compress(whole) + engine.flush()
                    out.write(member)
                    found = fields(whole)
                    lines.write(f"{at} {len(member)} {found['warc-record-id']} {found['warc-type']}\n")
                    at += len(member)
            with files.open_output_stream(f"{to}.idx", compression=None) as out:
                out.write(lines.getvalue().encode())
            yield pa.RecordBatch.from_arrays([pa.array([made])], names=["uri"])

    return written(_dealt(manifest).mapInArrow(run, "uri string"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """A row for each record, fetched member by member by the archive's index."""

    def page(name: str | None) -> int | None:
        digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for batch in batches for u in batch.column(0).to_pylist()):
            files, path = _open(uri)
            rows = []
            with files.open_input_stream(f"{path}.idx", compression=None) as index:
                entries = [line.split(" ", 2)[:2] for line in index.read().decode().splitlines()]
            with files.open_input_file(path) as archive:
                for at, size in entries:
                    found = fields(zlib.decompress(archive.read_at(int(size), int(at)), 31))
                    http, _, payload = found["block"].partition(b"\r\n\r\n")
                    revisit = found["warc-type"] == "revisit"
                    digest = found["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(payload)
                    length = int(_LENGTH.search(http + b"\r\n")[1]) if revisit else len(payload)
                    url = base64.b64decode(found["x-page-url"]).decode() if "x-page-url" in found else found.get("warc-target-uri")
                    rows.append((page(found["warc-record-id"]), url, length, digest, found["warc-type"], page(found.get("warc-refers-to"))))
            for k in range(0, len(rows), 10_000):
                columns = zip(*rows[k : k + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)], names=_NAMES)

    return _dealt(manifest).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None, revisit_from: int = 0, id_col: str = "page_id") -> DataFrame:
    """Writes pages (id, url, html) as archives, normalises them, and reads every record back."""
    folder = folder or scratch_path(spark, "warc")
    pages = pages.select(pages[id_col].cast("long").alias("id"), pages["url"], pages["html"])
    manifest = normalise(write_whole(roles(pages, revisit_from), f"{folder}/whole"), f"{folder}/members")
    remove(spark, f"{folder}/whole")
    return read(manifest)
