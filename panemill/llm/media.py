"""Interleaved document sequences with media columns.

``media_of`` stores a payload losslessly as a grey picture of 8-bit samples (portable grey map, 64 samples a row),
content-addressed by its SHA-256.  ``sequences`` parses HTML into ordered structs, text and media references with their
captions, positions counted over both.  ``resolve`` joins references to media rows by digest, so a sequence keeps its
order whatever the join does.  Media that aren't stored here keep their place and address; a caption belongs to the media of its own figure, and is a part
of its own where a figure has none; tags that are never closed end with the page.  A digest that many documents share is one media row; the reference side of the join
holds ids, positions and captions only, and a hot digest is cut in parts (``spread_join``).

Cases: a null or empty text is a payload of 64 zero bytes; null HTML has an empty sequence; a reference without a
stored payload resolves to nulls; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panemill.llm.common import scratch_path, spread_join, written

#: Samples a row of the picture; payloads are padded with zero bytes to a positive multiple.
WIDTH = 64
#: Prefix of a media reference in the src attribute.
SCHEME = "sha256:"
#: A part is a text, a caption without media, or a reference: by digest if the payload is stored, else by address.
FIELDS = ("kind", "text", "digest", "src", "caption")
SEQUENCE = f"array<struct<pos int, {', '.join(f'{c} string' for c in FIELDS)}>>"
_HEAD = re.compile(rb"P5\n# bytes (\d+)\n(\d+) (\d+)\n255\n")
_BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "br", "tr", "td", "th", "pre", "blockquote", "ul", "ol", "table"}
_SKIPPED = {"script", "style"}


def media_of(payload: bytes) -> bytes:
    """The stored form of a payload: header, then samples."""
    rows = max(1, -(-len(payload) // WIDTH))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(payload), WIDTH, rows) + payload.ljust(rows * WIDTH, b"\0")


def samples_of(media: bytes) -> tuple[int, bytes]:
    """Bytes before padding, and the padded samples, of a stored form."""
    head = _HEAD.match(media)
    if not head or int(head[2]) * int(head[3]) != len(media) - head.end():
        raise ValueError("not a stored payload")
    return int(head[1]), media[head.end() :]


def feature_of(samples: bytes) -> str:
    """Rows, mean level, and an average hash: which of 64 equal stretches of the samples lie above the mean."""
    x = np.frombuffer(samples, np.uint8)
    sums = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64)
    above = sums * 64 * 64 > int(x.sum(dtype=np.int64)) * 64
    return f"{len(x) // WIDTH}:{int(x.sum(dtype=np.int64)) / len(x):.4f}:{int.from_bytes(np.packbits(above).tobytes(), 'big'):016x}"


class _Sequencer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        #: Open figures, innermost last: the places of their media, and the captions' words.
        self.figures: list[tuple[list[int], list[str]]] = []
        self.captions = 0

    def _put(self, **part) -> None:
        self.parts.append({"pos": len(self.parts)} | dict.fromkeys(FIELDS) | part)

    def flush(self) -> None:
        text = "".join(self.words).strip()
        self.words = []
        if text:
            self._put(kind="text", text=text)

    def _end_figure(self) -> None:
        self.flush()
        media, words = self.figures.pop()
        caption = " ".join("".join(words).split())
        self.captions = 0
        if caption and not media:
            self._put(kind="caption", text=caption)
        for at in media if caption else ():
            self.parts[at]["caption"] = caption

    def finish(self) -> None:
        while self.figures:
            self._end_figure()
        self.flush()

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "figure":
            self.flush()
            self.captions = 0
            self.figures.append(([], []))
        elif tag == "figcaption" and self.figures:
            self.flush()
            self.captions += 1
            self.figures[-1][1].append(" ")
        elif tag in ("img", "video", "audio", "source"):
            src = dict(attrs).get("src") or ""
            if src:
                self.flush()
                stored = src.startswith(SCHEME)
                self._put(kind=tag, digest=src.removeprefix(SCHEME) if stored else None, src=None if stored else src, caption=dict(attrs).get("alt"))
                if self.figures:
                    self.figures[-1][0].append(len(self.parts) - 1)
        elif tag in _BLOCK and not self.captions:
            self.flush()
        elif tag in _BLOCK:
            self.figures[-1][1].append(" ")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.captions = max(0, self.captions - 1)
        elif tag == "figure" and self.figures:
            self._end_figure()
        elif tag in _BLOCK and not self.captions:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.figures[-1][1] if self.captions and self.figures else self.words).append(data)


def parse(page: str | None) -> list[dict]:
    """The ordered parts of a page."""
    reader = _Sequencer()
    reader.feed(page or "")
    reader.close()
    reader.finish()
    return reader.parts


def sequences(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """id, sequence: the ordered text and media references of each page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.struct([("pos", pa.int32()), *((c, pa.string()) for c in FIELDS)])
        for batch in batches:
            for at in range(0, len(batch), 256):
                own = batch.slice(at, 256)
                parts = pa.array([parse(page.as_py()) for page in own.column(1)], pa.list_(part))
                yield pa.RecordBatch.from_arrays([own.column(0), parts], names=["id", "sequence"])

    return pages.select(pages[id_col].alias("id"), pages[html_col].alias("html")).mapInArrow(run, f"id {kind}, sequence {SEQUENCE}").withColumnRenamed("id", id_col)


def references(sequenced: DataFrame, id_col: str) -> DataFrame:
    """id, pos, digest, caption, parts: the references of sequences to stored media, a row each, and how many parts the sequence has."""
    part = F.explode(F.filter("sequence", lambda p: p.digest.isNotNull())).alias("part")
    return sequenced.select(id_col, part, F.size("sequence").alias("parts")).select(id_col, "part.pos", "part.digest", "part.caption", "parts")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References (a written table) with the columns of the media row of their digest, one per digest; nulls where there is none."""
    return spread_join(refs, media, ["digest"], "left")


def page_of(text: str | None, digest: str) -> str:
    """A document as a page: its paragraphs, then its stored payload as a captioned picture."""
    body = "".join(f"<p>{html.escape(line, quote=False)}</p>" for line in (text or "").split("\n") if line.strip())
    return f'<article>{body}<figure><img src="{SCHEME}{digest}"><figcaption>{len((text or "").encode())} bytes</figcaption></figure></article>'


def store(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Writes (digest, media) for the texts of docs under ``path`` and returns the table as read back.

    A task stores a digest it has just stored no second time; copies in other tasks are the reader's to merge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for at in range(0, len(batch), 256):
                digests, stored = [], []
                for value in batch.column(0).slice(at, 256):
                    media = media_of((value.as_py() or "").encode())
                    digest = hashlib.sha256(media).hexdigest()
                    if digest not in seen:
                        if len(seen) >= 100_000:
                            seen.clear()
                        seen.add(digest)
                        digests.append(digest)
                        stored.append(media)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(stored, pa.binary())], names=["digest", "media"])

    docs.select(docs[text_col].alias("text")).mapInArrow(run, "digest string, media binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("digest string, media binary").parquet(path)


def described(stored: DataFrame) -> DataFrame:
    """From stored media one row per digest: sizes, digests and features of the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, samples = samples_of(media := value.as_py())
                rows.append((digest, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=DESCRIBED)

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema).dropDuplicates(["digest"])


DESCRIBED = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def paged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, html: documents as pages that refer to their stored payload."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                own = batch.slice(at, 256)
                pages = [page_of(text, hashlib.sha256(media_of((text or "").encode())).hexdigest()) for text in own.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(pages, pa.string())], names=["id", "html"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, html string").withColumnRenamed("id", id_col)


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the texts, reads them back, and resolves each document's reference: id, the columns of ``described`` but the digest, pos, caption, parts."""
    path = scratch_path(docs.sparkSession, "media")
    media = described(store(docs, path, text_col))
    refs = written(references(sequences(paged(docs, id_col, text_col), id_col), id_col), "references")
    return resolve(refs, media).select(id_col, *DESCRIBED[1:], "pos", "caption", "parts")
