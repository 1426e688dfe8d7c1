"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; the vector of three letters in a row binds (multiplies) the first
letter's vector permuted twice, the second's permuted once and the third's.  A text's vector bundles (adds) those of its
letter triples, words being padded by a blank; a language's prototype bundles the vectors of its documents.  The language
of a document is that of the prototype with the greatest cosine.

Bundling is linear: each task adds up the vectors of its documents by language, and Spark adds up the tasks' sums, component by
component.  All documents that may be learnt from are counted.  Sums are of whole numbers, so their order doesn't matter; the driver gets one
vector a language, which is the model.

Prototypes are centred on their common mean, so that triples frequent in every language don't blur them.

Cases: a null text, or one without a letter, is ``und`` with score 0; without a language to learn from every document is
``und``; ties go to the first language by code point; null doc_ids are learnt from like the others; repeated rows count as often
as they occur; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panemill.llm.common import crc_mod

DIMENSIONS = 1024
#: Letters told apart: a to z, and others by their code point modulo the rest; 0 is the blank.
SYMBOLS = 128
UNKNOWN = "und"
#: Softness of the score over the languages' cosines.
SHARPNESS = 20.0
#: Languages that a task adds up before it hands them on.
HELD = 500

_letters = np.random.Generator(np.random.PCG64(4096)).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
_symbols: np.ndarray | None = None


def _symbol_table() -> np.ndarray:
    """The symbol of each code point; 0 for whatever is no letter."""
    global _symbols
    if _symbols is None:
        points = np.arange(0x110000)
        letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        other = 27 + points % (SYMBOLS - 27)
        _symbols = np.where(letter, np.where((points >= 97) & (points <= 122), points - 96, other), 0).astype(np.uint8)
    return _symbols


def triples(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter triples of a text by number, and how often each occurs."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _symbol_table()[points]
    if not symbols.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate(([0], symbols, [0])).astype(np.int64)
    padded = padded[(padded > 0) | np.concatenate(([True], padded[:-1] > 0))]  # one blank between words
    codes = (padded[:-2] * SYMBOLS + padded[1:-1]) * SYMBOLS + padded[2:]
    return np.unique(codes, return_counts=True)


class Vectors:
    """Vectors of triples, remembered."""

    def __init__(self):
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.held = np.empty((1024, DIMENSIONS), np.float32)
        self.n = 0

    def of(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.row[codes] < 0]
        if len(new):
            if self.n + len(new) > 60_000:
                self.row[:] = -1
                self.n, new = 0, codes
            while self.n + len(new) > len(self.held):
                self.held = np.concatenate([self.held, np.empty_like(self.held)])
            first, second, third = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            self.held[self.n : self.n + len(new)] = np.roll(_letters[first], 2, 1) * np.roll(_letters[second], 1, 1) * _letters[third]
            self.row[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
        return self.held[self.row[codes]]


def bundles(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, component, value: the sum of the vectors of all letter triples in the documents of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(), {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

        for batch in batches:
            found: dict[str, list] = {}
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, []).append(triples(value.as_py()))
            for lang, parts in found.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([k for _, k in parts]), len(codes))
                own = sums.setdefault(lang, np.zeros(DIMENSIONS))
                for k in range(0, len(codes), 4096):
                    own += n[k : k + 4096] @ vectors.of(codes[k : k + 4096]).astype(float)
            if len(sums) > HELD:
                yield rows()
                sums.clear()
        yield rows()

    parts = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).mapInArrow(run, "lang string, vector array<double>")
    return parts.select("lang", F.posexplode("vector").alias("component", "value")).groupBy("lang", "component").agg(F.sum("value").alias("value"))


def prototypes(sums: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and their centred vectors of unit length, a row each."""
    table = sums.toArrow()  # a number for each language and component
    of = np.array(table.column("lang").to_pylist(), object)
    langs = sorted(set(of.tolist()), key=lambda x: x.encode())
    out, component, value = np.zeros((len(langs), DIMENSIONS)), table.column("component").to_numpy(), table.column("value").to_numpy()
    for k, lang in enumerate(langs):
        own = of == lang
        out[k, component[own]] = value[own]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        out -= out.mean(axis=0)
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score (0 to 1)."""
    held_out = F.coalesce(crc_mod(docs[id_col], 4) == 2, F.lit(False))
    langs, vectors = prototypes(bundles(docs.where(~held_out & docs[lang_col].isNotNull()), text_col, lang_col))
    model = docs.sparkSession.sparkContext.broadcast((langs, vectors.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = model.value
        held = Vectors()
        for batch in batches:
            found, scores = [], []
            for value in batch.column(2):
                codes, n = triples(value.as_py())
                if not len(codes) or not names:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = n.astype(np.float32) @ held.of(codes)
                cosine = (rows @ own) / max(float(np.linalg.norm(own)), 1e-12)
                best = int(np.argmax(cosine))
                likely = np.exp(SHARPNESS * (cosine - cosine[best]))
                found.append(names[best])
                scores.append(float(1 / likely.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), held_out.alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
