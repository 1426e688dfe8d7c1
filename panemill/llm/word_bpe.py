"""BPE of words with word ends: lower case, white space dropped.

A text is cut at added tokens; what is left is normalised (composed, lower case) and split into words, runs of marks and
single digits, each written in the byte alphabet with a word end.  A word is merged from a doubly linked list of symbols and a priority queue of
(rank, place): the least is taken, an entry whose place no longer holds a pair of that rank is stale and skipped, and a merge puts the pairs on both
sides of it into the queue.  So a word of n bytes costs O(n log n) even if it is a megabyte long.  Decoding concatenates the vocabulary's strings, a
blank between two, since the vocabulary has no decoder.

Tasks remember the words they have met.

Cases: a null or empty text, and one of white space only, has no ids and decodes to the empty text; added tokens written in a text are one id each;
columns beyond the id and the text are kept out of the result, so names cannot clash; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words remembered by a worker at most, and the longest; beyond that its memory starts anew.
REMEMBERED, SHORT = 500_000, 40
END = "</w>"

# Code points (hexadecimal, first-last) on which the vocabulary's library and Python's tables of Unicode 15.1 differ.
LATER_LETTERS = """1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1
113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"""
LATER_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: Marks that the library neither orders nor composes.
UNORDERED = """7fd-7fd 898-89f 8ca-8d3 9fe-9fe c3c-c3c d3b-d3c eba-eba 1715-1715 1abf-1ace 1df6-1dfa a82c-a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85
11070-11070 1133b-1133b 1145e-1145e 11839-1183a 11930-11930 1193d-1193e 11943-11943 119e0-119e0 11a34-11a34 11a47-11a47 11a99-11a99 11d42-11d42 11d44-11d45 11d97-11d97
11f41-11f42 16ff0-16ff1 1e08f-1e08f 1e130-1e136 1e2ae-1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"""
#: Capitals and the distance to their small letters.
LATER_CAPITALS = "1c89:1 a7cb:-a567 a7cc:1 a7ce:1 a7d2:1 a7d4:1 a7da:1 a7dc:-a641 10d50-10d65:20 16ea0-16eb8:1b"

# The white space of the library's patterns, and what stands for a word after an apostrophe.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
APOSTROPHE = "'(?:s|t|re|ve|m|ll|d)"


def _points(ranges: str) -> list[int]:
    return [p for part in ranges.split() for p in range(int(part.split("-")[0], 16), int(part.split("-")[1], 16) + 1)]


def _class(points: list[int]) -> str:
    """A character class of sorted code points, as ranges."""
    out, first = [], None
    for here, after in zip(points, [*points[1:], -1], strict=True):
        first = here if first is None else first
        if after != here + 1:
            out.append(f"\\U{first:08x}-\\U{here:08x}")
            first = None
    return "".join(out)


def _capitals() -> dict[int, str]:
    found = {}
    for part in LATER_CAPITALS.split():
        where, by = part.split(":")
        for p in _points(where if "-" in where else f"{where}-{where}"):
            found[p] = chr(p + int(by, 16))
    return found


def alphabet() -> list[str]:
    """The letter of each byte: printable ones stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Model:
    """Vocabulary, merges by rank and added tokens of a tokenizer file: a few megabytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        self.added = {t["content"]: t["id"] for t in read["added_tokens"]}
        vocab = read["model"]["vocab"]
        self.strings = {i: token for token, i in (vocab | self.added).items()}
        letters = alphabet()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + END] for c in letters]
        #: left id << 32 | right id: rank << 32 | merged id
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(read["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])


def merge(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Merges neighbouring symbols, least rank first, leftmost of equals first."""
    n, get = len(symbols), pairs.get
    if n < 2:
        return symbols
    symbols = [*symbols, 0]
    after, before = list(range(1, n + 1)), list(range(-1, n))
    queue = [(found >> 32) * n + k for k in range(n - 1) if (found := get(symbols[k] << 32 | symbols[k + 1])) is not None]
    heapq.heapify(queue)
    while queue:
        rank, k = divmod(heapq.heappop(queue), n)
        j = after[k]
        # A symbol that was merged away has a next one before itself; the pair at a live place may have changed since.
        if j <= k or j == n or (found := get(symbols[k] << 32 | symbols[j])) is None or found >> 32 != rank:
            continue
        symbols[k] = found & 0xFFFFFFFF
        after[k] = stop = after[j]
        after[j] = -1
        before[stop] = k
        if stop < n and (found := get(symbols[k] << 32 | symbols[stop])) is not None:
            heapq.heappush(queue, (found >> 32) * n + k)
        if (p := before[k]) >= 0 and (found := get(symbols[p] << 32 | symbols[k])) is not None:
            heapq.heappush(queue, (found >> 32) * n + p)
    out, k = [], 0
    while k < n:
        out.append(symbols[k])
        k = after[k]
    return out


class Words(dict):
    """What is known of words: bounded, and filled by need."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        found = self.make(word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class Codec:
    """Encoder and decoder of a worker; remembers the ids and strings of words, each joined by blanks."""

    def __init__(self, model: Model):
        self.model = model
        kinds, later = {"L": set(_points(LATER_LETTERS)), "N": set(_points(LATER_NUMBERS))}, _capitals()
        for p in range(sys.maxunicode + 1):
            if (kind := unicodedata.category(chr(p))[0]) in kinds:
                kinds[kind].add(p)
        letters, numbers = (_class(sorted(kinds[k])) for k in "LN")
        # Letters and numbers as Python's patterns have them, which is several times faster, for texts without a character that they get wrong.
        self.plain = re.compile(rf"{APOSTROPHE}|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
        self.exact = re.compile(f"{APOSTROPHE}|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+").findall
        wrong = {chr(p) for p in (*kinds["L"], *kinds["N"]) if (p in kinds["L"], p in kinds["N"]) != (chr(p).isalpha(), chr(p).isdecimal())}
        self.odd = frozenset(wrong | set(map(chr, (*_points(UNORDERED), *later, *range(0x1C, 0x20)))) | {"Σ"})
        self.capitals = later
        self.apart = re.compile(f"([{_class(_points(UNORDERED))}])")
        self.added = re.compile(f"({'|'.join(map(re.escape, sorted(model.added, key=len, reverse=True)))})") if model.added else None
        self.ids = Words(lambda word: " ".join(map(str, self.word(word))))
        self.back = Words(lambda word: self.text(map(int, self.ids[word].split()), model.strings))

    def word(self, word: str) -> list[int]:
        raw, model = word.encode(), self.model
        return merge([*(model.inner[b] for b in raw[:-1]), model.last[raw[-1]]], model.pairs)

    def words(self, text: str) -> list[str]:
        """Words, runs of marks and digits of a text, composed and in lower case, letter by letter."""
        if self.odd.isdisjoint(text):
            return self.plain(unicodedata.normalize("NFC", text).lower())
        composed = "".join(part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(self.apart.split(text)))
        return self.exact("".join(self.capitals.get(ord(c)) or c.lower() for c in composed))

    def lines(self, text: str) -> tuple[str, str]:
        """The text's ids, and the text decoded from them."""
        ids, back = [], []
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                ids.append(str(self.model.added[part]))
                back.append(part)
            elif words := self.words(part):
                ids.append(" ".join(map(self.ids.__getitem__, words)))
                back.append(" ".join(map(self.back.__getitem__, words)))
        return " ".join(ids), " ".join(back)

    @staticmethod
    def text(ids: Iterable[int], name: dict[int, str]) -> str:
        return " ".join(map(name.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.lines(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return self.text(ids, self.model.strings)


_held: list[Codec] = []


def codec_of(model: Model) -> Codec:
    """The codec of a Python worker: its tables and what it remembers serve all tasks that the worker runs on one vocabulary."""
    if not _held or _held[0].model is not model:
        _held[:] = [Codec(model)]
    return _held[0]


def _model(df: DataFrame, path: str):
    """The vocabulary as a broadcast: a few megabytes, whatever the input."""
    return df.sparkSession.sparkContext.broadcast(Model(path))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>."""
    model = _model(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in batches:
            ids = [codec.encode(value.as_py() or "") for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text."""
    model = _model(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = model.value.strings
        for batch in batches:
            out = [Codec.text(ids.as_py() or [], strings) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: id, n_tokens, ids_sha256, decoded_sha256.

    One narrow stage; only digests leave the Python worker.
    """
    model = _model(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for value in batch.column(1):
                line, text = codec.lines(value.as_py() or "")
                counts.append(line.count(" ") + 1 if line else 0)
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
