"""Byte-level BPE encoding and decoding.

Each match of the splitting pattern is merged on its own.  A segment tree over the byte positions holds, for every live
piece, the rank of the pair it forms with its right neighbour; the root names the leftmost pair of least rank, and each
merge updates three leaves in logarithmic time.  So a match of n bytes costs O(n log n) even if it is a megabyte long.

Cases: a null or empty text has no ids, and decodes to no bytes.  Columns beyond the id and the text are kept out of
the result, so names cannot clash.  Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = 1 << 60
FREE = np.int32(2**31 - 1)
#: Chunks and matches remembered by a worker at most; beyond that its memory starts anew.
REMEMBERED = 400_000
#: Marks of which one alone, after letters and before a space, is a match.
PUNCTUATION = (".", ",", ";", ":", "!", "?")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = ranks.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left <= right else right

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            least = left if left <= right else right
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while (least := tree[1]) < NONE:
        k = 1
        while k < size:
            k = 2 * k if tree[2 * k] == least else 2 * k + 1
        i = k - size
        j = end[i]
        end[i] = stop = end[j]
        put(j, NONE)
        if stop < n:
            before[stop] = i
            put(i, get(piece[i : end[stop]], NONE) if end[stop] - i <= longest else NONE)
        else:
            put(i, NONE)
        if (p := before[i]) >= 0:
            put(p, get(piece[p:stop], NONE) if stop - p <= longest else NONE)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Forest:
    """Segment trees of many short matches, worked on side by side in arrays: a row of ``tree`` is one match's tree.

    Each round takes the root of every tree that still has a pair to merge, goes down to the leftmost leaf of that
    rank, and updates the three leaves that the merge touches, level by level.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.uint64)
        self.values = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        both = (self.byte.astype(np.uint64)[:, None] << np.uint64(32) | self.byte.astype(np.uint64)[None, :]).ravel()
        self.byte_pairs = self.rank(both)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), FREE, np.int32)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.values[at], FREE)

    def merge(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, each of two bytes or more and of ``size`` (a power of two) at most, and the ids per piece."""
        n, depth = len(pieces), size.bit_length() - 1
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(piece.ljust(size, b"\0") for piece in pieces), np.uint8).reshape(n, size).astype(np.int64)
        token = np.empty((n, size + 1), np.int64)
        token[:, :size] = self.byte[raw]
        token[:, size] = 0
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        live = np.arange(size) < length[:, None]
        tree = np.full((n, 2 * size), FREE, np.int32)
        tree[:, size : 2 * size - 1] = np.where(live[:, 1:], self.byte_pairs[raw[:, :-1] << 8 | raw[:, 1:]], FREE)
        for low in (size >> k for k in range(1, depth + 1)):
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        flat, tokens, nexts, befores, lives = tree.ravel(), token.ravel(), after.ravel(), before.ravel(), live.ravel()
        rows = np.arange(n)
        while len(rows := rows[flat[rows * 2 * size + 1] < FREE]):
            root, wide = rows * (2 * size), rows * (size + 1)
            least = flat[root + 1]
            k = np.ones(len(rows), np.int64)
            for _ in range(depth):
                k *= 2
                k += flat[root + k] != least
            i = k - size
            j = nexts[wide + i]
            stop = nexts[wide + j]
            nexts[wide + i] = stop
            befores[wide + stop] = i
            tokens[wide + i] = least
            lives[rows * size + j] = False
            p = befores[wide + i]
            first = np.maximum(p, 0)
            right = self.rank(least.astype(np.uint64) << np.uint64(32) | tokens[wide + stop].astype(np.uint64))
            left = self.rank(tokens[wide + first].astype(np.uint64) << np.uint64(32) | least.astype(np.uint64))
            inner = p >= 0
            for sub, leaf, value in (
                (root, j, np.full(len(rows), FREE, np.int32)),
                (root, i, np.where(stop < length[rows], right, FREE)),
                (root[inner], p[inner], left[inner]),
            ):
                at = leaf + size
                flat[sub + at] = value
                for _ in range(depth):
                    at = at >> 1
                    flat[sub + at] = np.minimum(flat[sub + 2 * at], flat[sub + 2 * at + 1])
        return token[:, :size][live], live.sum(axis=1)


class Codec:
    """Encoder and decoder.

    A text is first cut at its single spaces between two other characters: no match of the pattern goes beyond such a
    cut but by the space before it, so whole chunks can be remembered, not just matches.  What is not yet known of a
    block of texts is merged together.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.longest = ranks, pattern, max(map(len, ranks), default=0)
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.named = {str(rank): token for token, rank in ranks.items()} | {"": b""}
        self.forest = Forest(ranks)
        self.matches: dict[str, str] = {}
        self.chunks: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def _split(self, chunk: str) -> list[str] | None:
        """Matches of a chunk that a space stands before; None if white space beside that space makes the cut wrong."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1:] in PUNCTUATION and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1]]
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return self.split(" " + chunk)

    def learn(self, matches: set[str]) -> None:
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for match in matches:
            piece = match.encode()
            if (rank := self.ranks.get(piece)) is not None:
                self.matches[match] = str(rank)
            elif len(piece) <= 64:
                sized.setdefault(1 << (len(piece) - 1).bit_length(), []).append((match, piece))
            else:
                self.matches[match] = ",".join(map(str, merge(piece, self.ranks, self.longest)))
        for size, pairs in sized.items():
            ids, counts = self.forest.merge([piece for _, piece in pairs], size)
            ids, at = list(map(str, ids.tolist())), 0
            for (match, _), count in zip(pairs, counts.tolist(), strict=True):
                self.matches[match] = ",".join(ids[at : at + count])
                at += count

    def encode_block(self, texts: list[str]) -> list[list[str]]:
        """For each text its ids in parts, each part's joined by commas."""
        cuts = [text.split(" ") if text else [] for text in texts]
        if len(self.chunks) > REMEMBERED:
            self.chunks = {}
        new = {c: self._split(c) for c in set(chain.from_iterable(islice(chunks, 1, None) for chunks in cuts)).difference(self.chunks)}
        self.chunks.update(self._merged(new))
        later, out = self.chunks.__getitem__, []
        heads = self._merged({chunks[0]: self.split(chunks[0]) for chunks in cuts if chunks})
        for text, chunks in zip(texts, cuts, strict=True):
            parts = list(map(later, islice(chunks, 1, None)))
            if parts and (not chunks[0] or chunks[0][-1].isspace() or None in parts):
                head, *rest = re.split(r"(?<=\S) (?=\S)", text)
                own = self._merged({(k, c): self.split(" " * (k > 0) + c) for k, c in enumerate([head, *rest])})
                out.append(list(own.values()))
            else:
                out.append([heads[chunks[0]], *parts] if chunks else [])
        return out

    def _merged(self, found: dict) -> dict:
        """The ids of each list of matches."""
        wanted = set(chain.from_iterable(filter(None, found.values())))
        missing = wanted.difference(self.matches)
        if len(self.matches) + len(missing) > REMEMBERED:
            self.matches, missing = {}, wanted
        self.learn(missing)
        known = self.matches.__getitem__
        return {key: None if matches is None else ",".join(map(known, matches)) for key, matches in found.items()}

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.encode_block([text])[0] for i in part.split(",") if i]

    def decode_parts(self, parts: list[str]) -> bytes:
        if len(self.back) > REMEMBERED:
            self.back = {}
        for part in set(parts).difference(self.back):
            self.back[part] = b"".join(map(self.named.__getitem__, part.split(",")))
        return b"".join(map(self.back.__getitem__, parts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_held: list[Codec] = []


def codec_of(ranks: dict[bytes, int], pattern: str) -> Codec:
    """The codec of a Python worker: its tables and what it remembers serve all tasks that the worker runs on one vocabulary."""
    if not _held or _held[0].ranks is not ranks or _held[0].pattern != pattern:
        _held[:] = [Codec(ranks, pattern)]
    return _held[0]


def blocks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, about 4 million characters at a time."""
    held, size = [], 0
    for value in texts:
        held.append(text := value.as_py() or "")
        size += len(text)
        if size > 4_000_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def _ranks(df: DataFrame, path: str):
    """The vocabulary file as a broadcast: a few megabytes, whatever the input."""
    return df.sparkSession.sparkContext.broadcast(load_ranks(path))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>."""
    ranks = _ranks(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks.value, pattern)
        for batch in batches:
            ids = [[int(i) for part in parts for i in part.split(",")] for parts in chain.from_iterable(map(codec.encode_block, blocks(batch.column(1))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, bytes binary."""
    ranks = _ranks(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, r"\s+")  # nothing is split here
        for batch in batches:
            out = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: id, n_tokens, ids_sha256, decoded_sha256.

    One narrow stage; only digests leave the Python worker.
    """
    ranks = _ranks(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks.value, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for parts in chain.from_iterable(map(codec.encode_block, blocks(batch.column(1)))):
                line = ",".join(parts)
                counts.append(line.count(",") + 1 if parts else 0)
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode_parts(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
