"""BPE of words, held against the library that the vocabulary belongs to."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panemill.llm import word_bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def path() -> str:
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    found = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def expected(library, text: str) -> tuple[str, str]:
    ids = library.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


ODD = ["", " ", "\x1c", "a" * 5000, "ab" * 3000 + "é" * 1000, "<|endoftext|>", "x<|endoftext|>y <|startoftext|><|startoftext|> <|end", "Σ ΑΣ İ ǅ ß 한각 é á̖ \U00011935\U00011930", "I'M we'LL 'RE x's 12½³", "...!? -- 😀👨‍👩"]


def test_all_code_points_equal_the_library(path, library):
    codec = word_bpe.Codec(word_bpe.Model(path))
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for glue in (" ", "a", ""):
        for k in range(0, len(points), 400):
            text = glue.join(points[k : k + 400])
            assert codec.lines(text) == expected(library, text), (glue, hex(ord(points[k])))


def test_random_texts_equal_the_library(path, library):
    codec = word_bpe.Codec(word_bpe.Model(path))
    rng = random.Random(13)
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    parts = ["<|endoftext|>", "<|", " ", "\x1c", "é", "'s", "'RE", "Σ", "İ", "a", "B", "9", "½", "é", "\t", "ǅ", "각", "!?", "the", "ING"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["".join(rng.choice(points) for _ in range(30)) for _ in range(800)]
    for text in texts:
        ids, back = codec.lines(text)
        assert (ids, back) == expected(library, text), ascii(text)[:80]
        assert codec.decode(codec.encode(text)) == back


def test_merges_take_the_least_rank_then_the_leftmost():
    pairs = {1 << 32 | 1: 5 << 32 | 2, 2 << 32 | 1: 3 << 32 | 3, 2 << 32 | 2: 1 << 32 | 4}
    assert word_bpe.merge([1, 1, 1, 1], pairs) == [3, 1]  # the pair on the left, then what it opened; the pair in the middle is stale by then
    assert word_bpe.merge([], pairs) == [] and word_bpe.merge([1], pairs) == [1]


def test_round_trip_of_the_table(spark, sf, path, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 300)  # memory starts anew all the time
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + k, t, None, None, 0) for k, t in enumerate([None, *ODD])] + [(None, "a b", None, None, 0)] * 2, DOCS))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = word_bpe.round_trip(docs, path).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids, back = expected(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids.split()), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    decoded = word_bpe.decode(word_bpe.encode(docs.limit(30), path), path)
    assert all(r["text"] == expected(library, texts[r["doc_id"]])[1] for r in decoded.collect())


def test_edge_cases(spark, path):
    clash = spark.createDataFrame([(1, "a b", "x", "y", 0), (2, None, "x", "y", 0)], DOCS).withColumns({c: F.lit("clash") for c in ("id", "n_tokens", "ids", "decoded_sha256")})
    got = word_bpe.round_trip(clash, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(r["n_tokens"] for r in got.collect()) == [0, 2]
    assert word_bpe.round_trip(spark.createDataFrame([], DOCS), path).count() == 0
