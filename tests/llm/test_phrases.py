"""Phrase mining, held against SQL and plain counts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connection, differences
from pyspark.sql import functions as F

from panemill.llm import phrases, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 0) for k, (t, lang) in enumerate(rows)], DOCS)


def by_hand(docs, longest=3, least=10, top=2000, held_by=50):
    words, counts = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            own = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(own)
            counts.update((lang, tuple(own[k : k + n])) for n in range(1, longest + 1) for k in range(len(own) - n + 1))
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in candidates.items():
        if any(100 * b >= held_by * a and len(v) > len(w) and any(v[k : k + len(w)] == w for k in range(len(v))) for (own, v), b in candidates.items() if own == lang):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], words[lang], score))
    found, place = [], Counter()
    for lang, phrase, a, left, right, n, score in sorted(out, key=lambda r: (-r[6], -r[2], r[1].encode())):
        place[lang] += 1
        if place[lang] <= top:
            found.append((lang, place[lang], phrase, a, left, right, n, score))
    return sorted(found)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def sample():
    rng = random.Random(11)
    words = ["Of", "the", "and", "new", "york", "city", "été", "日本", "x_1", "to\x00to", "a\xa0b"]
    docs = []
    for k in range(260):
        own = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice([["new", "york", "city"], ["Of", "the"], ["rare", f"w{k % 9}", "bird"]])
        docs.append((rng.choice([" ", "  ", "\t"]).join(own) + rng.choice(["", ".", " ,\n", "\r\n\x0b\x0c"]) + " ".join(own[:5]), rng.choice(["en", "en", "de", None, "und"])))
    return docs + [(None, "en"), ("", "fr"), (" .,;:!? \t\n", "fr"), ("one", "xx\ty"), ("tab in lang " * 12, "xx\ty"), ("the the the " * 20_000, "long")] + docs[:5]


def test_phrases_equal_sql(spark, sf):
    assert not differences(queries.QUERIES["op11_phrases"](spark, sf), connection(sf), queries.ORACLE["op11_phrases"])


@pytest.mark.parametrize(("vocabulary", "pairs"), [(phrases.VOCABULARY, phrases.PAIRS), (6, 4), (0 + 1, 1), (40, 7)])
def test_phrases_within_and_beyond_the_bounds(spark, vocabulary, pairs):
    docs = sample()
    got = phrases.collocations(documents(spark, docs), vocabulary=vocabulary, pairs=pairs)
    assert rows_of(got) == by_hand(docs)


def test_parameters_and_clashing_columns(spark):
    docs = sample()
    clash = documents(spark, docs).withColumns({c: F.lit("clash") for c in ("word", "n", "key", "phrase", "rank", "score", "a")})
    assert rows_of(phrases.collocations(clash, least=4, top=3, held_by=80)) == by_hand(docs, least=4, top=3, held_by=80)
    assert rows_of(phrases.collocations(clash, longest=2)) == by_hand(docs, longest=2)
    with pytest.raises(ValueError, match="two or three"):
        phrases.collocations(clash, longest=4)


def test_empty_tables(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [(None, None), ("a b", "en")])).count() == 0


def test_exact_scores_of_large_counts(spark):
    rows = [(10**9 + 7, 10**9 + 9, 10**10 + 19), (999_999_999_999, 10**12, 10**12 + 1), (1, 1, 1), (10, 10**14, 10**14)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r["s"] for r in df.select(phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [1_000_000 * a * a // (left * right) for a, left, right in rows]


def test_tiles_count_dense_and_sparse(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(phrases, "DENSE", 300)
    monkeypatch.setattr(phrases, "BLOCK", 4000)
    tiles, want = phrases.Tiles(), Counter()
    for _ in range(7):
        rows, columns = np.minimum(rng.zipf(1.3, 1500), 200_000) - 1, np.minimum(rng.zipf(1.3, 1500), 200_000) - 1
        tiles.add(rows, columns)
        want.update(zip(rows.tolist(), columns.tolist(), strict=True))
    keys, counts = tiles.taken(True)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {r << phrases.BITS | c: n for (r, c), n in want.items()}
    assert (np.diff(keys) > 0).all() and tiles.taken(True) is None


def test_sieve_lets_no_member_out(spark):
    rows = spark.createDataFrame([(f"w{k}",) for k in range(500)], "word string")
    sieve = phrases.sieve_of(F.crc32("word"), rows)
    from zlib import crc32

    assert phrases.passed(sieve, np.array([crc32(f"w{k}".encode()) for k in range(500)])).all()
    assert phrases.passed(sieve, np.array([crc32(f"x{k}".encode()) for k in range(5000)])).sum() < 5


def test_keys_of_pairs_beyond_the_ranks():
    """Rows that are whole keys of pairs, up to 2^36, are counted without an array as long as they are large."""
    rows, columns = np.array([(1 << 36) - 1, 5, (1 << 36) - 1, 5 << 30]), np.array([7, 3, 7, (1 << 18) - 1])
    held = phrases.Tiles(ranked=False)
    held.add(rows, columns)
    held.count()
    held.add(rows[:2], columns[:2])
    keys, counts = held.taken(True)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {((1 << 36) - 1) << 18 | 7: 3, 5 << 18 | 3: 2, (5 << 30) << 18 | (1 << 18) - 1: 1}
