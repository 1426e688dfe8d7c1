"""Importance resampling, held against SQL and direct sums."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from compare import connection, differences
from pyspark.sql import functions as F

from panemill.llm import queries, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS)


def by_hand(docs, target, longest=1, percent=10, least=20, buckets=10000):
    """Rows (doc_id, n_features, weight, score, rank), a feature at a time."""

    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(words) - n + 1)], len(words)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    a, b, out = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        own, n = features(text)
        weight = sum(math.floor(1000 * math.log((t[f] + 1) * (a + buckets) / ((s[f] + 1) * (b + buckets)))) for f in own) // max(1, len(own))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_resampling_equals_sql(spark, sf):
    assert not differences(queries.QUERIES["op12_resampling"](spark, sf), connection(sf), queries.ORACLE["op12_resampling"])


def test_resampling_by_hand_with_long_texts_nulls_and_repeats(spark):
    rng = random.Random(12)
    words = ["Alpha", "beta", "gamma", "été", "x1", "日本", "the"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    docs += [(200, "the " * 70_000 + "beta"), (201, None), (202, ""), (203, " ,.;"), (5, docs[5][1]), (5, docs[5][1]), (None, "beta " * 30), (204, "beta\x00the_été—x" * 10)]
    target = ["alpha beta beta", None, "", "日本 été " * 50]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    assert rows_of(resampling.resample(documents(spark, docs), benchmark)) == by_hand(docs, target)
    got = resampling.resample(documents(spark, docs), benchmark, longest=2, percent=50, least_words=5, buckets=100)
    assert rows_of(got) == by_hand(docs, target, longest=2, percent=50, least=5, buckets=100)
    clash = documents(spark, docs).withColumns({c: F.lit("clash") for c in ("id", "weight", "score", "rank", "n_words", "above")})
    assert rows_of(resampling.resample(clash, benchmark)) == by_hand(docs, target)
    kept = resampling.drawn_documents(clash, benchmark)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in by_hand(docs, target) if r[4]}


def test_resampling_of_empty_tables(spark):
    none, some = documents(spark, []), [(1, "a b c")]
    assert resampling.resample(none, none).count() == 0
    assert rows_of(resampling.resample(documents(spark, some), none)) == by_hand(some, [])


def test_planes_give_exact_sums():
    rng = np.random.default_rng(4)
    gain = rng.integers(-30_000, 30_000, 777)
    rows, buckets = rng.integers(0, 9, 50_000), rng.integers(0, 777, 50_000)
    want = np.zeros(10, np.int64)
    np.add.at(want, rows, gain[buckets])
    assert (resampling.Planes(gain).sums(rows, buckets, 10) == want).all()
    assert (resampling.Planes(np.zeros(5, np.int64)).sums(rows[:0], rows[:0], 3) == 0).all()
