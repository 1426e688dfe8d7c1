"""Importance resampling towards a target distribution, by bit-sliced aggregation.

A document's features are runs of words, hashed to buckets; a bucket's gain is the scaled logarithm of its smoothed share of the target's features over
its share of all documents' features.  A document's weight is the floored mean of the gains of its features.

Within a task a block of documents becomes bit planes: plane j has a bit for each document and bucket, bit j of the bucket's count in the document.
The gains are sliced likewise, into planes of magnitude for positive and for negative ones.  The sum of counts times gains is then the sum over pairs
of planes of 2**(i + j) times the number of bits that both have, which is exact whatever the counts are; no product is ever formed.

The draw takes the highest of weight plus Gumbel noise, which is a function of the seed and the id, so reruns agree.  Scores are whole numbers
within a range that the logarithms bound, so a histogram of them is small whatever the number of documents: it gives how many rows lie above each
score, and only rows of one score are ordered against one another.  The noise spreads documents of one weight over thousands of scores.

Cases: a null or empty text, and one without words, has no features and weight 0; without target or documents all gains are 0; repeated rows are rows
of their own, with equal scores; a null id has the noise of an empty one and comes after others of its score; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panemill.llm.common import written

BUCKETS = 10_000
#: Gains and scores are this many times the natural logarithm.
SCALE = 1000
SEED = 2024
#: Words of the longest feature, words of a document that may be drawn, and the share that is drawn.
LONGEST, LEAST_WORDS, PERCENT = 1, 20, 10
#: Words remembered by a task at most; characters of texts that are sliced together.
REMEMBERED, BLOCK = 500_000, 1_000_000
#: Documents sliced together at most.
ROWS = 256

# A word is a run of digits, letters a to z and anything beyond ASCII; A to Z are lowered first.  The rest of ASCII becomes blanks.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split(b" ")


class Buckets:
    """Buckets of the features of texts; remembers words."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets, self.memo = longest, buckets, {b"": -1}

    def of(self, text: str | None) -> tuple[np.ndarray, int]:
        """Bucket of every feature of a text, and its number of words."""
        words = words_of(text)
        try:
            first = list(map(self.memo.__getitem__, words))
        except KeyError:
            if len(self.memo) > REMEMBERED:
                self.memo = {b"": -1}
            first = [crc if (crc := self.memo.get(w)) is not None else self.memo.setdefault(w, crc32(w)) for w in words]
        crcs = np.array(first, np.int64)
        crcs = crcs[crcs >= 0]
        found = [crcs % self.buckets]
        if self.longest > 1:
            words, run = [w for w in words if w], crcs.tolist()
            for n in range(1, self.longest):
                run = [crc32(b" " + w, crc) for crc, w in zip(run, words[n:])]
                found.append(np.array(run, np.int64) % self.buckets)
        return np.concatenate(found), len(crcs)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: tasks count densely, Spark adds up; a number for each bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, total = Buckets(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(maker.of(value.as_py())[0], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], names=["bucket", "n"])

    found = texts.select(texts[text_col].alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket."""
    a, b, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(SCALE * math.log((t + 1) * (a + n) / ((s + 1) * (b + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _packed(rows: np.ndarray, buckets: np.ndarray, n_rows: int, width: int) -> np.ndarray:
    """Bits set at different (row, bucket), a row of 64-bit words each."""
    at = rows * (2 * width) + (buckets >> 5)
    words = np.bincount(at, np.left_shift(np.int64(1), buckets & 31).astype(float), n_rows * 2 * width)  # sums of different powers: exact
    return words.astype(np.uint32).view(np.uint64).reshape(n_rows, width)


class Planes:
    """Gains by bit: for each sign and bit, the buckets whose gain has it."""

    def __init__(self, gain: np.ndarray):
        self.width = -(-len(gain) // 64)
        self.planes = []
        for sign in (1, -1):
            size = np.maximum(gain * sign, 0)
            for i in range(int(size.max(initial=0)).bit_length()):
                own = np.flatnonzero(size >> i & 1)
                self.planes.append((sign, i, _packed(np.zeros(len(own), np.int64), own, 1, self.width)[0]))

    def sums(self, rows: np.ndarray, buckets: np.ndarray, n_rows: int) -> np.ndarray:
        """The gains of all features (row, bucket), added up by row."""
        out = np.zeros(n_rows, np.int64)
        size = self.width * 64
        cells, counts = np.unique(rows * size + buckets, return_counts=True)
        for j in range(int(counts.max(initial=0)).bit_length()):
            own = cells[(counts >> j & 1) > 0]
            held, at = np.unique(own // size, return_inverse=True)  # most documents have no count with a high bit
            plane = _packed(at, own % size, len(held), self.width)
            for sign, i, mask in self.planes:
                out[held] += sign * (np.bitwise_count(plane & mask).sum(axis=1, dtype=np.int64) << (i + j))
        return out


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """id, n_words, n_features, weight."""
    model = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, maker = Planes(model.value), Buckets(longest, len(model.value))
        for batch in batches:
            features, words, out, held, size = [], [], [], [], 0

            def slice_held() -> None:
                rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
                out.append(planes.sums(rows, np.concatenate(held) if held else rows, len(held)))
                held.clear()

            for value in batch.column(1):
                text = value.as_py()
                own, n = maker.of(text)
                held.append(own)
                features.append(len(own))
                words.append(n)
                size += len(text or "")
                if size > BLOCK or len(held) == ROWS:
                    slice_held()
                    size = 0
            slice_held()
            n = np.array(features, np.int64)
            weight = np.concatenate(out) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Floored, scaled Gumbel noise of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, wanted: int, eligible: Column, id_col: str) -> DataFrame:
    """Adds rank: 1, 2, 3 ... by falling score, then id, for the first ``wanted`` of the eligible rows of a written table; null for the rest.

    Scores are whole numbers of a bounded range, so there are at most about a hundred thousand different ones.
    """
    counts = scored.where(eligible).groupBy("score").count().toArrow()
    score, n = counts.column("score").to_numpy(), counts.column("count").to_numpy()
    order = np.argsort(-score)
    score, n = score[order], n[order]
    above = np.cumsum(n) - n
    in_reach = above < wanted
    table = pa.table({"score": pa.array(score[in_reach], pa.int64()), "above": pa.array(above[in_reach], pa.int64())})
    border = int(score[in_reach].min(initial=2**62))
    drawable = eligible & (F.col("score") >= border)
    above = F.broadcast(scored.sparkSession.createDataFrame(table))
    place = F.row_number().over(W.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "n_features", "weight"))
    drawn = scored.where(drawable).join(above, "score").withColumn("rank", (F.col("above") + place).cast("long")).drop("above")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(scored.where(~drawable).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """id, n_features, weight, score, rank of every document."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    scored = weights(docs, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed))
    scored = written(scored, "scored")
    eligible = F.col("n_words") >= least_words
    wanted = percent * scored.where(eligible).count() // 100
    return ranked(scored, wanted, eligible, id_col).select(id_col, "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The drawn documents, all columns; rows of one id are drawn together."""
    chosen = resample(docs, target, id_col, **settings).where("rank is not null").select(F.col(id_col).alias("_drawn")).distinct()
    return docs.join(chosen, docs[id_col].eqNullSafe(F.col("_drawn")), "left_semi")


#: DuckDB SQL for the same rows: crc32 by its table, over the different words.
ORACLE = rf"""WITH RECURSIVE bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
split AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
goal AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
said AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM split) GROUP BY ALL),
sought AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM goal) GROUP BY ALL),
every AS (SELECT word, hex(word) AS h FROM (SELECT word FROM said UNION SELECT word FROM sought)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % {BUCKETS} AS bucket FROM every, crc),
source AS (SELECT bucket, sum(n) AS s FROM said JOIN hashed USING (word) GROUP BY ALL),
target AS (SELECT bucket, sum(n) AS t FROM sought JOIN hashed USING (word) GROUP BY ALL),
totals AS (SELECT coalesce((SELECT sum(s) FROM source), 0)::DOUBLE AS a, coalesce((SELECT sum(t) FROM target), 0)::DOUBLE AS b),
gain AS (SELECT bucket, floor({SCALE} * ln((coalesce(t, 0) + 1)::DOUBLE * (a + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (b + {BUCKETS}))))::BIGINT AS gain FROM source FULL JOIN target USING (bucket), totals),
summed AS (SELECT row, sum(n)::BIGINT AS f, sum(n * gain)::BIGINT AS g FROM said JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY ALL),
weighed AS (SELECT doc_id, coalesce(f, 0) AS n_features, coalesce((g - ((g % f + f) % f)) // f, 0) AS weight, ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM split LEFT JOIN summed USING (row)),
scored AS (SELECT *, weight + floor(-{SCALE} * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, {PERCENT} * count(*) OVER () // 100 AS wanted FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= wanted THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""
