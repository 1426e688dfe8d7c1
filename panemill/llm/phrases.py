"""Phrase collocation mining by direct-address tiling.

Frequent words get ids by rank, language by language.  A task turns texts into ids and counts neighbouring pairs in tiles of the matrix of ids: a tile
that a block of pairs fills well is counted by one dense bincount over its cells, all others as a sorted list of (row, column, count); Spark adds up
what the tasks counted, key by key, so a frequent pair is one row a task and no group is large.  Frequent pairs are ranked anew, and phrases of three
words are counted the same way, in tiles of pair rank and word id.

The ids that tasks hold are bounded: ``VOCABULARY`` words and ``PAIRS`` pairs, the most frequent ones.  What is beyond is counted exactly as well: phrases
with a further frequent word by their text, and triples that begin with a further frequent pair by their whole key.  Tasks tell such words and pairs from
infrequent ones by a sieve, a bitmap of fixed size of their hashes, which lets some infrequent ones through, but no frequent one is lost; counts are compared
with the limit afterwards.  Tasks look up the words of the vocabulary; further words are the least frequent, so joins on them have no hot key; joins of triples
with their pairs split hot pairs.

A candidate is a phrase of two or three words with the least count.  It is cut into a first part and the rest where the score, the scaled square of its count
over the product of the parts' counts, is lowest; products are decimals of 38 digits, so the division is exact.

Cases: a null text is empty; a null language is ``und``; empty texts have no words; null and repeated ids don't matter, each row is a document; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panemill.llm.common import spread_join, written

LEAST = 10
TOP = 2000
#: A phrase goes if a longer one that holds it has at least this share of its count, in percent.
HELD_BY = 50
SCALE = 1_000_000
#: Words and pairs that have an id in tasks at most: 2**18 and 2**20, so three word ids fit in a whole number of 64 bits.
VOCABULARY, PAIRS = 1 << 18, 1 << 20
BITS = 18
#: Side of a tile; pairs of a block from which it is dense.
TILE, DENSE = 512, 512 * 512 // 8
#: Pairs that are counted together, and counts that a task holds before it hands them on, at most.
BLOCK, HELD = 1_000_000, 1_000_000
#: Bits of a sieve.
SIEVE = 1 << 25
#: Groups that the best phrases of a language are first sought in.
GROUPS = 64
#: Ids of no word: the end of a piece, a word that is not frequent, and one that may be but has no id.
END, RARE, MAYBE = -1, -2, -3
#: Words that a task counts before it hands them on.
WORDS_HELD = 500_000

# A piece ends at .,;:!? and at line ends; words of a piece stand between blanks and tabs; A to Z are lowered.
_BREAK = b"\xff"  # no byte of UTF-8
_BYTES = bytes(255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, with ``_BREAK`` where a piece ends."""
    return (text or "").encode().translate(_BYTES).replace(_BREAK, b" \xff ").split()


def _lang(lang: str | None) -> str:
    return "und" if lang is None else lang


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of all words; the row of a null word has the language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            langs, words, counts = [], [], []
            for lang, found in held.items():
                found.pop(_BREAK, None)
                langs += [lang] * (len(found) + 1)
                words += [None, *found]
                counts += [sum(found.values()), *found.values()]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])

        size = 0
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = held.setdefault(_lang(lang), Counter())
                before = len(found)
                found.update(words_of(value.as_py()))
                size += len(found) - before
                if size > WORDS_HELD:
                    yield rows()
                    held.clear()
                    size = 0
        yield rows()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# --- what tasks know


def sieve_of(crc: Column, rows: DataFrame) -> np.ndarray:
    """The bitmap of numbers modulo ``SIEVE``, put together by Spark: at most ``SIEVE`` / 32768 rows of 4 KB."""
    place = rows.select((F.pmod(crc, F.lit(SIEVE)) + 1).alias("at"))
    found = place.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    out = np.zeros((SIEVE >> 15, 4096), np.uint8)
    for part, bits in zip(found.column("part").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[part - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def passed(sieve: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers % SIEVE
    return (sieve[at >> 3] >> (at & 7) & 1) > 0


class Known(dict):
    """Ids of a language's words; a word without one is ``RARE`` or ``MAYBE``."""

    def __init__(self, pairs, lang: str, sieve: np.ndarray | None):
        super().__init__(pairs)
        self[_BREAK] = END
        self.start, self.sieve = crc32(f"{lang}\t".encode()), sieve

    def __missing__(self, word: bytes) -> int:
        if self.sieve is None:
            return RARE
        at = crc32(word, self.start) % SIEVE
        return MAYBE if self.sieve[at >> 3] >> (at & 7) & 1 else RARE


class Lexicon:
    """The words' ids by language, and the sieve of further frequent words; as a broadcast it is an Arrow table and a bitmap."""

    def __init__(self, table: pa.Table, sieve: np.ndarray | None):
        self.table, self.sieve, self.by = table, sieve, None

    def of(self, lang: str) -> Known:
        if self.by is None:
            langs, words = self.table.column("lang").to_pylist(), self.table.column("word").cast(pa.binary()).to_pylist()
            found: dict[str, list] = {}
            for k, (own, word) in enumerate(zip(langs, words, strict=True)):
                found.setdefault(own, []).append((word, k))
            self.by = {own: Known(pairs, own, self.sieve) for own, pairs in found.items()}
        return self.by.get(lang) or Known((), lang, self.sieve)

    def __getstate__(self):
        return {"table": self.table, "sieve": self.sieve, "by": None}


class Ranked:
    """Ranks of pair keys, and the sieve of further frequent pairs."""

    def __init__(self, keys: np.ndarray, sieve: np.ndarray | None, texts: np.ndarray | None):
        order = np.argsort(keys)
        self.keys, self.sorted, self.rank, self.sieve, self.texts = keys, keys[order], order, sieve, texts

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.sorted, keys)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == keys, self.rank[at], -1)


# --- counting


class Tiles:
    """Counts of (row, column): dense tiles by bincount, the others as sorted keys; the sums of several blocks stay sorted.

    ``ranked`` tells that rows are ids or ranks, so there are few tiles.  Rows that are keys of pairs reach 2^36 and have no dense tiles; they are only sorted.
    """

    def __init__(self, ranked: bool = True):
        self.ranked = ranked
        self.rows, self.columns, self.size = [], [], 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, rows: np.ndarray, columns: np.ndarray) -> None:
        self.rows.append(rows)
        self.columns.append(columns)
        self.size += len(rows)
        if self.size >= BLOCK:
            self.count()

    def count(self) -> None:
        if not self.size:
            return
        row, column = np.concatenate(self.rows), np.concatenate(self.columns)
        self.rows, self.columns, self.size = [], [], 0
        found = [(self.keys, self.counts)]
        filled = np.zeros(0, np.int64)
        if self.ranked:
            wide = (1 << BITS) // TILE
            tile = row // TILE * wide + column // TILE
            filled = np.flatnonzero(np.bincount(tile) >= DENSE)
        for at in filled.tolist():
            own = tile == at
            top, left = at // wide * TILE, at % wide * TILE
            cells = np.bincount((row[own] - top) * TILE + (column[own] - left), minlength=TILE * TILE)
            held = np.flatnonzero(cells)
            found.append(((held // TILE + top) << BITS | (held % TILE + left), cells[held]))
        rest = ~np.isin(tile, filled) if len(filled) else slice(None)
        found.append(np.unique(row[rest] << BITS | column[rest], return_counts=True))
        keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first)

    def taken(self, all_of: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The sums, if they are many or all are wanted."""
        if all_of:
            self.count()
        if len(self.keys) <= (0 if all_of else HELD):
            return None
        out = self.keys, self.counts
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return out


SCHEMA = "key long, phrase string, n long"


def _rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.string()), pa.array(counts, pa.int64())], names=["key", "phrase", "n"])


def _text_rows(found: Counter) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["key", "phrase", "n"])
    found.clear()
    return out


def _counted(docs: DataFrame, lexicon, ranked, length: int) -> DataFrame:
    """key, phrase, n of all phrases of so many words that may be frequent: by key if all words have ids, else by language and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_by, pairs = lexicon.value, ranked.value if ranked else None
        tiles, whole, texts = Tiles(), Tiles(ranked=False), Counter()
        ids, size = [np.array([END])], 0

        def count() -> None:
            a = np.concatenate(ids)
            del ids[1:]
            both = np.flatnonzero((a[:-1] >= 0) & (a[1:] >= 0))
            if length == 2:
                tiles.add(a[both], a[both + 1])
                return
            keys = a[both] << BITS | a[both + 1]
            rank = pairs.of(keys)
            frequent = rank >= 0 if pairs.sieve is None else (rank >= 0) | passed(pairs.sieve, keys)
            both, keys, rank = both[frequent], keys[frequent], rank[frequent]
            two = np.flatnonzero(both[1:] == both[:-1] + 1)  # two frequent pairs in a row
            rank, keys, last = rank[two], keys[two], a[both[two] + 2]
            first = rank >= 0
            tiles.add(rank[first], last[first])
            whole.add(keys[~first], last[~first])

        def seen(lang: str, words: list[bytes], own: list[int]) -> None:
            """Counts phrases with a word beyond the ids."""
            head = f"{lang}\t".encode()
            starts = {k for at, i in enumerate(own) if i == MAYBE for k in range(max(0, at - length + 1), min(at, len(own) - length) + 1)}
            for k in starts:
                if all(i >= 0 or i == MAYBE for i in own[k : k + length]):
                    if pairs is not None and not all(
                        MAYBE not in own[j : j + 2] or pairs.texts is not None and passed(pairs.texts, np.array([crc32(head + b" ".join(words[j : j + 2]))]))[0] for j in (k, k + 1)
                    ):
                        continue
                    texts[head + b" ".join(words[k : k + length])] += 1

        def named(found: tuple[np.ndarray, np.ndarray], by_rank: bool) -> pa.RecordBatch:
            keys, counts = found
            if length > 2 and by_rank:
                keys = pairs.keys[keys >> BITS] << BITS | keys & (1 << BITS) - 1
            return _rows(keys, counts)

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lang = _lang(lang)
                words = words_of(value.as_py())
                own = list(map(words_by.of(lang).__getitem__, words))
                if words_by.sieve is not None and MAYBE in own:
                    seen(lang, words, own)
                ids += [np.array(own, np.int64), ids[0]]
                size += len(own)
                if size > BLOCK // 2:
                    count()
                    size = 0
                    for part, by_rank in ((tiles, True), (whole, False)):
                        if (found := part.taken()) is not None:
                            yield named(found, by_rank)
                if len(texts) > WORDS_HELD:
                    yield _text_rows(texts)
        count()
        for part, by_rank in ((tiles, True), (whole, False)):
            if (found := part.taken(True)) is not None:
                yield named(found, by_rank)
        if texts:
            yield _text_rows(texts)

    return docs.mapInArrow(run, SCHEMA).groupBy("key", "phrase").agg(F.sum("n").alias("n"))


# --- frequent phrases by ids


def _most_frequent(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent rows of a table with n, ``most`` at most, and the further ones, if there are any: all of one count are on one side.

    The border comes from a histogram: counts below 4096 as they are, larger ones by 64 steps a doubling.
    """
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(64 * F.log2(F.col("n") / 4096)))
    found = rows.groupBy(step.alias("step")).count().toArrow()  # some thousand rows
    steps, n = found.column("step").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(-steps)
    held = int(np.searchsorted(np.cumsum(n[order]), most, "right"))
    if held == len(order):
        return rows, None
    border = int(steps[order[held]])
    return rows.where(step > border), rows.where(step <= border)


def _vocabulary(frequent: DataFrame, most: int) -> tuple[pa.Table, DataFrame | None]:
    """The most frequent words, sorted so that a word's place is its id (by language and rank), and the further ones with higher ids."""
    top, further = _most_frequent(frequent, most)
    table = top.select("lang", "word", "n").toArrow().cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))
    table = table.sort_by([("lang", "ascending"), ("n", "descending"), ("word", "ascending")])
    return table, None if further is None else written(further.withColumn("id", F.monotonically_increasing_id() + (1 << BITS)), "further_words")


def _by_id(counts: DataFrame, lexicon, further: DataFrame | None, length: int) -> DataFrame:
    """i1, i2 ..., n: phrases by the ids of their words, of which those beyond the vocabulary have higher ones.

    Tasks look words of the vocabulary up; a further word is joined, and isn't frequent enough to be hot.
    """
    names = [f"i{k + 1}" for k in range(length)]
    shift = [BITS * (length - 1 - k) for k in range(length)]
    by_key = counts.where("key is not null").select(*(F.shiftright("key", s).bitwiseAND(F.lit((1 << BITS) - 1)).alias(name) for name, s in zip(names, shift, strict=True)), "n")
    if further is None:
        return by_key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, parts = [[] for _ in names], [], [[] for _ in names]
            for phrase in batch.column(0).to_pylist():
                lang, _, said = phrase.rpartition("\t")
                known, words = lexicon.value.of(lang), said.split(" ")
                langs.append(lang)
                for k, word in enumerate(words):
                    i = known[word.encode()]
                    ids[k].append(i if i >= 0 else None)
                    parts[k].append(word)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in ids), *(pa.array(x, pa.string()) for x in parts), pa.array(langs, pa.string()), batch.column(1)], names=[*names, *(f"w_{n}" for n in names), "lang", "n"])

    schema = ", ".join([*(f"{n} long" for n in names), *(f"w_{n} string" for n in names), "lang string", "n long"])
    rows = counts.where("phrase is not null").select("phrase", "n").mapInArrow(run, schema)
    for name in names:
        # A word that has its id gets a key of its own, with a tab, which no word holds.
        key = F.when(F.col(name).isNull(), F.col(f"w_{name}")).otherwise(F.concat(F.lit("\t"), F.xxhash64(*(f"w_{n}" for n in names)).cast("string")))
        own = further.select("lang", F.col("word").alias("_key"), F.col("id").alias("_id"))
        rows = rows.withColumn("_key", key).join(own, ["lang", "_key"], "left").withColumn(name, F.coalesce(name, "_id")).drop("_id", "_key")
    return by_key.unionByName(rows.select(*names, "n"))


def _with_words(rows: DataFrame, names: list[str], lexicon, further: DataFrame | None) -> DataFrame:
    """Adds lang, and for each column of ids the word (w_) and its count (n_): from the vocabulary in tasks, for further words by joins."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lexicon.value.table
        langs, words, n = (table.column(c).combine_chunks() for c in ("lang", "word", "n"))
        for batch in batches:
            at = [pc.if_else(pc.less(ids := batch.column(columns.index(name)), table.num_rows), ids, pa.scalar(None, pa.int64())) for name in names]
            more = [langs.take(at[0]), *(words.take(x) for x in at), *(n.take(x) for x in at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, "lang", *(f"w_{x}" for x in names), *(f"n_{x}" for x in names)])

    schema = ", ".join([*(f"{c} {kind}" for c, kind in rows.dtypes), "lang string", *(f"w_{x} string" for x in names), *(f"n_{x} long" for x in names)])
    if further is None:
        return rows.mapInArrow(run, schema)
    beyond = F.greatest(*names) >= 1 << BITS  # of a written table
    out = rows.where(beyond).mapInArrow(run, schema)
    for name in names:
        own = further.select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), F.col("word").alias("_word"), F.col("n").alias("_n"))
        # A word of the vocabulary gets a key of its own below 0.
        key = F.when(F.col(name) >= 1 << BITS, F.col(name)).otherwise(-1 - F.abs(F.xxhash64(*names)))
        out = out.withColumn("_id", key).join(own, "_id", "left")
        out = out.withColumns({f"w_{name}": F.coalesce(f"w_{name}", "_word"), f"n_{name}": F.coalesce(f"n_{name}", "_n"), "lang": F.coalesce("lang", "_lang")}).drop("_id", "_lang", "_word", "_n")
    return rows.where(~beyond).mapInArrow(run, schema).unionByName(out)


def _score(a: Column, left: Column, right: Column) -> Column:
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = LEAST, top: int = TOP, held_by: int = HELD_BY, vocabulary: int = VOCABULARY, pairs: int = PAIRS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two words, or two and three, of each language."""
    if longest not in (2, 3) or vocabulary > 1 << BITS:
        raise ValueError("phrases have two or three words, and ids 18 bits")
    broadcast = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    counts = written(word_counts(texts).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = counts.where("word is null").select("lang", F.col("n").alias("words"))
    table, further = _vocabulary(counts.where("word is not null"), vocabulary)
    lexicon = broadcast(Lexicon(table, None if further is None else sieve_of(F.crc32(F.concat_ws("\t", "lang", "word")), further)))

    counted = written(_counted(texts, lexicon, None, 2).where(F.col("n") >= least), "pairs")
    two = _by_id(counted, lexicon, further, 2)
    two = two if further is None else written(two, "pairs_by_id")
    rows = _with_words(two.withColumnRenamed("n", "a"), ["i1", "i2"], lexicon, further)
    rows = rows.select("i1", "i2", "lang", F.concat_ws(" ", "w_i1", "w_i2").alias("phrase"), "a", F.col("n_i1").alias("l"), F.col("n_i2").alias("r"))
    rows = rows.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    if longest == 3:
        best, beyond = _most_frequent(counted.where("key is not null"), pairs)
        by_text = None if further is None else sieve_of(F.crc32("phrase"), counted.where("phrase is not null"))
        best = best.select("key", "n").toArrow().sort_by([("n", "descending"), ("key", "ascending")])
        ranked = broadcast(Ranked(best.column("key").to_numpy(), None if beyond is None else sieve_of(F.col("key"), beyond), by_text))
        found = written(_counted(texts, lexicon, ranked, 3).where(F.col("n") >= least), "triples")
        three = written(_by_id(found, lexicon, further, 3).withColumnRenamed("n", "a"), "triples_by_id")
        # A pair may begin most triples: joins split hot pairs.
        three = written(spread_join(three, two.withColumnRenamed("n", "l2"), ["i1", "i2"]), "triples_left")
        three = written(spread_join(three, two.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("n").alias("r1")), ["i2", "i3"]), "triples_right")
        longer = three.select("i1", "i2", "a").unionAll(three.select(F.col("i2").alias("i1"), F.col("i3").alias("i2"), "a")).groupBy("i1", "i2").agg(F.max("a").alias("longer"))
        rows = rows.join(longer, ["i1", "i2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < held_by * F.col("a"))).drop("longer")
        three = _with_words(three, ["i1", "i2", "i3"], lexicon, further)
        one, other = _score(F.col("a"), F.col("n_i1"), F.col("r1")), _score(F.col("a"), F.col("l2"), F.col("n_i3"))
        three = three.withColumns({"s1": one, "s2": other}).withColumn("first", F.col("s1") <= F.col("s2"))
        pick = lambda x, y: F.when(F.col("first"), F.col(x)).otherwise(F.col(y))
        three = three.select("lang", F.concat_ws(" ", "w_i1", "w_i2", "w_i3").alias("phrase"), "a", pick("n_i1", "l2").alias("l"), pick("r1", "n_i3").alias("r"), pick("s1", "s2").alias("score"))
        rows = rows.drop("i1", "i2").unionByName(three)
    return _best(rows, totals, top)


def _best(rows: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language by score, count and text; sought in groups first, so no task orders all phrases of a language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)))
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("_place", place("lang", "_group")).where(F.col("_place") <= top)
    rows = rows.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


#: DuckDB SQL for the same rows.
ORACLE = rf"""WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY ALL),
f AS (SELECT lang, array_to_string(w[i + 1:i + k], ' ') AS phrase, k, count(*) AS c FROM words, range(1, 4) AS r(k), unnest(range(len(w) - k + 1)) AS t(i) GROUP BY ALL),
cand AS (SELECT lang, phrase, k, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= {LEAST}),
cuts AS (SELECT c.lang, c.phrase, c.k, a, cut, l.c AS l, r.c AS r, ({SCALE}::HUGEINT * a * a) // (l.c::HUGEINT * r.c) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM cand WHERE k = 3) GROUP BY ALL),
left_over AS (SELECT s.* FROM lowest s LEFT JOIN longer g ON s.k = 2 AND g.lang = s.lang AND g.part = s.phrase WHERE longer IS NULL OR 100 * longer < {HELD_BY} * a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM placed JOIN totals USING (lang) WHERE rank <= {TOP}"""
