"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of residuals are trained on a bounded sample (``SAMPLE``); the number of lists grows with the root of the table, up to
one for every ``PER_LIST`` vectors of the sample.  Every vector is assigned to its nearest centroid and its residual coded, a byte
for each sub-space.  Equal vectors are one entry that names the least ids it stands for, so a vector that a third of all rows share costs one entry.

How many lists a query visits is measured: sampled queries are answered exactly from the sample, and the least number is taken that finds the wanted share
(``recall``) of their neighbours; on clustered vectors these are few lists, on shapeless ones most.  In the whole table neighbours are nearer than in the
sample, so the measure errs to the safe side.  ``recall=1`` visits every list and is exact.

In each block of a list the distance tables of a visited list add up to the asymmetric distances of all entries.  An entry's true distance differs
from the asymmetric one by the length of what its code leaves out at most.  Exact distances, in double precision, of the best
few bound the (k + 1)-th best of the block; every entry that this bound doesn't rule out is compared exactly as well.  A block
gives out its k + 1 nearest ids, so nothing in a visited list is lost: only lists that aren't visited cost recall.

Lists are cut in blocks of bounded size by a hash, so no task holds a whole list.  A block meets the queries of its list in
chunks of bounded size.

Cases: vectors that are null, empty, all zero, of another length than most, or with null or non-finite components take no part (vectors of several lengths
have no distance between them); ties go to the smaller id; fewer candidates than k give fewer rows; an id with several vectors is one candidate, by
its nearest, and as a query is answered once for each of them, by the nearest of all; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panemill.llm.common import least_hashes, written

#: Vectors to train on at most, those for each list at least, and codes of a sub-space.
SAMPLE, PER_LIST, CODES = 40_000, 8, 256
#: Vectors of the sample that the codebooks are trained on at most.
CODED = 16_000
#: Share of neighbours that the visited lists should hold, by measure on the sample, queries of that measure, and lists to visit at least.
RECALL, MEASURED, LEAST = 0.95, 400, 16
#: Entries of a block whose exact distances give a query its first bound.  Any number gives the same rows.
FIRST = 40
#: What rounding may do to distances in which large terms cancel, as a share of the lengths involved.
SLACK = 1e-6
#: Entries of a block of a list, and queries of a chunk, about.
BLOCK, CHUNK = 4096, 8192


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Row by row the number of the nearest centre."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[k : k + 4096] @ centres.T, axis=1) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 12) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(turns):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        full = count > 0
        starts = np.concatenate(([0], np.cumsum(count[full])[:-1]))
        centres[full] = np.add.reduceat(x[np.argsort(own, kind="stable")], starts, axis=0) / count[full, None]
        if (~full).any():
            centres[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return centres


def train(x: np.ndarray, rows: int, k: int = 10, recall: float = RECALL) -> dict:
    """Coarse centroids, codebooks (sub-space, code, component), and the number of lists to visit, for a table of so many rows."""
    rng = np.random.Generator(np.random.PCG64(11))
    lists = int(np.clip(round(np.sqrt(rows)), 1, max(1, len(x) // PER_LIST)))
    centres = k_means(x, lists, rng)
    own = _nearest(x, centres)
    parts = max(p for p in range(1, 17) if x.shape[1] % p == 0)
    rest = (x - centres[own])[:CODED]
    books = [k_means(part, min(CODES, len(rest)), rng, 8) for part in np.split(rest, parts, axis=1)]
    return {"centres": centres, "books": books, "visited": visited_for(x, own, centres, k, recall)}


def visited_for(x: np.ndarray, own: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The least number of nearest lists that holds the wanted share of the k nearest others of sampled vectors."""
    asked = np.arange(0, len(x), max(1, len(x) // MEASURED))
    if recall >= 1 or len(x) <= k:
        return len(centres)
    half, squares, places = (centres**2).sum(axis=1) / 2, (x**2).sum(axis=1) / 2, []
    for q in asked.tolist():
        far = squares - x @ x[q]
        far[q] = np.inf
        near = np.argpartition(far, k)[:k]
        to = half - centres @ x[q]
        places.append((to[None, :] < to[own[near]][:, None]).sum(axis=1))  # lists nearer than the neighbour's own
    places = np.sort(np.concatenate(places))
    return int(min(len(centres), max(LEAST, places[min(len(places) - 1, int(np.ceil(recall * len(places))))] + 1)))


def encode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    own = _nearest(x, model["centres"])
    rest = x - model["centres"][own]
    codes = [_nearest(part, book) for part, book in zip(np.split(rest, len(model["books"]), axis=1), model["books"], strict=True)]
    return own, np.stack(codes, axis=1).astype(np.uint8)


def _exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of q from rows, summed from the first component to the last."""
    return np.sqrt(np.cumsum((v - q) ** 2, axis=-1)[..., -1])


def nearest_in_block(queries: np.ndarray, v: np.ndarray, codes: np.ndarray, ids: list[list[int]], centre: np.ndarray, books: list[np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the query, id, exact distance) of the n nearest ids (ties: least id) of a block of one list, for all queries."""
    first_id = np.array([own[0] for own in ids], np.int64)
    order = np.argsort(first_id, kind="stable")
    v, codes, ids, first_id = v[order], codes[order], [ids[k] for k in order.tolist()], first_id[order]
    # The n nearest entries hold the n nearest ids, if no id has two entries; else as many as reach n different first ids.
    repeated = len(first_id) > 1 and bool((first_id[1:] == first_id[:-1]).any())
    several = repeated or any(len(own) > 1 for own in ids)
    decoded = centre + np.concatenate([book[codes[:, j]] for j, book in enumerate(books)], axis=1)
    left_out = np.sqrt(((v - decoded) ** 2).sum(axis=1))
    squares, longest, far = (v**2).sum(axis=1), np.sqrt((v**2).sum(axis=1).max()), np.sqrt(centre @ centre)
    few = min(len(v), max(FIRST, 2 * n))
    for at in range(0, len(queries), 64):
        part = queries[at : at + 64]
        squared = np.zeros((len(part), len(v)))
        for j, (book, rest) in enumerate(zip(books, np.split(part - centre, len(books), axis=1), strict=True)):
            squared += ((rest**2).sum(axis=1)[:, None] - 2 * rest @ book.T + (book**2).sum(axis=1))[:, codes[:, j]]
        guesses = np.sqrt(np.maximum(squared, 0))
        own = (part**2).sum(axis=1)
        score = np.full(guesses.shape, np.inf)
        rows = np.arange(len(part))[:, None]
        first = np.argpartition(guesses, few - 1, axis=1)[:, :few] if few < len(v) else np.broadcast_to(np.arange(len(v)), (len(part), len(v)))
        score[rows, first] = _exact(v[first], part[:, None, :])
        if few < len(v):
            bound = _bound(score, first, first_id, n, repeated) + SLACK * (np.sqrt(own) + longest + far)
            open_ = ~(guesses - left_out > bound[:, None])  # what isn't a number stays
            open_ &= ~(np.sqrt(np.maximum(squares - 2 * (part @ v.T) + own[:, None], 0)) > bound[:, None])
            open_[rows, first] = False
            q, e = np.nonzero(open_)
            score[q, e] = _exact(v[e], part[q])
        bound = _bound(score, first, first_id, n, repeated)
        q, e = np.nonzero((score <= bound[:, None]) & np.isfinite(score))  # entries by first id
        found, name = score[q, e], first_id[e]
        if several:
            sizes = [len(ids[k]) for k in e.tolist()]
            q, found, name = np.repeat(q, sizes), np.repeat(found, sizes), np.array([i for k in e.tolist() for i in ids[k]], np.int64)
            order = np.lexsort((found, name, q))
            q, found, name = q[order], found[order], name[order]
            fresh = np.ones(len(q), bool)
            fresh[1:] = (q[1:] != q[:-1]) | (name[1:] != name[:-1])
            q, found, name = q[fresh], found[fresh], name[fresh]
        order = np.lexsort((name, found, q))
        q, found, name = q[order], found[order], name[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        yield q[place < n] + at, name[place < n], found[place < n]


def _bound(score: np.ndarray, first: np.ndarray, first_id: np.ndarray, n: int, repeated: bool) -> np.ndarray:
    """For each query a distance within which n different ids lie, or infinity."""
    if not repeated:
        return np.partition(score, n - 1, axis=1)[:, n - 1] if score.shape[1] >= n else np.full(len(score), np.inf)
    starts = np.flatnonzero(np.concatenate(([True], first_id[1:] != first_id[:-1])))
    least = np.minimum.reduceat(score, starts, axis=1)
    return np.partition(least, n - 1, axis=1)[:, n - 1] if least.shape[1] >= n else np.full(len(score), np.inf)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles): the rows that take part."""
    v = rows[vector_col].cast("array<double>")
    x = rows.select(rows[id_col].cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return x.where(fine)


def search(rows: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): for each row whose id is divisible by ``every``, its k nearest others."""
    spark = rows.sparkSession
    x = usable(rows, id_col, vector_col)
    sizes = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = sizes["n"] if sizes else 0
    x = x.where(F.size("v") == width)
    sample = np.array([r["v"] for r in least_hashes(x, F.xxhash64("id"), SAMPLE, sizes["count"] if sizes else 0, "id").select("v").toArrow().to_pylist()], float).reshape(-1, max(1, width))
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast(train(sample, sizes["count"], k, recall))  # bounded by the sample's size

    # One entry for each distinct vector, with the least k + 1 ids it stands for (two steps: a hot vector is first reduced within salts).
    salted = W.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    least = x.select("id", "v").distinct().withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    entries = least.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))  # 64 * (k + 1) ids at most

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.array(batch.column(0).to_pylist(), float)
                own, codes = encode(x, model.value)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["raw", "ids", "list", "codes"])

    entries = written(entries.mapInArrow(coded, "raw binary, ids array<bigint>, list int, codes binary"), "entries")
    blocks = written(entries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")  # a row for each list
    held = entries.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("raw"), "blocks")).select("list", "block", "ids", "codes", "raw")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, n = model.value["centres"], model.value["visited"]
        half = (centres**2).sum(axis=1) / 2
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), float).reshape(-1, centres.shape[1])
            near = np.argpartition(half - v @ centres.T, n - 1, axis=1)[:, :n] if len(v) else np.zeros((0, n), np.int64)
            at = pa.array(np.repeat(np.arange(len(v)), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([r.tobytes() for r in v], pa.binary()).take(at), pa.array(near.ravel(), pa.int32())], names=["query", "q", "list"])

    queries = written(x.where(F.col("id") % every == 0).distinct(), "queries")
    probes = queries.mapInArrow(visits, "query long, q binary, list int")
    chunked = probes.join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    chunks = max(1, -(-queries.count() // CHUNK))
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks).cast("long"))).select("list", "block", "chunk", "query", "q")
    meet = held.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).select(F.col("list").alias("l"), F.col("block").alias("b"), F.col("chunk").alias("c"), "ids", "codes", "raw")

    def scan(asked: pa.Table, stored: pa.Table) -> pa.Table:
        found = [], [], []
        if len(asked) and len(stored):
            codes = np.frombuffer(b"".join(stored.column("codes").to_pylist()), np.uint8).reshape(len(stored), -1)
            v = np.frombuffer(b"".join(stored.column("raw").to_pylist()), float).reshape(len(stored), -1)
            q = np.frombuffer(b"".join(asked.column("q").to_pylist()), float).reshape(len(asked), -1)
            centre, names = model.value["centres"][asked.column("list")[0].as_py()], np.array(asked.column("query").to_pylist(), np.int64)
            for number, name, score in nearest_in_block(q, v, codes, stored.column("ids").to_pylist(), centre, model.value["books"], k + 1):
                for column, values in zip(found, (names[number], name, score), strict=True):
                    column.append(values)
        kinds = (np.int64, np.int64, float)
        return pa.table({c: np.concatenate([np.zeros(0, kind), *values]) for c, kind, values in zip(("query", "vec_id", "score"), kinds, found, strict=True)})

    scored = chunked.groupBy("list", "block", "chunk").cogroup(meet.groupBy("l", "b", "c")).applyInArrow(scan, "query long, vec_id long, score double")
    near = scored.where("vec_id != query").groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
