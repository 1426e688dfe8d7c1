"""Near-duplicate groups: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Every document's set of distinct shingles (of ``width`` words) is hashed to 64 bits (word hashes are multilinear, so two words
   collide with probability below 2**-56).  Documents of one set form a class; a class is one node, whatever the ids of its rows.
2. Nodes get 128 MinHash values; 25 bands of 5 name the candidates (a pair of similarity 0.8 shares no band
   with probability 5e-5, of 0.85 with 4e-7).
3. Candidates in a band's bucket are first compared with the bucket's least and greatest node only, so a bucket of n
   gives 2n pairs at most.  Signatures are compared batch by batch: after each, a pair is dropped once the posterior
   probability of a similarity of at least the threshold falls below ``MISS``.  Survivors are confirmed on full sets: the
   partners of one node stream past a single copy of its text, and a node with many partners is cut in parts.
4. What the confirmed links leave apart within a bucket is then compared across those components, in pairs of bounded
   blocks: signatures first, batch by batch, then full sets.  A block pair gives out nothing but links, and pairs within a component
   need no comparison.  So no candidate pair of different components is left unexamined.

Rows are told apart by id and text, so a doc_id under which several texts occur is as many documents: each is linked by its own
text, and a component's id is the least doc_id among its rows.

Cases: a null, empty or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle has all its
words as its only one.  Rows that repeat a doc_id with the same text share its fate.  A null doc_id links like others but is never the
least: a component without any other id has a null one, and its rows count as kept.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panemill.llm.common import discard, spread_join, written
from panemill.llm.components import connected_components

BANDS, ROWS = 25, 5
HASHES = 128
BATCH = 32
#: A pair is pruned when its posterior chance of reaching the threshold is below this.
MISS = 1e-6
#: Words of a shingle unless told otherwise.
SHINGLE = 5
#: Members of a block in the comparison across components, about; partners of a node that meet one copy of its text, about.
BLOCK, PARTNERS = 300, 500

_random = np.random.Generator(np.random.PCG64(20240613))
_MULTIPLIERS = (_random.integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_PAIR = (_random.integers(0, 2**63, 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _coefficients(n: int) -> np.ndarray:
    """The first n of one fixed sequence of random 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, n, dtype=np.uint64)


_coefficient_table = _coefficients(4096)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    global _coefficient_table
    raw = [(text or "").encode().lower() for text in texts]  # lowers A-Z only
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in raw]
    filled = np.flatnonzero(~blank)
    word = np.cumsum(np.isin(filled, starts, assume_unique=True)) - 1
    place = filled - starts[word]
    if (most := int(place.max()) + 1) > len(_coefficient_table):
        _coefficient_table = _coefficients(most)
    values = (data[filled].astype(np.uint64) + np.uint64(1)) * _coefficient_table[place]
    hashes = _mixed(np.add.reduceat(values, np.searchsorted(filled, starts)))
    bounds = np.searchsorted(starts, first)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = hashes[lo:hi]
        if hi == lo:
            out.append(own)
            continue
        n = max(1, hi - lo - width + 1)
        mixed = np.full(n, np.uint64(min(width, hi - lo)), np.uint64)
        for k in range(min(width, hi - lo)):
            mixed = _mixed(mixed * _PAIR[k % len(_PAIR)] + own[k : k + n])
        out.append(np.unique(mixed))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for k in range(0, len(shingles), 1024):
        part = (shingles[k : k + 1024, None] * _MULTIPLIERS[None, :]).min(axis=0)
        least = np.minimum(least, (part >> np.uint64(32)).astype(np.uint32))
    return least


def posterior_floor(n: int, threshold: float, miss: float) -> int:
    """Fewest agreements among n hashes that keep P(similarity >= threshold) at ``miss`` or more, under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1); its tail above t is the chance of at most m successes in n + 1 trials.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _prepared(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, row key (two longs of id and text), n_shingles, class digest (two longs), signature, one row for each of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            texts, at = batch.column(3), 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < 2_000_000:
                    size += len(texts[stop].as_py() or "")
                    stop += 1
                rows = []
                for shingles in shingle_sets(texts.slice(at, stop - at).to_pylist(), width):
                    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                    if (found := seen.get(digest)) is None:
                        low = signature(shingles) if len(shingles) else np.zeros(HASHES, np.uint32)
                        longs = [int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8)]
                        found = (len(shingles), *longs, low.astype(">u4").tobytes())
                        if len(seen) < 20_000:
                            seen[digest] = found
                    rows.append(found)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, stop - at) for c in range(3)), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())],
                    names=["id", *KEY, "n_shingles", *CLASS, "sig"],
                )
                at = stop

    schema = f"id {kind}, r1 long, r2 long, n_shingles long, c1 long, c2 long, sig binary"
    return _keyed(docs, id_col, text_col).select("id", *KEY, "text").mapInArrow(run, schema)


#: The key of a row: 128 bits of its id and text.  The key of a class: 128 bits of its set.
KEY, CLASS = ["r1", "r2"], ["c1", "c2"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with id, text and row key beside their own columns, which are left out but for these."""
    i, t = docs[id_col], docs[text_col]
    return docs.select(i.alias("id"), t.alias("text"), *_row_key(i, t))


def _row_key(i, t) -> list:
    return [F.xxhash64(i, F.lit(0), t).alias("r1"), F.xxhash64(F.lit(1), t, F.lit(2), i).alias("r2")]


def _nodes(prepared: DataFrame) -> DataFrame:
    """A row for each class with shingles: node (a number), class key, least id, row key of a member, its signature."""
    filled = prepared.where("n_shingles > 0")
    classes = filled.groupBy(*CLASS).agg(F.min("id").alias("least"), F.min("r1").alias("r1"))
    found = written(filled.select(*CLASS, *KEY, "sig").join(classes, [*CLASS, "r1"]), "classes")
    if found.count() > classes.count():  # rows that repeat an id and a text
        found = found.dropDuplicates(CLASS)
    return written(found.select(F.monotonically_increasing_id().alias("node"), *CLASS, *KEY, "least", "sig"), "nodes")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that no batch of their signatures rules out."""
    floors = _floors(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(-1, HASHES) for c in ("sa", "sb"))
            alive, agreed = np.arange(len(left)), np.zeros(len(left), np.int64)
            for n, floor in floors:
                agreed[alive] += (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1)
                alive = alive[agreed[alive] >= floor]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    sides = [nodes.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}")) for c in ("a", "b")]
    paired = spread_join(pairs, sides[0], ["a"]).join(sides[1].hint("merge"), "b")
    return paired.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _floors(threshold: float) -> list[tuple[int, int]]:
    return [(n, posterior_floor(n, threshold, MISS)) for n in range(BATCH, HASHES + 1, BATCH)]


def _texts(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, text of some nodes, written.  The nodes make the hash table, so whole texts are dealt once and never sorted."""
    found = written(_keyed(docs, id_col, text_col).join(nodes.select("node", *KEY).hint("shuffle_hash"), KEY).select("node", "text"), "texts")
    if found.count() > nodes.count():  # rows that repeat an id and a text
        found, all_rows = written(found.dropDuplicates(["node"]), "texts"), found
        discard(all_rows)
    return found


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, written; the texts that it needed are deleted.

    All partners of a node follow its own text in one sorted run, at most about ``PARTNERS`` of them, so a node's text is neither copied for each
    partner nor are its partners gathered: a task holds one node's set and a few texts.
    """
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [], []
                sets = shingle_sets(part.column("text").to_pylist(), width)
                for a, salt, b, shingles in zip(*(part.column(c).to_pylist() for c in ("a", "salt", "b")), sets, strict=True):
                    if b is None:
                        held, own = (a, salt), shingles
                    elif held != (a, salt):
                        raise ValueError("a node without its text")
                    elif _linked(own, shingles, percent):
                        found[0].append(a)
                        found[1].append(b)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(written(nodes.join(ids, "node", "left_semi").select("node", *KEY), "wanted"), docs, id_col, text_col)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("long").alias("salts"))
    salts = written(salts, "salts")
    dealt = spread_join(pairs, salts, ["a"]).select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b")
    partners = dealt.join(texts.withColumnRenamed("node", "b").hint("merge"), "b").select("a", "salt", "b", "text")
    own = salts.join(texts.withColumnRenamed("node", "a").hint("merge"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    run_of = own.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    found = written(run_of.select("a", "salt", "b", "text").mapInArrow(run, "a long, b long"), "links")
    discard(texts)
    return found


def _buckets(nodes: DataFrame) -> DataFrame:
    """A row (key, node, least and greatest node) for each band of a node that others share."""
    hashes = F.array(*(F.xxhash64(F.lit(k), F.substring("sig", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)))
    rows = nodes.select("node", F.explode(hashes).alias("key"))
    ends = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi")
    ends = written(ends, "ends")
    shared = written(rows.join(ends.select("key").hint("shuffle_hash"), "key", "left_semi"), "shared")
    return written(spread_join(shared, ends, ["key"]), "buckets")


def _crossing(stars: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int) -> DataFrame:
    """Links (a, b) between members of different components of each star (star, node, component), written.

    A star's most frequent component is M, the rest is F; pairs within M need no look.  Members are dealt to blocks of
    about ``BLOCK``, and each pair of blocks (F with F, F with M) is one group: a task holds two blocks, prunes their pairs by
    signature batches, counts common shingles of the survivors by an inverted index, and gives out nothing but links.
    """
    percent, floors = round(threshold * 100), _floors(threshold)
    counts = stars.groupBy("star", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("star").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("nm"), F.sum("n").alias("n"))
    main = written(main.select("star", "main", F.ceil(F.col("nm") / BLOCK).alias("bm"), F.ceil((F.col("n") - F.col("nm")) / BLOCK).alias("bf")).where("bf > 0"), "main")
    rest = F.col("component") != F.col("main")
    block = F.when(rest, F.pmod(F.xxhash64("node"), "bf")).otherwise(F.col("bf") + F.pmod(F.xxhash64("node"), "bm"))
    with_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("block"), F.col("bf") - 1)), lambda k: F.struct(k.alias("x"), F.col("block").alias("y")))
    with_later = F.when(rest & (F.col("block") + 1 < F.col("bf") + F.col("bm")), F.transform(F.sequence(F.col("block") + 1, F.col("bf") + F.col("bm") - 1), lambda k: F.struct(F.col("block").alias("x"), k.alias("y"))))
    rows = spread_join(stars, main, ["star"]).withColumn("block", block)
    rows = rows.withColumn("pair", F.explode(F.concat(with_rest, F.coalesce(with_later, F.array().cast("array<struct<x:bigint,y:bigint>>")))))
    rows = rows.select("star", "pair.x", "pair.y", "block", "node", "component")
    wanted = written(nodes.join(stars.select("node").distinct(), "node", "left_semi").select("node", *KEY), "wanted")
    whole = _texts(wanted, docs, id_col, text_col)
    texts = whole.join(nodes.select("node", "sig"), "node")

    def links(table: pa.Table) -> pa.Table:
        ids, components = np.array(table.column("node").to_pylist()), np.array(table.column("component").to_pylist())
        low = np.frombuffer(b"".join(table.column("sig").to_pylist()), ">u4").reshape(-1, HASHES).astype(np.uint32)
        left = table.column("x")[0].as_py() == np.array(table.column("block").to_pylist())
        same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        right, found = np.flatnonzero(left if same else ~left), []
        alive: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(left).tolist():
            others = right[(components[right] != components[k]) & ((ids[right] > ids[k]) | (not same))]
            agreed = np.zeros(len(others), np.int64)
            for n, floor in floors:
                agreed += (low[others, n - BATCH : n] == low[k, n - BATCH : n]).sum(axis=1)
                others, agreed = others[agreed >= floor], agreed[agreed >= floor]
            if len(others):
                alive[k] = others
        if alive:
            used = np.unique(np.concatenate([np.array(list(alive)), *alive.values()]))
            texts = table.column("text")
            sets = {}
            for at in range(0, len(used), 200):
                some = used[at : at + 200].tolist()
                sets.update(zip(some, shingle_sets([texts[j].as_py() for j in some], width), strict=True))
            held = np.concatenate([sets[j] for j in used.tolist()])
            owner = np.repeat(used, [len(sets[j]) for j in used.tolist()])
            sizes = np.zeros(len(ids), np.int64)
            sizes[used] = [len(sets[j]) for j in used.tolist()]
            order = np.argsort(held, kind="stable")
            held, owner = held[order], owner[order]
            for k, others in alive.items():
                lo, hi = np.searchsorted(held, sets[k]), np.searchsorted(held, sets[k], "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(ids))[others]
                linked = others[(100 * common >= percent * (sizes[k] + sizes[others] - common)) & (common > 0)]
                found += [(min(int(ids[k]), j), max(int(ids[k]), j)) for j in ids[linked].tolist()]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = written(rows.join(texts.hint("merge"), "node").groupBy("star", "x", "y").applyInArrow(links, "a long, b long").distinct(), "links")
    discard(whole)
    return found


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between the components that nodes have been given so far."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"p{c}"))
    moved = written(spread_join(edges, at("a"), ["a"], "left"), "contracted")
    return spread_join(moved, at("b"), ["b"], "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))


def _grouped(docs: DataFrame, threshold: float, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, row key, n_shingles, group (a number; null without shingles), component_id, a row for each of docs; written."""
    prepared = written(_prepared(docs, id_col, text_col, width), "prepared")
    nodes = _nodes(prepared)
    shared = _buckets(nodes)

    ends = F.explode(F.array(F.struct(F.col("lo").alias("end")), F.struct(F.col("hi").alias("end"))))
    near = shared.select("node", ends.alias("e")).where("node != e.end").select(F.least("node", "e.end").alias("a"), F.greatest("node", "e.end").alias("b")).distinct()
    likely = written(_likely(written(near, "near"), nodes, threshold), "likely")
    first = _confirmed(likely, nodes, docs, id_col, text_col, threshold, width)
    labels = connected_components(first).withColumnRenamed("id", "node")

    # Buckets that still hold several components: compare across them.
    placed = written(shared.where("node != lo").join(labels, "node", "left").select("key", F.col("lo").alias("star"), "node", F.coalesce("component", "node").alias("component")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("key")
    stars = written(spread_join(placed, written(mixed, "mixed"), ["key"]).select("star", "node", "component").distinct(), "stars")
    grouped = written(nodes.select("node", *CLASS, "least").join(labels, "node", "left").select(*CLASS, "least", F.coalesce("component", "node").alias("group")), "groups")
    if not stars.isEmpty():
        second = _crossing(stars, nodes, docs, id_col, text_col, threshold, width)
        upper = connected_components(_contracted(second, labels)).select(F.col("id").alias("group"), "component")
        grouped = written(spread_join(grouped, upper, ["group"], "left").withColumn("group", F.coalesce("component", "group")).drop("component"), "groups")
    top = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    of_class = spread_join(grouped.select(*CLASS, "group"), top, ["group"])
    out = spread_join(prepared.drop("sig"), of_class, CLASS, "left")
    return out.select("id", *KEY, "n_shingles", "group", F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """id, n_shingles, component_id (least id reachable over links), kept (the id is the component's)."""
    rows = _grouped(docs, threshold, id_col, text_col, width)
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """One document of each group, all columns: a row of its least id, null ids last.  Rows without shingles are in no group and all stay.

    Where the least id has several texts of the group, or a row is repeated, one row stays.
    """
    rows = written(_grouped(docs, threshold, id_col, text_col, width), "grouped")
    # Two steps of plain minima (id, then row key): sums of small states on either side of the shuffle, no sorting.
    least = rows.where("group is not null").groupBy("group").agg(F.min("id").alias("least"))
    least = written(least, "least")
    first = spread_join(rows.where("group is not null"), least, ["group"]).where(F.col("id").eqNullSafe(F.col("least")))
    keys = first.groupBy("group").agg(F.min("r1").alias("r1"))
    chosen = first.join(keys, ["group", "r1"]).groupBy(*KEY).agg(F.count("*").alias("repeats"))
    chosen = chosen.unionByName(rows.where("group is null").select(*KEY).distinct().withColumn("repeats", F.lit(0).cast("long")))
    named = docs.select(F.struct(*docs.columns).alias("row"), *_row_key(docs[id_col], docs[text_col]))
    chosen = written(chosen, "chosen")
    kept = named.join(chosen.hint("shuffle_hash"), KEY)
    if chosen.where("repeats > 1").isEmpty():
        return kept.select("row.*")
    kept = written(kept, "kept")
    once = kept.where("repeats > 1").groupBy(*KEY).agg(F.first("row").alias("row"))
    return kept.where("repeats < 2").select("row").unionByName(once.select("row")).select("row.*")
