"""Mixing sources to target weights by weighted fair queueing.

Sources weigh by their place in code-point order (null last); their targets fill the total size by weight, none beyond
``most`` times its source.  Each source sends its documents in a shuffled order, up to ``most`` times over; a document's
virtual finish time is the words its source has sent by its end, divided by the source's weight.  All copies, range-sorted by
finish time, are taken as long as their running sum stays within the total budget, which levels every source at its target.

Running sums never put a source in one task: repeated rows are counted into one first, a source's shuffled order is cut in buckets by the
leading digits of the shuffle key, so that a bucket holds a bounded number of rows that differ, and offsets of buckets are summed on two levels.  The
global order is cut by range partitions in the same way, and only the partition in which the budget ends is looked at row by row.
Only ``targets`` orders all sources, a row each, in one task.

Cases: a null text has size 0; a null source is a source; documents without words are carried along with no words
taken; repeated rows are separate rows; null doc_ids share a place in the shuffled order, and rows of one id follow one another in it; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panemill.llm.common import WORD, discard, maybe_broadcast, spread_join, written

#: Rows of a bucket of a source, about.
BUCKET = 1000
#: Equal rows that one task writes out at most before they are dealt anew.
RUN = 10_000
#: Sources that may be broadcast at most; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """From a row (source, source_size) per source: src (its rank), weight and target.

    Water filling: sources in order of cap / weight; up to some source all reach their cap, the others share the rest by weight.
    """
    ranked = sizes.withColumn("src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("src") % len(weights) + F.when(F.col("src") % len(weights) == 0, len(weights)).otherwise(0)))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), "src")
    ranked = (
        ranked.withColumn("place", F.row_number().over(order))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("rest").cast("double"))
    )
    level = F.min_by(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level")), F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("place"))).over(W.partitionBy())
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * level), F.col("cap").cast("double"))
    return ranked.select("source", "source_size", "src", "weight", "total", target.alias("target"))


def _placed(docs: DataFrame, weights: Sequence[int], most: int, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, k1, k2 (row key), size, source_size, target, copies (times the row is taken), a row for each of docs."""
    i, t, s = docs[id_col], docs[text_col], docs[source_col]
    rows = docs.select(i.alias("id"), s.alias("source"), words(t).alias("size"), *_row_key(i, s, t))
    sized = written(rows.groupBy("source", "id", "size", "k1", "k2").agg(F.count("*").alias("m")), "sized")
    digits = max(1, math.ceil(math.log(max(1, sized.count() / BUCKET), 16)))
    sources = written(targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, most), "sources")
    rows = sized.join(maybe_broadcast(sources.drop("total"), BROADCAST_SOURCES).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    rows = rows.withColumn("key", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f":{seed}"))))
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, digits), 16, 10).cast("long"))

    # Words of a source before each bucket, by two levels of sums.
    sums = rows.groupBy("src", "bucket").agg(F.sum(F.col("size") * F.col("m")).alias("sum")).withColumn("upper", F.floor(F.col("bucket") / 16 ** (digits // 2)))
    earlier = lambda order, *keys: F.coalesce(F.sum("sum").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    uppers = sums.groupBy("src", "upper").agg(F.sum("sum").alias("sum")).select("src", "upper", earlier("upper", "src").alias("above"))
    offsets = sums.withColumn("offset", earlier("bucket", "src", "upper")).join(uppers, ["src", "upper"]).select("src", "bucket", (F.col("offset") + F.col("above")).alias("offset"))

    inside = W.partitionBy("src", "bucket").orderBy("key", "id", "size", "k1", "k2").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    placed = rows.withColumn("place", before(F.col("m"))).withColumn("end", before(F.col("size") * F.col("m")))
    placed = placed.join(offsets, ["src", "bucket"]).withColumn("end", F.col("end") + F.col("offset")).drop("key", "offset")
    placed = _expanded(written(placed, "placed"))

    # Every copy by virtual finish time; the order breaks all ties.
    order = ["finish", "src", "bucket", "place", "epoch"]
    finish = (F.col("epoch") * F.col("source_size") + F.col("end")).cast("double") / F.col("weight").cast("double")
    lane = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", finish).select(*order, "size")
    lane = written(lane.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "lane")
    budget = (sources.agg(F.max("total")).first() or [0])[0] or 0
    cut = None
    for part, total in sorted(map(tuple, lane.groupBy("part").agg(F.sum("size")).collect())):  # a row for each partition
        if total <= budget:
            budget -= total
            continue
        running = F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
        cut = lane.where(F.col("part") == part).withColumn("running", running).where(F.col("running") > budget).orderBy(*order).first()
        break
    discard(lane)
    copies = F.lit(0)
    for epoch in range(most):
        copy = placed.source_size * epoch + placed.end
        at = F.struct((copy.cast("double") / placed.weight.cast("double")).alias("finish"), "src", "bucket", "place", F.lit(epoch).alias("epoch"))
        copies = copies + (F.lit(1) if cut is None else (at < F.struct(*(F.lit(cut[c]).cast(lane.schema[c].dataType).alias(c) for c in order))).cast("int"))
    return placed.withColumn("copies", copies)


def _row_key(*columns: Column) -> list[Column]:
    """128 bits of a row's id, source and text; nulls differ from all values."""
    filled = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    marks = [c.isNull() for c in columns]
    return [F.xxhash64(*marks, *filled).alias("k1"), F.xxhash64(F.lit(1), *filled, *marks).alias("k2")]


def _expanded(groups: DataFrame) -> DataFrame:
    """A row for each of the m equal rows of a group, in order; groups of many are cut and dealt anew first."""
    most = groups.agg(F.max("m")).first()[0] or 1
    low = F.lit(0).cast("long")
    if most > RUN:
        groups = groups.withColumn("low", F.explode(F.sequence(low, F.col("m") - 1, F.lit(RUN).cast("long")))).repartition("src", "bucket", "place", "low")
        low = F.col("low")
    rows = groups.withColumn("j", F.explode(F.sequence(low, F.least(low + RUN, F.col("m")) - 1)))
    rows = rows.withColumn("end", F.col("end") + (F.col("j") + 1) * F.col("size")).withColumn("place", F.col("place") + F.col("j") + 1)
    return written(rows.drop("j", "low", "m"), "expanded") if most > 1 else rows.drop("j", "low", "m")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken (words), copies (times the document is taken), a row for each of docs."""
    out = _placed(docs, weights, most, seed, id_col, text_col, source_col)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each row as often as the mix takes it.  Of rows of one id, source and text some may be taken once more than others."""
    key = ["k1", "k2"]
    placed = _placed(docs, weights, most, seed, id_col, text_col, source_col)
    groups = placed.groupBy(*key).agg(F.count("*").alias("count"), F.sum("copies").alias("total"))
    groups = written(groups.select(*key, "count", F.floor(F.col("total") / F.col("count")).alias("copies"), (F.col("total") % F.col("count")).alias("extra")), "copies")
    named = docs.select(F.struct(*docs.columns).alias("row"), *_row_key(docs[id_col], docs[source_col], docs[text_col]))
    found = spread_join(named, groups.drop("count"), key, counts=groups.select(*key, "count"))
    some = groups.where("extra > 0")
    if not some.isEmpty():  # at most one group of a source, at its last taken word
        edge = written(found.where("extra > 0"), "edge").withColumn("part", F.spark_partition_id())
        sizes = edge.groupBy(*key, "part").count()
        sizes = sizes.select(*key, "part", F.coalesce(F.sum("count").over(W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("above"))
        number = F.row_number().over(W.partitionBy(*key, "part").orderBy(F.xxhash64("row")))
        edge = edge.withColumn("number", number).join(sizes, [*key, "part"]).withColumn("copies", F.col("copies") + (F.col("number") + F.col("above") <= F.col("extra")).cast("long"))
        found = found.where("extra = 0").select("row", "copies").unionByName(edge.select("row", "copies"))
    return found.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


ORACLE = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS key
    FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
    SELECT *, source_size * 3 AS cap, CASE src % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight
    FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM sizes)),
filled AS (
    SELECT *, row_number() OVER o AS place,
           CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM ranked WINDOW o AS (ORDER BY cap / weight, src)),
level AS (SELECT arg_min(level, place) AS level FROM filled WHERE cap > weight * level),
targets AS (
    SELECT source, source_size, src, weight, coalesce(least(CAST(cap AS DOUBLE), weight * (SELECT level FROM level)), CAST(cap AS DOUBLE)) AS target
    FROM filled),
placed AS (
    SELECT s.*, t.source_size, t.src, t.weight, t.target, row_number() OVER p AS place,
           CAST(sum(size) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fill
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    WINDOW p AS (PARTITION BY t.src ORDER BY key, doc_id, size)),
lane AS (
    SELECT src, place, size, epoch, CAST(epoch * source_size + fill AS DOUBLE) / CAST(weight AS DOUBLE) AS finish
    FROM placed, (SELECT unnest([0, 1, 2]) AS epoch)),
summed AS (
    SELECT *, sum(size) OVER (ORDER BY finish, src, place, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM lane),
numbered AS (SELECT *, row_number() OVER (ORDER BY finish, src, place, epoch) AS n FROM summed),
cut AS (SELECT coalesce(min(n), (SELECT count(*) + 1 FROM lane)) AS n FROM numbered WHERE running > (SELECT sum(size) FROM sized)),
taken AS (SELECT src, place, CAST(count(*) FILTER (WHERE n < (SELECT n FROM cut)) AS INTEGER) AS copies FROM numbered GROUP BY src, place)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies
FROM placed JOIN taken USING (src, place)
"""
