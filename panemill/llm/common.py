"""Shared helpers: words, scratch tables, bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.functions.tables import shared_dir, written
from panemill.functions.tables import shared_folder as scratch_path

__all__ = ["WORD", "crc_mod", "discard", "least_hashes", "maybe_broadcast", "remove", "scratch_path", "shared_dir", "spread_join", "table", "written"]

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    remove(df.sparkSession, df.scratch)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Spark's file system layer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split between rows to learn from and rows held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def least_hashes(rows: DataFrame, hashed: Column, n: int, total: int, *ties: str) -> DataFrame:
    """A sample of n rows at most, the same in each run: those of least hash.

    A first cut by value, a quarter wider than n of ``total`` rows should need, leaves the task that orders them about n rows to read, whatever the input.
    """
    share = 1.25 * n / max(1, total)
    if share < 1:
        rows = rows.where(hashed <= F.lit(int(-(2**63) + share * 2**64)))
    return rows.orderBy(hashed, *ties).limit(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one key from which a join may split it.
SPLIT = 1000
#: Split keys that may be broadcast at most; there is one for each ``SPLIT`` rows at most.
BROADCAST_KEYS = 1_000_000


def spread_join(rows: DataFrame, per_key: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` (a written table) joined with ``per_key``, which has one row for each key; no task gets much more than its share.

    Keys with more rows than a shuffle partition holds on average, and than ``SPLIT``, are cut in as many parts, and their
    row of ``per_key`` goes to each of them.  Rows keep their number and columns.  ``counts`` (key, count) is made from the rows if not given.
    """
    spark = rows.sparkSession
    n = counts.agg(F.sum("count")).first()[0] or 0 if counts is not None else rows.count()
    share = max(SPLIT, n // int(spark.conf.get("spark.sql.shuffle.partitions")))
    if n <= share:
        return rows.join(per_key, on, how)
    hot = (rows.groupBy(*on).count() if counts is None else counts).where(F.col("count") > share).select(*on, F.ceil(F.col("count") / share).cast("long").alias("_parts"))
    hot = written(hot, "hot")
    if hot.isEmpty():
        return rows.join(per_key, on, how)
    hot = maybe_broadcast(hot, BROADCAST_KEYS)
    left = rows.join(hot, on, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))))
    right = per_key.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [*on, "_part"], how).drop("_part")


def maybe_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast hint if a count shows at most ``most_rows`` rows; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
