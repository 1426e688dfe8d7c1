"""Scratch tables in the shared folder, checked broadcasts, and numbering of rows without a task that orders all of them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a table that may be broadcast at most; larger ones are joined by shuffle, or refused where only a small one makes sense.
BROADCAST_ROWS = 200_000
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error.

    The URI always names its scheme, so Spark and other readers find the same folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
        return re.sub("^file:/(?!/)", "file:///", uri)
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:  # a local session, as in tests
        _made[app] = tempfile.mkdtemp(prefix="panemill-")
        atexit.register(shutil.rmtree, _made[app], True)
    return f"file://{_made[app]}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a parquet table in the shared folder: work on lost executors is redone from its files, not from the start."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a count, cut short, shows at most so many rows."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of specifications, marked for broadcast; one with more than ``most`` rows is refused."""
    if not is_small(df, most):
        raise ValueError(f"more than {most} rows where a small table is meant")
    return F.broadcast(df)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if a count shows it to be small."""
    return F.broadcast(df) if is_small(df, most) else df


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], place: str = "place", total: str | None = None) -> DataFrame:
    """Adds the place of each row within its key, from 1, and the number of the key's rows.

    Rows are range-partitioned by key and order, so a key that holds most rows is dealt to many tasks; each numbers its own, and
    offsets come from a row for each key and partition.
    """
    if not keys:
        return numbered(rows.withColumn("_all_rows", F.lit(0)), ["_all_rows"], order, place, total).drop("_all_rows")
    own = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = own.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_above"), F.sum("_n").over(W.partitionBy(*keys)).alias("_all"))
    inside = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    out = own.withColumn("_inside", inside).join(sizes, [*keys, "_part"]).withColumn(place, F.col("_inside") + F.col("_above"))
    return (out.withColumn(total, F.col("_all")) if total else out).drop("_part", "_inside", "_above", "_all")


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "previous") -> DataFrame:
    """Adds the columns ``order`` of the key's row before, as a struct; null for a key's first row.

    Rows are compared within buckets, which must rise with the order, and a bucket's first row with the last one of the key's bucket before, so
    a busy key is spread over its buckets; only one short row a bucket is ordered by key.
    """
    rows = rows.withColumn("_in", bucket)
    own = F.struct(*order)
    ends = rows.groupBy(*keys, "_in").agg(F.max(own).alias("_end"))
    before = F.lag("_end").over(W.partitionBy(*keys).orderBy("_in")).alias("_before")
    ends = ends.select(*(F.col(k).alias(f"_end_{k}") for k in (*keys, "_in")), before)
    inside = F.lag(own).over(W.partitionBy(*keys, "_in").orderBy(*order))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_end_{k}")) for k in (*keys, "_in")))
    rows = rows.withColumn("_inside", inside).join(ends, same)
    return rows.withColumn(name, F.coalesce("_inside", "_before")).drop("_in", "_inside", "_before", *(f"_end_{k}" for k in (*keys, "_in")))


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join on keys that may be null; b's key columns are dropped."""
    own = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys), F.lit(True))
    return a.join(own, same, how).drop(*(f"_b_{k}" for k in keys))


def quantiles(rows: DataFrame, keys: Sequence[str], metrics: dict[str, Column], ps: dict[str, float]) -> DataFrame:
    """Exact quantiles by linear interpolation: keys, and a column metric_name for each metric and name of ps.

    Values are counted first, and the different ones dealt to tasks by ranges: each finds the ranks of its own, so no task or buffer holds all values of a key.
    """
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("_metric"), value.cast("double").alias("_value")) for m, value in metrics.items()))).alias("_x")
    group = [*keys, "_metric"]
    counts = rows.select(*keys, values).select(*keys, "_x.*").where("_value is not null").groupBy(*group, "_value").agg(F.count(F.lit(1)).alias("_n"))
    own = written(counts.repartitionByRange(*group, "_value").withColumn("_part", F.spark_partition_id()), "quantiles")
    sizes = own.groupBy(*group, "_part").agg(F.sum("_n").alias("_size"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_above"), F.sum("_size").over(W.partitionBy(*group)).alias("_all"))
    inside = F.sum("_n").over(W.partitionBy(*group, "_part").orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = same_keys(own.withColumn("_upto", inside), sizes, [*group, "_part"], "inner").withColumn("_upto", F.col("_upto") + F.col("_above"))
    found = []
    for name, p in ps.items():
        at = F.lit(p) * (F.col("_all") - 1)
        holds = lambda rank: (F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto"))
        low, high = (F.max(F.when(holds(bound(at) + 1), F.col("_value"))) for bound in (F.floor, F.ceil))
        rest = F.max(at - F.floor(at))
        found.append((low + (high - low) * rest).alias(name))
    each = placed.groupBy(*group).agg(*found)
    return each.groupBy(*keys).agg(*(F.max(F.when(F.col("_metric") == m, F.col(name))).alias(f"{m}_{name}") for m in metrics for name in ps))
