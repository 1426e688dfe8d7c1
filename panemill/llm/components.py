"""Connected components by contraction.

Each round every vertex hooks to its least neighbour, pointers are doubled until each leads to the root of its tree, and the
edges move to the roots: at most half of the vertices are left.  All steps are map-side combined aggregates and joins on single
ids that cut hot ids (``spread_join``), so a vertex with millions of neighbours is dealt to many tasks; a chain of n vertices takes
one round of log n doublings.  Each round's tables are written, so lost executors don't send the work back to the start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panemill.llm.common import spread_join, written


def _jump(step: DataFrame) -> DataFrame:
    """Pointers of a written table followed once; ``moved`` tells which were not yet at an end."""
    up = step.select(F.col("id").alias("parent"), F.col("parent").alias("upper"))
    return spread_join(step.select("id", "parent"), up, ["parent"]).select("id", F.col("upper").alias("parent"), (F.col("upper") != F.col("parent")).alias("moved"))


def _collapsed(step: DataFrame) -> DataFrame:
    """Every vertex of the pointer trees at its tree's root, by doubling."""
    while True:
        step = written(_jump(step), "hooks")
        if step.where("moved").isEmpty():
            return step.drop("moved")


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of comparable ids, (id, component): the least id that can be reached.

    Only ids of edges are returned; repeated edges, loops and null ends are ignored; no edges give no rows.
    """
    kind = edges.schema["a"].dataType
    edges = written(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("parent"))
        step = _collapsed(written(step, "hooks"))
        at = [step.select(F.col("id").alias(c), F.col("parent").alias(f"p{c}")) for c in ("a", "b")]
        moved = spread_join(written(spread_join(edges, at[0], ["a"]), "edges"), at[1], ["b"])
        edges = written(moved.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = step.withColumnRenamed("parent", "component")
        else:
            up = step.select(F.col("id").alias("component"), F.col("parent").alias("upper"))
            labels = written(spread_join(labels, up, ["component"], "left").select("id", F.coalesce("upper", "component").alias("component")), "labels")
    return labels if labels is not None else edges.select(F.col("a").cast(kind).alias("id"), F.col("b").cast(kind).alias("component"))


def roots(parents: DataFrame, thread: str, place: str, parent: str) -> DataFrame:
    """From (thread, place, parent) with the parent a place of the same thread, earlier in it: (thread, place, root).

    Pointers are doubled: after k steps each place points 2**k parents up, so depth d takes about log d joins, and each join
    only takes the places that have not yet arrived.
    """
    going, arrived = written(parents.select(thread, place, F.col(parent).alias("root")), "roots"), []
    while True:
        now = reduce(DataFrame.union, arrived, going)
        up = now.select(thread, F.col(place).alias("root"), F.col("root").alias("upper"))
        step = spread_join(going, up, [thread, "root"], "left").select(thread, place, F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved"))
        step = written(step, "roots")
        arrived.append(step.where("not moved").drop("moved"))
        going = step.where("moved").drop("moved")
        if going.isEmpty():
            return reduce(DataFrame.union, arrived)
