"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that one task joins at once; more are first brought together in rounds.
LOCAL = 200_000


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """``node, root`` of every node in ``links(a, b)``: the smallest node of its component.

    Alternates large and small stars until nothing changes, or so few links are left that one task of an executor joins
    them.  Each step is one aggregation, which is pre-aggregated on the map side, and one join, whose hot nodes adaptive
    execution can split; its result is written, so no lineage grows.  Two numbers a round reach the driver.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    kind = dict(edges.dtypes)["u"]
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] <= local:
            return edges.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}")
        if tuple(now) == before or not now["n"]:
            break
        before = tuple(now)
        # large star: larger neighbours move to the smallest one's
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, "edges")
        # small star: smaller neighbours and the node itself move to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = written(small, "edges")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links that a task reads."""
    up: dict = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    nodes = list(up)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([find(x) for x in nodes])], names=["node", "root"])
