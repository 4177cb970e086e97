"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.session import settled


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition as stars: every node with the smallest one that these edges join it to."""
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                up[max(u, v)] = min(u, v)
        if len(up) > 2_000_000:  # what is held stays small, whatever the partition
            yield pd.DataFrame([(x, find(x)) for x in up if find(x) != x], columns=["u", "v"])
            up.clear()
    yield pd.DataFrame([(x, find(x)) for x in list(up) if find(x) != x], columns=["u", "v"])


def contracted(edges: DataFrame) -> DataFrame:
    return settled(edges.mapInPandas(_contract, edges.schema))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every endpoint of ``edges``; component is the smallest node reachable.

    Edges with a null end are ignored, self-loops give single nodes. Each round is two
    aggregations and two joins on edge rows and a contraction inside each partition; lineage is cut
    in the shared checkpoint folder. An endpoint set of any size works: nothing is gathered per component.
    """
    pairs = settled(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null"))
    loops = pairs.where("u = v").select(F.col("u").alias("node")).distinct()
    now = contracted(pairs.where("u <> v"))
    for _ in range(max_rounds):
        # done when every node has one edge and no node that others hang on has any
        if now.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").isEmpty() and now.join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        now = contracted(_small_star(_large_star(now)))
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    roots = stars.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    found = stars.unionByName(roots)
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
