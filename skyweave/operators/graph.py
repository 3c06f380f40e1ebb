"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.config import SkyweaveError

from .common import checkpoint


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Union-find over few edges."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for pdf in batches:
            for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
                a, b = find(u), find(v)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]}, dtype="int64")

    return edges.coalesce(1).mapInPandas(run, "node long, root long")


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = 0) -> DataFrame:
    """node, root (the smallest node of the class) for every node of ``edges`` (u, v). Up to ``small`` edges, which are
    counted, are solved in one task; more go round by round, and rounds that do not settle are an error.

    Every round is written to the checkpoint folder, so that a lost executor costs no more than the round that was
    running. Joins are merge joins by hint: the sizes that Spark assumes for checkpointed data would let it broadcast
    tables that grow with the input.
    """
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if small and edges.limit(small + 1).count() <= small:
        return _in_one_task(edges)
    state, settled = None, False
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low.hint("merge"), "u")
        edges = checkpoint(
            near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        settled = now == state
        if settled:
            break
        state = now
    if not settled:
        raise SkyweaveError(f"components have not settled after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
