"""Connected components of an edge table, for identity groups and duplicate classes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.session import Rewritten, cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct()


#: Edges, after a count, that one task joins by itself.
FEW_EDGES = 300_000


def _joined_at_once(edges: DataFrame) -> DataFrame:
    """Components of few edges by union and find in one task."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for b in batches:
            for u, v in zip(b["u"], b["v"], strict=True):
                root.setdefault(u, u)
                root.setdefault(v, v)
                x, y = find(u), find(v)
                if x != y:
                    root[max(x, y)] = min(x, y)
        yield pd.DataFrame({"node": list(root), "component": [find(x) for x in root]})

    return edges.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) of every node with an edge; component is its least node.

    Alternates large and small stars, each a shuffled minimum and join, until the
    edges stand still; rounds grow as the logarithm of the longest path. Few
    edges, by count, are joined in one task. Loops and null ends are ignored,
    repeated edges count once; without edges the result is empty. Each round is a
    table in the shared folder, so lineage and estimates never grow.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = cut(e)
    if e.limit(few + 1).count() <= few:
        return _joined_at_once(e)
    rounds = Rewritten(e)
    said = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h"))
    before = None
    for _ in range(most):
        e = rounds.write(_small_star(_large_star(rounds.df)))
        now = tuple(e.agg(said.alias("s")).first().s)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
