"""Connected components of a graph given as edges, by alternating star contraction.

Each round hooks all larger neighbours of a node to its least neighbour (large star), then all smaller ones (small star), until
every component is a star around its least node: O(log n) rounds in practice.  Hubs are harmless: the least neighbour is a
partially aggregated minimum, and it meets the edges in a join whose sides are both plain exchanges, which Spark can split.
Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.storage import stored


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for nodes 0..n-1."""
    parent = list(range(n))
    for a, b in zip(left.tolist(), right.tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i in range(n):
        parent[i] = parent[parent[i]]
    return np.array(parent, np.int64)


def _contract(batches):
    """Edges of some batches as stars around their least nodes."""
    for pdf in batches:
        nodes, at = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
        root = forest(len(nodes), at[: len(pdf)], at[len(pdf) :])
        moved = root != np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[moved], "v": nodes[root[moved]]})


def connected(edges: DataFrame, root: str, contract: bool = True) -> DataFrame:
    """(u, v): for each node that isn't the least of its component, that least node.  ``edges`` has long columns u, v.

    With ``contract`` False the edges are stars already, u > v, and aren't contracted first (in the Python of their own stage).
    """
    edges = edges.where("u <> v")
    current = stored((edges.mapInPandas(_contract, "u long, v long") if contract else edges).distinct(), f"{root}/0")
    for round_ in count(1):
        mins = stored(
            current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
            f"{root}/{round_}/mins",
        )
        # current has u > v only, so a node's larger neighbours are the u of its rows
        large = stored(current.select(F.col("u").alias("w"), F.col("v").alias("u")).join(mins, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), f"{root}/{round_}/large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{root}/{round_}/least")
        hooked = large.join(least.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(least.select("u", F.col("m").alias("v")).unionByName(hooked).distinct(), f"{root}/{round_}/small")
        done = least.where("n > 1").isEmpty() and small.join(small.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        current = small
        if done:
            break
    return current
