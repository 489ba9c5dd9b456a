"""Connected components by alternating large-star and small-star steps.

Every step is joins and grouped minima; the graph is never in one task. A hub is no hot group: its
minimum is pre-aggregated, and the join back has an exchange of its own on each side (the key of the
minima is passed through a bit inversion), so adaptive execution can split a skewed side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut


def merge(label: np.ndarray, row: int, cols: np.ndarray) -> np.ndarray:
    """Labels after ``row`` and ``cols`` have become one component; a label is its component's smallest position."""
    seen = np.unique(label[cols])
    mine = label[row]
    if len(seen) == 1 and seen[0] == mine:
        return label
    joined = np.append(seen, mine)
    table = np.arange(len(label))
    table[joined] = joined.min()
    return table[label]


def _with_min(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the smallest of u and its v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.withColumn("k", F.bitwise_not("u")).join(low, "k").select("u", "v", "m")


def _is_star_forest(e: DataFrame) -> bool:
    """Every node points at one smaller node at most, and no node that points is pointed at."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per.where("out > 1 or (out > 0 and into > 0)").limit(1).count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u long, v long), in any direction, repeats and loops allowed -> (node, component_id).

    Only nodes that have an edge to another node come back; component_id is the smallest reachable
    node, itself included. Null ends are ignored. No edges: no rows.
    """
    e = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_min(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(roots)
