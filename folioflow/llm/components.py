"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), on Spark tables throughout.

A round links every vertex to the smallest one it knows of; rounds are logarithmic in the size of a component. Each round's edges are
written to the shared folder. Minima are pre-aggregated in the map tasks, and the join that brings them back broadcasts
them where their number is small and else is an equi-join of two written tables, which adaptive execution splits at a hub. Nothing is collected but a count and a checksum a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import discard, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest vertex reachable) of every vertex of edges (a, b) that has another neighbour than itself."""
    a, b = edges.columns
    e = written(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before, done = None, []
    for _ in range(most_rounds):
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
        small = 2 * now[0] <= common.BROADCAST_ROWS

        def minima(df: DataFrame) -> DataFrame:
            if small:
                return F.broadcast(df)
            done.append(written(df, "minima"))
            return done[-1]

        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(minima(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if not small:
            large = written(large, "large")
            done.append(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        done.append(e)
        e = written(large.join(minima(least), "u").select(F.inline(pairs)).filter("u <> v").distinct(), "edges")
        discard(*done)
        done = []
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def with_roots(components: DataFrame) -> DataFrame:
    """The components with a row for each root itself."""
    return components.unionByName(components.select(F.col("component").alias("node"), "component").distinct())


def local_groups(links: np.ndarray) -> np.ndarray:
    """Of each vertex of a symmetric matrix, the first vertex of its component."""
    n = len(links)
    root = np.full(n, -1)
    for s in range(n):
        if root[s] < 0:
            root[s] = s
            front = np.array([s])
            while len(front):
                front = np.flatnonzero(links[front].any(0) & (root < 0))
                root[front] = s
    return root
