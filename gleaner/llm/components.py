"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Stages


def _star(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and its neighbours."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low"))
    return pairs.join(low.hint("merge"), "u").withColumn("low", F.least("u", "low"))


def components(edges: DataFrame, stages: Stages, rounds: int = 60) -> DataFrame:
    """edges: (a, b) of integers, any direction, repeats allowed. Gives (node, component), for nodes with an edge.

    The component is its smallest node. Each round is one written table, so
    its lineage never grows and lost executors cost one round at most. Hot
    nodes are combined before the shuffle and their join is split by AQE.
    """
    now = stages.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-0")
    state = None
    for i in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small = _star(large)
        pairs = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v")))
        after = stages.put(pairs.where("u > v").distinct(), f"cc-{i}")
        got = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        stages.drop(f"cc-{i - 1}")
        now = after
        if state == (got.n, got.h):
            break
        state = (got.n, got.h)
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
