"""Connected components by alternating large and small stars, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the greater (large) or smaller neighbours of each node to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        near = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = near.filter("v <= u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return near.filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(u, v) links of any ordered type -> (node, component): the least node reachable.

    Only nodes that have a link to another node appear. Rows with nulls and u = v are ignored.
    Every round is written to the shared folder, so a lost executor costs one round at most.
    The result is a written table.
    """
    now = written(edges.select("u", "v").dropna().filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    total = None
    for _ in range(rounds):
        nxt = written(_star(_star(now, True), False), "cc")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(now)
        now = nxt
        if mark == total:
            break
        total = mark
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return written(found.union(tops), "cc-out")
