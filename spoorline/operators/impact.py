"""Impact of a dataset or column: what lies downstream or upstream, and at what distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.operators.shared import settled


def hops(edges: DataFrame, start: str, direction: str = "downstream", max_depth: int | None = None) -> DataFrame:
    """(src, dst) -> (node, hop) with the least number of hops from start, without start itself.

    Each round joins the last frontier with the edges and drops nodes seen before, so cycles end
    and no path is counted twice. Raises for an unknown node or a negative depth.
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError("max_depth must not be negative")
    if direction not in ("downstream", "upstream"):
        raise ValueError(f"no such direction: {direction}")
    ends = edges.select("src", "dst") if direction == "downstream" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = settled(ends)  # every round reads them again
    if ends.filter((F.col("src") == start) | (F.col("dst") == start)).isEmpty():
        raise KeyError(f"no such node: {start}")
    seen = front = edges.sparkSession.createDataFrame([(start, 0)], "node string, hop int")
    hop = 0
    while max_depth is None or hop < max_depth:
        hop += 1
        step = front.select(F.col("node").alias("src")).join(ends, "src").select(F.col("dst").alias("node")).distinct()
        front = settled(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("hop > 0")


def hop_report(reached: DataFrame, edges: DataFrame, owners: DataFrame, start: str, direction: str = "downstream") -> DataFrame:
    """(hop, nodes, jobs, products): sorted names at each distance, and jobs on edges that lead there.

    edges: (src, dst, job_id); owners: (dataset_id, product).
    """
    a, b = ("src", "dst") if direction == "downstream" else ("dst", "src")
    every = reached.unionByName(reached.sparkSession.createDataFrame([(start, 0)], "node string, hop int"))
    led = edges.join(every.select(F.col("node").alias(a), F.col("hop").alias("from_hop")), a).join(reached.select(F.col("node").alias(b), "hop"), b).filter("from_hop = hop - 1")
    jobs = led.groupBy("hop").agg(F.array_sort(F.collect_set("job_id")).alias("jobs"))
    nodes = reached.join(owners, reached["node"] == owners["dataset_id"], "left").groupBy("hop").agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.array_sort(F.collect_set("product")).alias("products"))
    return nodes.join(jobs, "hop", "left").select("hop", "nodes", "jobs", "products")


def cross_product_edges(edges: DataFrame, reached: DataFrame, owners: DataFrame, start: str) -> DataFrame:
    """Edges within what is reached (and start) whose ends belong to different products."""
    inside = reached.select("node").union(reached.sparkSession.createDataFrame([(start,)], "node string"))
    e = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")
    e = e.join(owners.select(F.col("dataset_id").alias("src"), F.col("product").alias("src_product")), "src").join(owners.select(F.col("dataset_id").alias("dst"), F.col("product").alias("dst_product")), "dst")
    return e.filter("src_product != dst_product").select("src", "dst", "src_product", "dst_product").distinct()
