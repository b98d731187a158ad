"""Lineage-shaped views of the synthetic tables: graphs from foreign keys, event logs, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name(tag: str, c: Column | str) -> Column:
    return F.concat(F.lit(tag + ":"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """region -> nation -> customer -> order -> supplier, each layer loaded by one job."""
    layer = lambda df, a, b, job: df.select(a.alias("src"), b.alias("dst"), F.lit(job).alias("job_id"))
    n, c, o = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "orders")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return (
        layer(n, name("region", "n_regionkey"), name("nation", "n_nationkey"), "load:nation")
        .unionByName(layer(c, name("nation", "c_nationkey"), name("customer", "c_custkey"), "load:customer"))
        .unionByName(layer(o, name("customer", "o_custkey"), name("order", "o_orderkey"), "load:orders"))
        .unionByName(layer(li, name("order", "l_orderkey"), name("supplier", "l_suppkey"), "load:lineitem"))
    )


EDGES = """edges AS (
 SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'load:nation' AS job_id FROM nation
 UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'load:customer' FROM customer
 UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'load:orders' FROM orders
 UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'load:lineitem' FROM lineitem)"""


def owners(spark: SparkSession, d: str) -> DataFrame:
    """Regions own what lies in them: nations, customers, suppliers."""
    n = table(spark, d, "nation")
    region = n.select(F.col("n_nationkey").alias("k"), name("region", "n_regionkey").alias("product"))
    c = table(spark, d, "customer").join(region, F.col("c_nationkey") == F.col("k")).select(name("customer", "c_custkey").alias("dataset_id"), "product")
    s = table(spark, d, "supplier").join(region, F.col("s_nationkey") == F.col("k")).select(name("supplier", "s_suppkey").alias("dataset_id"), "product")
    o = table(spark, d, "orders").join(c, name("customer", "o_custkey") == F.col("dataset_id")).select(name("order", "o_orderkey").alias("dataset_id"), "product")
    return n.select(name("nation", "n_nationkey").alias("dataset_id"), name("region", "n_regionkey").alias("product")).unionByName(c).unionByName(s).unionByName(o)


OWNERS = """owners AS (
 SELECT 'nation:' || n_nationkey AS dataset_id, 'region:' || n_regionkey AS product FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'order:' || o_orderkey, 'region:' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def job_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers write the parts they had returned, and read those that they sold in bulk;
    brands read their own parts that were accepted in bulk. A row for each line that says so."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    row = lambda df, job, way: df.select(job.alias("job_id"), name("part", "l_partkey").alias("dataset_id"), F.lit(way).alias("direction"))
    out = row(li.filter("l_returnflag = 'R'"), name("supplier", "l_suppkey"), "out")
    both = row(li.filter("l_quantity >= 45"), name("supplier", "l_suppkey"), "in")
    brand = row(li.filter("l_returnflag = 'A' AND l_quantity >= 30").join(p, F.col("l_partkey") == F.col("p_partkey")), name("brand", "p_brand"), "in")
    return out.unionByName(both).unionByName(brand)


def job_io(spark: SparkSession, d: str) -> DataFrame:
    return job_rows(spark, d).distinct()


JOB_IO = """job_io AS (
 SELECT DISTINCT 'supplier:' || l_suppkey AS job_id, 'part:' || l_partkey AS dataset_id, 'out' AS direction FROM lineitem WHERE l_returnflag = 'R'
 UNION SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'in' FROM lineitem WHERE l_quantity >= 45
 UNION SELECT 'brand:' || p_brand, 'part:' || l_partkey, 'in' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND l_quantity >= 30)"""

DEPS = (
    JOB_IO
    + """, clean AS (SELECT job_id AS upstream, dataset_id FROM job_io o WHERE direction = 'out'
   AND NOT EXISTS (SELECT 1 FROM job_io i WHERE i.direction = 'in' AND i.job_id = o.job_id AND i.dataset_id = o.dataset_id)),
 in_place AS (SELECT DISTINCT o.job_id AS upstream FROM job_io o JOIN job_io i USING (job_id, dataset_id) WHERE o.direction = 'out' AND i.direction = 'in'),
 deps AS (SELECT r.job_id, c.upstream, count(DISTINCT r.dataset_id) AS n_via, string_agg(DISTINCT r.dataset_id, ',' ORDER BY r.dataset_id) AS via,
   c.upstream IN (SELECT upstream FROM in_place) AS in_place_writer
   FROM job_io r JOIN clean c USING (dataset_id) WHERE r.direction = 'in' AND r.job_id <> c.upstream GROUP BY r.job_id, c.upstream)"""
)


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """A tree of tasks by customer keys: each after the one of half its number."""
    return table(spark, d, "customer").filter("c_custkey >= 2").select(name("task", F.floor(F.col("c_custkey") / 2)).alias("src"), name("task", "c_custkey").alias("dst"))


TASKS = "tasks AS (SELECT 'task:' || (c_custkey // 2) AS src, 'task:' || c_custkey AS dst FROM customer WHERE c_custkey >= 2)"


def task_jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter("c_custkey % 3 != 0").select(name("task", "c_custkey").alias("task"), name("job", F.col("c_custkey") % 40).alias("job_id"))


TASK_JOBS = "task_jobs AS (SELECT 'task:' || c_custkey AS task, 'job:' || (c_custkey % 40) AS job_id FROM customer WHERE c_custkey % 3 <> 0)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a run's log."""
    return table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), "value", F.col("user_id"))
