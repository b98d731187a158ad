"""Relational and graph operators over lineage facts. Joins and aggregations only.

Names: jobs are job_id; datasets are canonical ids; job_io rows are (job_id, dataset_id, direction)
with direction `in` or `out`; edges are (src, dst). Iterations write each step to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.operators.shared import settled


def _united(df: DataFrame, key: str, *arrays: str) -> DataFrame:
    """(key, arrays) with the arrays of all rows of a key as sorted sets.

    Values are made distinct within tasks first, so a key of many rows brings its set to one task
    and not all its rows' arrays.
    """
    values = reduce(DataFrame.unionAll, [df.select(key, F.lit(a).alias("of"), F.explode(a).alias("x")) for a in arrays]).filter("x IS NOT NULL").distinct()
    return values.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("of") == a, F.col("x")))).alias(a) for a in arrays])


def _with_sets(facts: DataFrame, sets: DataFrame, key: str, *arrays: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rest = [c for c in facts.columns if c != key]
    return facts.join(sets, key, "left").select(key, *[F.coalesce(a, none).alias(a) for a in arrays], *rest)


def _first(c: str) -> Column:
    """The first stated value by seq; of several at one seq the least, whatever order rows come in."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c)


def merge_datasets(datasets: DataFrame) -> DataFrame:
    """One row for each id: arrays united, and the first stated location, product and layer by seq."""
    facts = datasets.groupBy("id").agg(_first("physical_location"), _first("product"), _first("layer"))
    return _with_sets(facts, _united(datasets, "id", "aliases", "columns"), "id", "aliases", "columns")


def canonical_aliases(pairs: DataFrame, rounds: int = 64) -> DataFrame:
    """(alias, owner) with at most one owner for each alias -> (alias, canonical), followed to the end.

    Pointers double their reach each round. Names on a cycle keep the least name of the cycle.
    """
    step = settled(pairs.filter("alias != owner").select("alias", "owner", F.least("alias", "owner").alias("least")))
    for _ in range(rounds):
        ahead = step.select(F.col("alias").alias("owner"), F.col("owner").alias("further"), F.col("least").alias("low"))
        nxt = settled(step.join(ahead, "owner", "left").select("alias", F.coalesce("further", "owner").alias("owner"), F.least("least", F.coalesce("low", "least")).alias("least"), F.col("further").isNotNull().alias("moved")))
        moved = nxt.filter("moved").join(nxt.select(F.col("alias").alias("owner"), F.lit(1).alias("again")), "owner", "left_semi")
        # What still moves after its reach passed the number of names goes round a cycle.
        n_left, n = moved.count(), step.count()
        step = nxt.drop("moved")
        if not n_left or 2 ** (_ + 1) > 2 * n:
            break
    on_cycle = step.join(step.select(F.col("alias").alias("owner")).distinct(), "owner", "left_semi").select("alias", F.col("least").alias("canonical"))
    ended = step.join(step.select(F.col("alias").alias("owner")).distinct(), "owner", "left_anti").select("alias", F.col("owner").alias("canonical"))
    return ended.unionByName(on_cycle.filter("alias != canonical"))


def alias_owners(datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases that exactly one dataset claims (alias, owner), and those that several claim (alias, owners)."""
    claims = datasets.select(F.explode("aliases").alias("alias"), F.col("id").alias("owner")).filter("alias != owner").distinct()
    by = claims.groupBy("alias").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    return by.filter(F.size("owners") == 1).select("alias", F.col("owners")[0].alias("owner")), by.filter(F.size("owners") > 1)


def rewrite(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """The columns' ids replaced by their canonical ones, where (alias, canonical) has one."""
    for c in columns:
        to = names.select(F.col("alias").alias(c), F.col("canonical").alias("_to"))
        df = df.join(to, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return df


def missing_datasets(edges: DataFrame, datasets: DataFrame) -> DataFrame:
    """Ids that edges name and the table of datasets lacks."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(datasets.select("id"), "id", "left_anti")


def merge_jobs(jobs: DataFrame) -> DataFrame:
    """One row for each job_id with inputs and outputs united and the first stated facts by seq."""
    facts = [c for c in jobs.columns if c not in ("job_id", "inputs", "outputs", "seq")]
    named = jobs.groupBy("job_id").agg(*map(_first, facts)) if facts else jobs.select("job_id").distinct()
    return _with_sets(named, _united(jobs, "job_id", "inputs", "outputs"), "job_id", "inputs", "outputs")


def enrich_products(datasets: DataFrame, databases: DataFrame) -> DataFrame:
    """Datasets (id, namespace, product, layer) with what (name, product, layer) says of their database."""
    known = databases.select(F.lower("name").alias("_db"), F.col("product").alias("_p"), F.col("layer").alias("_l"))
    out = datasets.join(known, F.lower("namespace") == F.col("_db"), "left")
    return out.withColumn("product", F.coalesce("product", "_p")).withColumn("layer", F.coalesce("layer", "_l")).drop("_db", "_p", "_l")


def job_products(job_io: DataFrame, owners: DataFrame, jobs: DataFrame, folders: DataFrame) -> DataFrame:
    """(job_id, product): the one product of all outputs, else that of the longest folder above the file.

    owners: (dataset_id, product); jobs: (job_id, source_file); folders: (folder, product).
    """
    out = job_io.filter("direction = 'out'").join(owners, "dataset_id").groupBy("job_id").agg(F.min("product").alias("a"), F.max("product").alias("b"))
    by_output = out.filter("a = b").select("job_id", F.col("a").alias("by_output"))
    # A folder is above a file if it is one of the file's own prefixes: an equi-join, not a prefix scan.
    parts = F.split("source_file", "/")
    above = jobs.select("job_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))).alias("folder"))
    by_folder = above.join(folders, "folder").groupBy("job_id").agg(F.max_by("product", F.length("folder")).alias("by_folder"))
    return jobs.select("job_id").join(by_output, "job_id", "left").join(by_folder, "job_id", "left").select("job_id", F.coalesce("by_output", "by_folder").alias("product"))


def data_dependencies(job_io: DataFrame) -> DataFrame:
    """(job_id, upstream, via, in_place_writer): a reader after each writer that doesn't read the dataset itself."""
    # One row for each job and dataset says both ways, so nothing is joined to tell who reads what
    # it writes; the rows are made once for all that reads them.
    way = lambda w: F.bool_or(F.col("direction") == w).alias(w)
    io = settled(job_io.dropna(subset=["job_id", "dataset_id"]).groupBy("job_id", "dataset_id").agg(way("in"), way("out")))
    reads = io.filter(F.col("in")).select("job_id", "dataset_id")
    clean = io.filter(F.col("out") & ~F.coalesce("in", F.lit(False))).select(F.col("job_id").alias("upstream"), "dataset_id")
    in_place = io.filter(F.col("out") & F.col("in")).select(F.col("job_id").alias("upstream")).distinct().withColumn("in_place_writer", F.lit(True))
    deps = reads.join(clean, "dataset_id").filter("job_id != upstream").groupBy("job_id", "upstream").agg(F.array_sort(F.collect_set("dataset_id")).alias("via"))
    return deps.join(in_place, "upstream", "left").select("job_id", "upstream", "via", F.coalesce("in_place_writer", F.lit(False)).alias("in_place_writer"))


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst) -> all pairs (src, dst, hop) with the least hop; a pair (n, n) tells a cycle.

    Frontier by frontier, each joined with the edges and cleared of known pairs.
    """
    edges = settled(edges.select("src", "dst").dropna().distinct())
    known = front = settled(edges.withColumn("hop", F.lit(1)))
    hop = 1
    while (max_depth is None or hop < max_depth) and not front.isEmpty():
        hop += 1
        step = front.select("src", F.col("dst").alias("mid")).join(edges.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct()
        front = settled(step.join(known, ["src", "dst"], "left_anti").withColumn("hop", F.lit(hop)))
        known = known.unionByName(front)
    return known


def cyclic_nodes(reach: DataFrame) -> DataFrame:
    """Of a closure the nodes that reach themselves."""
    return reach.filter("src = dst").select(F.col("src").alias("node")).distinct()


def dag_dependencies(task_edges: DataFrame, task_jobs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst) task order and (task, job_id) -> (job_id, upstream); tasks without a job only bridge.

    Each job walks up from all its tasks at once, so there are (job, task) pairs to keep: jobs times
    tasks at most, and in a tree far fewer than pairs of tasks, as what two tasks of a job both
    come after is one row.
    """
    edges = settled(task_edges.select("src", "dst").dropna().distinct())
    jobs = task_jobs.select("task", "job_id").dropna().distinct()
    above = lambda at: at.join(edges.withColumnRenamed("dst", "task"), "task").select("job_id", F.col("src").alias("task")).distinct()
    known = front = settled(above(jobs))
    hop = 1
    while (max_depth is None or hop < max_depth) and not front.isEmpty():
        hop += 1
        front = settled(above(front).join(known, ["job_id", "task"], "left_anti"))
        known = known.unionByName(front)
    both = known.join(jobs.withColumnRenamed("job_id", "upstream"), "task")
    return both.filter("job_id != upstream").select("job_id", "upstream").distinct()


def external_references(refs: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References to tasks of other DAGs -> task edges (src, dst), and references that can't be resolved.

    refs: (task, kind `sensor` or `trigger`, dag_id, task_id or null); tasks: (task, dag_id, task_id,
    is_root, source_file). The DAG must be defined in one file. A sensor waits for the named task,
    or all tasks of the DAG; a trigger comes before the DAG's roots.
    """
    sole = tasks.groupBy("dag_id").agg(F.count_distinct("source_file").alias("files")).filter("files = 1").select("dag_id")
    named = tasks.join(sole, "dag_id").select(F.col("task").alias("other"), "dag_id", F.col("task_id").alias("other_id"), "is_root")
    met = refs.join(named, "dag_id").filter("(kind = 'sensor' AND (task_id IS NULL OR task_id = other_id)) OR (kind = 'trigger' AND is_root)")
    edges = met.select(F.when(F.col("kind") == "sensor", F.col("other")).otherwise(F.col("task")).alias("src"), F.when(F.col("kind") == "sensor", F.col("task")).otherwise(F.col("other")).alias("dst")).distinct()
    return edges, refs.join(met.select("task", "dag_id").distinct(), ["task", "dag_id"], "left_anti")


def merge_evidence(data: DataFrame, dag: DataFrame | None) -> DataFrame:
    """Data and DAG dependencies as one row for a pair: sources (sorted), via, in_place_writer."""
    if dag is None:
        return data.select("job_id", "upstream", F.array(F.lit("data")).alias("sources"), "via", "in_place_writer")
    none = F.array().cast("array<string>")
    a = data.select("job_id", "upstream", F.lit("data").alias("source"), "via", "in_place_writer")
    b = dag.select("job_id", "upstream", F.lit("dag").alias("source"), none.alias("via"), F.lit(False).alias("in_place_writer"))
    return a.unionByName(b).groupBy("job_id", "upstream").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("via")))).alias("via"), F.bool_or("in_place_writer").alias("in_place_writer"))


def dedup(df: DataFrame) -> DataFrame:
    """Equal rows once, whatever their columns hold."""
    return df.distinct()


def summary(column_edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(fact, name, n): column edges by confidence, unresolved rows by kind."""
    a = column_edges.groupBy(F.col("confidence").alias("name")).agg(F.count("*").alias("n")).withColumn("fact", F.lit("column_edge"))
    b = unresolved.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).withColumn("fact", F.lit("unresolved"))
    return a.unionByName(b).select("fact", "name", "n")


def attach_schedules(jobs: DataFrame, airflow: DataFrame, product_yaml: DataFrame, comments: DataFrame) -> DataFrame:
    """(job_id, schedule_id): a task's DAG before the product's file before a comment."""
    out = jobs.select("job_id")
    for k, df in enumerate((airflow, product_yaml, comments)):
        out = out.join(df.groupBy("job_id").agg(F.min("schedule_id").alias(f"s{k}")), "job_id", "left")
    return out.select("job_id", F.coalesce("s0", "s1", "s2").alias("schedule_id"))
