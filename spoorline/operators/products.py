"""Products: declared and observed dependencies, and drift between data and orchestration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_codes(declared: DataFrame, products: DataFrame) -> DataFrame:
    """Declared (product, depends_on) with depends_on as a code where it was a product's name."""
    names = products.select(F.lower("name").alias("_name"), F.col("code").alias("_code"))
    return declared.join(names, F.lower("depends_on") == F.col("_name"), "left").withColumn("depends_on", F.coalesce("_code", "depends_on")).drop("_name", "_code")


def observed_dependencies(deps: DataFrame, job_products: DataFrame) -> DataFrame:
    """(job_id, upstream) with (job_id, product) -> (product, depends_on, n_jobs) across products."""
    a = job_products.select("job_id", "product")
    b = job_products.select(F.col("job_id").alias("upstream"), F.col("product").alias("depends_on"))
    return deps.join(a, "job_id").join(b, "upstream").filter("product != depends_on").groupBy("product", "depends_on").agg(F.count("*").alias("n_jobs"))


def dependency_status(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """(product, depends_on, status, n_jobs): confirmed, undeclared or declared_but_unobserved."""
    d = declared.select("product", "depends_on").distinct().withColumn("declared", F.lit(True))
    status = F.when(F.col("declared").isNull(), "undeclared").when(F.col("n_jobs").isNull(), "declared_but_unobserved").otherwise("confirmed")
    return observed.join(d, ["product", "depends_on"], "full").select("product", "depends_on", status.alias("status"), F.coalesce("n_jobs", F.lit(0)).cast("long").alias("n_jobs"))


def orchestration_drift(deps: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Dependencies between scheduled jobs with one kind of evidence: (job_id, upstream, drift)."""
    both = deps.join(scheduled.select("job_id"), "job_id", "left_semi").join(scheduled.select(F.col("job_id").alias("upstream")), "upstream", "left_semi")
    one = both.filter(F.size("sources") == 1)
    return one.select("job_id", "upstream", F.when(F.col("sources")[0] == "data", "missing_task_dependency").otherwise("ordering_only").alias("drift"))
