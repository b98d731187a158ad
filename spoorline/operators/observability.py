"""Run metrics from an event log: (stage, seq, value) rows and their aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LATEST = 256


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("stage").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def gauges(events: DataFrame) -> DataFrame:
    """The last value of each name."""
    return events.groupBy("stage").agg(F.max_by("value", "seq").alias("last_value"))


def durations(events: DataFrame, latest: int = LATEST) -> DataFrame:
    """(stage, n, total, least, most, mean, p95): p95 by nearest rank over the latest samples.

    The latest samples come from a top-k rank, which Spark limits within tasks before the shuffle.
    """
    whole = events.groupBy("stage").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))
    last = events.filter("value IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("stage").orderBy(F.col("seq").desc()))).filter(F.col("k") <= latest)
    sample = last.groupBy("stage").agg(F.sort_array(F.collect_list("value")).alias("v"))  # at most `latest` values
    p95 = sample.select("stage", F.get("v", (F.ceil(F.size("v") * F.lit(95) / F.lit(100)) - 1).cast("int")).alias("p95"))
    return whole.join(p95, "stage", "left")


def throughput(runs: DataFrame) -> DataFrame:
    """(run_id, files, bytes, seconds) -> rates, null for runs of no time."""
    return runs.select("run_id", F.try_divide("files", "seconds").alias("files_per_second"), F.try_divide("bytes", "seconds").alias("bytes_per_second"))


def rotation(log: DataFrame, most_bytes: int, most_files: int) -> DataFrame:
    """(run_id, seq, bytes) -> file number of each record, filled in order; null when files run out.

    A record that doesn't fit starts the next file, which depends on all before it: a fold for
    each run's log, streamed in order within one task for each run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, file, used = None, 0, 0
        for pdf in batches:
            out = []
            for run_id, n in zip(pdf["run_id"], pdf["bytes"]):
                if run_id != now:
                    now, file, used = run_id, 0, 0
                if used and used + n > most_bytes:
                    file, used = file + 1, 0
                used += n
                out.append(file if file < most_files else None)
            yield pdf[["run_id", "seq"]].assign(file=pd.array(out, dtype="Int64"))

    ordered = log.select("run_id", "seq", "bytes").repartition("run_id").sortWithinPartitions("run_id", "seq")
    return ordered.mapInPandas(run, "run_id string, seq long, file long")


def spans(events: DataFrame) -> DataFrame:
    """(span_id, parent_id, kind started/finished/failed, seq) -> one row for each span with its status."""
    by = events.groupBy("span_id").agg(F.first("parent_id", ignorenulls=True).alias("parent_id"), F.min(F.when(F.col("kind") == "started", F.col("seq"))).alias("started"), F.max(F.when(F.col("kind") != "started", F.col("seq"))).alias("ended"), F.bool_or(F.col("kind") == "failed").alias("bad"))
    return by.select("span_id", "parent_id", "started", "ended", F.when(F.col("bad"), "failed").when(F.col("ended").isNull(), "open").otherwise("finished").alias("status"))


SEVERITY = ("success", "partial", "failed", "cancelled")


def run_status(events: DataFrame) -> DataFrame:
    """(run_id, status) -> the gravest status of each run."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status"))
    return events.groupBy("run_id").agg(F.max_by("status", rank).alias("status"))
