"""Deterministic policy over proposed lineage, and inheritance of descriptions.

Proposals are rows from outside (for example a model's answers); nothing here calls anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.operators.graph import closure
from spoorline.operators.shared import settled

SPARSE = 1


def eligible_files(files: DataFrame, unresolved: DataFrame, column_edges: DataFrame, sparse: int = SPARSE) -> DataFrame:
    """(source_file, reasons): open diagnostics, partial edges, or fewer column edges than expected.

    files: (source_file); unresolved: (source_file, kind); column_edges: (source_file, confidence).
    """
    a = unresolved.select("source_file", F.col("kind").alias("reason"))
    b = column_edges.filter("confidence = 'partial'").select("source_file", F.lit("partial_lineage").alias("reason"))
    n = column_edges.groupBy("source_file").agg(F.count("*").alias("n"))
    c = files.join(n, "source_file", "left").filter(F.coalesce("n", F.lit(0)) < sparse).select("source_file", F.lit("sparse_extraction").alias("reason"))
    return files.join(a.union(b).union(c).groupBy("source_file").agg(F.array_sort(F.collect_set("reason")).alias("reasons")), "source_file")


def evidence_holds(text: Column, sha: Column, line_start: Column, line_end: Column, quote: Column) -> Column:
    """Whether a quote stands in the named lines (from 1) of the text with that digest."""
    lines = F.split(text, "\n")
    ok = (line_start >= 1) & (line_end >= line_start) & (line_end <= F.size(lines)) & (quote != "")
    part = F.array_join(F.slice(lines, F.greatest(line_start, F.lit(1)), F.greatest(line_end - line_start + 1, F.lit(0))), "\n")
    return (F.sha2(text, 256) == sha) & ok & F.contains(part, quote)


DATASET_ID = r"^[a-z][a-z0-9+.-]*://[^\s/]+(/\S*)?$"


def dataset_allowed(dataset_id: Column, known: Column, text: Column) -> Column:
    """A well-formed id that is known, or whose name stands in the source."""
    return dataset_id.rlike(DATASET_ID) & (known | F.contains(text, F.substring_index(dataset_id, "/", -1)))


def judged(proposals: DataFrame, known: DataFrame, schemas: DataFrame) -> DataFrame:
    """Proposals with the first check they fail as reason; accepted ones have none.

    proposals: (id, target, target_column, source, source_column, evidence_ok); known: (dataset_id);
    schemas: (dataset_id, columns).
    """
    k = known.select("dataset_id").distinct().withColumn("is_known", F.lit(True))
    s = schemas.select("dataset_id", "columns")
    out = proposals
    for end in ("target", "source"):
        out = out.join(k.toDF(end, f"{end}_known"), end, "left").join(s.toDF(end, f"{end}_columns"), end, "left")
    member = lambda end: F.col(f"{end}_columns").isNull() | F.array_contains(f"{end}_columns", F.col(f"{end}_column"))
    reason = (
        F.when(~F.coalesce("evidence_ok", F.lit(False)), "evidence")
        .when(~F.col("target").rlike(DATASET_ID) | ~F.col("source").rlike(DATASET_ID), "dataset_id")
        .when(F.col("target_known").isNull(), "unknown_target")
        .when(F.col("source_known").isNull(), "unknown_source")
        .when(~member("target"), "target_column")
        .when(~member("source"), "source_column")
    )
    return out.select(*proposals.columns, reason.alias("reason"), F.when(reason.isNull(), "inferred").alias("confidence"))


def implied_table_edges(column_edges: DataFrame, table_edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Table edges (src, dst, job_id) that column edges (target, sources, indirect, job_id) imply and no row states.

    parts: where few rows repeat an edge, into how many parts they are dealt before they are made
    distinct, so that no task holds the edges of a whole split; else tasks make them distinct first.
    """
    ends = column_edges.select(F.explode(F.array_union("sources", "indirect")).alias("src"), F.col("target").alias("dst"), "job_id", F.lit(False).alias("stated")).filter("src != dst")
    rows = ends.unionByName(table_edges.select("src", "dst", "job_id", F.lit(True).alias("stated")))
    if parts:
        rows = rows.repartition(parts, "src", "dst", "job_id")
    return rows.groupBy("src", "dst", "job_id").agg(F.bool_or("stated").alias("stated")).filter("NOT stated").select("src", "dst", "job_id")


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, kind) rows of two sides -> (key, verdict): agreed, transformation, deterministic_only, ai_only.

    key: a string of target and sorted sources; kind: the transformation.
    """
    a, b = ours.groupBy("key").agg(F.min("kind").alias("a")), theirs.groupBy("key").agg(F.min("kind").alias("b"))
    verdict = F.when(F.col("b").isNull(), "deterministic_only").when(F.col("a").isNull(), "ai_only").when(F.col("a") == F.col("b"), "agreed").otherwise("transformation")
    return a.join(b, "key", "full").select("key", verdict.alias("verdict"))


def edge_key(target: Column, sources: Column) -> Column:
    return F.concat_ws("<-", target, F.array_join(F.array_sort(F.array_distinct(sources)), ","))


def merge_decisions(proposed: DataFrame, existing: DataFrame, shadow: bool = False) -> DataFrame:
    """(target, key) -> decision: unchanged (known), deferred (the target has exact lineage), accepted, or shadow_only."""
    k = existing.select("key").distinct().withColumn("known", F.lit(True))
    e = existing.filter("confidence = 'exact'").select("target").distinct().withColumn("exact", F.lit(True))
    out = proposed.join(k, "key", "left").join(e, "target", "left")
    decision = F.when(F.col("known"), "unchanged").when(F.col("exact"), "deferred").when(F.lit(shadow), "shadow_only").otherwise("accepted")
    return out.select("target", "key", decision.alias("decision"))


def committed(rows: DataFrame) -> DataFrame:
    """All rows of files (source_file, ok) without a failure: a file's proposals count together or not at all."""
    bad = rows.filter("NOT ok").select("source_file").distinct()
    return rows.join(bad, "source_file", "left_anti")


def call_plan(files: DataFrame, max_calls: int, max_tokens: int, max_context: int | None = None, deadline: float | None = None) -> DataFrame:
    """(seq, path, tokens[, context, seconds]) -> decision for each file, in order: called, or the
    first limit it meets: over_calls, over_deadline, over_context, over_tokens.

    A file whose tokens don't fit what is left is skipped and later ones may still fit, so each
    decision depends on all before it: a fold over the list of files, which is as small as a
    repository's, streamed through one task. context: characters sent with a file; seconds: what
    its call takes, counted against the deadline. Without these columns they are 0.
    """
    more = [c if c in files.columns else F.lit(0).alias(c) for c in ("context", "seconds")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls, used, spent = 0, 0, 0.0
        for pdf in batches:
            out = []
            for tokens, context, seconds in zip(pdf["tokens"], pdf["context"], pdf["seconds"]):
                if calls >= max_calls:
                    out.append("over_calls")
                elif deadline is not None and spent >= deadline:
                    out.append("over_deadline")
                elif max_context is not None and context > max_context:
                    out.append("over_context")
                elif used + tokens > max_tokens:
                    out.append("over_tokens")
                else:
                    out.append("called")
                    calls, used, spent = calls + 1, used + tokens, spent + seconds
            yield pdf[["seq", "path"]].assign(decision=out)

    ordered = files.select(F.col("seq").cast("long"), "path", F.col("tokens").cast("long"), *more).repartition(1).sortWithinPartitions("seq", "path")
    return ordered.mapInPandas(run, "seq long, path string, decision string")


def inherit_descriptions(columns: DataFrame, copies: DataFrame) -> DataFrame:
    """(node, description) and exact one-source identity edges (src, dst) -> node, description, inherited.

    Columns without a description take that of the one column they copy; repeated until no more do.
    Each round doubles how far a column looks, so a round that finds nothing new is the last.
    """
    only = copies.groupBy("dst").agg(F.count_distinct("src").alias("n"), F.min("src").alias("src")).filter("n = 1 AND src != dst").select(F.col("dst").alias("node"), F.col("src").alias("up"))
    now = settled(columns.select("node", "description").join(only, "node", "left").select("node", "description", F.lit(False).alias("inherited"), F.when(F.col("description").isNull(), F.col("up")).alias("up")))
    while True:
        above = now.select(F.col("node").alias("up"), F.col("description").alias("d"), F.col("up").alias("next"))
        found = F.coalesce("description", "d")
        nxt = now.join(above, "up", "left").select("node", found.alias("description"), (F.col("inherited") | (F.col("description").isNull() & F.col("d").isNotNull())).alias("inherited"), F.when(found.isNull(), F.col("next")).alias("up"))
        nxt = settled(nxt)
        if nxt.filter("inherited").count() == now.filter("inherited").count():
            return nxt.select("node", "description", "inherited")
        now = nxt


def description_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, level): nodes that reach each other are one component, named by its least
    node; a component's level is the longest path of components that leads to it."""
    reach = closure(edges)
    mutual = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])
    names = mutual.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
    comp = settled(nodes.select("node").distinct().join(names, "node", "left").select("node", F.least("node", F.coalesce("least", "node")).alias("component")))
    a, b = comp.toDF("src", "a"), comp.toDF("dst", "b")
    links = settled(edges.join(a, "src").join(b, "dst").filter("a != b").select("a", "b").distinct())
    level = settled(comp.select("component").distinct().withColumn("level", F.lit(0)))
    while True:
        pushed = links.join(level.toDF("a", "l"), "a").groupBy(F.col("b").alias("component")).agg((F.max("l") + 1).alias("up"))
        nxt = settled(level.join(pushed, "component", "left").select("component", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        if nxt.join(level.toDF("component", "old"), "component").filter("level != old").isEmpty():
            return comp.join(nxt, "component").select("node", "component", "level")
        level = nxt


def description_decisions(columns: DataFrame) -> DataFrame:
    """(node, description, complete, proposed) -> kept, incomplete_lineage, invalid, described or missing."""
    valid = F.col("proposed").isNotNull() & F.trim("proposed").rlike(r"^\S[^\n]{2,499}$")
    return columns.withColumn("decision", F.when(F.col("description").isNotNull(), "kept").when(~F.col("complete"), "incomplete_lineage").when(F.col("proposed").isNull(), "missing").when(~valid, "invalid").otherwise("described"))


def prompts(columns: DataFrame) -> DataFrame:
    """(node, kind, expression, sources) -> the request's JSON for each column, keys in order."""
    return columns.select("node", F.to_json(F.struct(F.col("node").alias("column"), "expression", "kind", F.array_sort("sources").alias("sources"))).alias("prompt"))
