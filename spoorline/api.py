"""scan() and review(): a repository's facts as DataFrames, and what is asked of them."""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spoorline.functions import cron, identity
from spoorline.operators import exports, graph, impact, policy, products
from spoorline.plans import airflow
from spoorline.plans.frames import Interpreter
from spoorline.plans.references import Inspector
from spoorline.plans.sqlfront import Analysis, Result
from spoorline.schemas import SCHEMAS
from spoorline.sources import catalogs, repo
from spoorline.sources.products import read_products, readable_products

Rows = dict[str, list[dict]]
#: Files that are parsed at a time.
PARSERS = 8


@dataclass
class Context:
    """What readers of one scan share."""

    spark: SparkSession
    schema: Callable[[str], list[str] | None]
    bindings: Mapping[str, str]
    default_db: str | None
    sql_engine: str
    texts: dict[str, str]

    @cached_property
    def _endings(self) -> dict[str, list[str]]:
        """The files by each ending of their paths, so a look-up scans nothing."""
        return _by_ending(self.texts, lambda p: p)

    @cached_property
    def _inner_endings(self) -> dict[str, list[str]]:
        """The same by paths within their archives."""
        return _by_ending(self.texts, lambda p: re.sub(r"^.*!/", "", p))

    def module(self, caller: str) -> Callable[[str, int], tuple[str, str] | None]:
        """Modules of the repository as a file sees them: the one file of that name, or its neighbour."""

        def find(name: str, level: int) -> tuple[str, str] | None:
            inside = re.sub(r"^.*!/", "", caller)
            ends = name.replace(".", "/")
            if level:
                base = "/".join(inside.split("/")[:-level])
                ends = f"{base}/{ends}".strip("/")
            hits = [p for e in (f"{ends}.py", f"{ends}/__init__.py") for p in self._inner_endings.get(e, ()) if p != caller]
            if len(hits) > 1:
                hits = [p for p in hits if p.rpartition("/")[0] == caller.rpartition("/")[0]]
            return (self.texts[hits[0]], hits[0]) if len(hits) == 1 and ends else None

        return find

    def script(self, path: str) -> str | None:
        """The file of a path as a command names it: itself, or the only one with its longest ending."""
        parts = [p for p in path.split("/") if p not in ("", ".")]
        for i in range(len(parts)):
            end = "/".join(parts[i:])
            if hits := self._endings.get(end):
                return hits[0] if len(hits) == 1 else None
        return None


def _by_ending(paths: Iterable[str], name: Callable[[str], str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for p in paths:
        parts = name(p).split("/")
        for i in range(len(parts)):
            out.setdefault("/".join(parts[i:]), []).append(p)
    return out


class Reader:
    """A reader of source files: `accepts(path, text)` and `read(path, text, context)` -> rows by fact.

    Register an object with these and a `name` to read other kinds of files.
    """

    name = ""

    def accepts(self, path: str, text: str) -> bool:
        raise NotImplementedError

    def read(self, path: str, text: str, context: Context) -> Rows:
        raise NotImplementedError


def job_id_of(path: str) -> str:
    return re.sub(r"\.(py|sql)$", "", path)


def header_of(text: str, python: bool) -> tuple[dict[str, str], str | None]:
    """Key: value lines of the leading comment or docstring, and the first line that describes."""
    lines = None
    if python:
        try:
            doc = ast.get_docstring(ast.parse(text))
            lines = doc.splitlines() if doc else None
        except SyntaxError:
            pass
    if lines is None:
        lines = []
        for raw in text.splitlines():
            if raw.strip() and not raw.strip().startswith(("--", "#")):
                break
            lines.append(raw.strip().lstrip("-# ").strip())
    found: dict[str, str] = {}
    about = None
    for line in lines:
        m = re.match(r"\s*([A-Za-z][A-Za-z _]*):\s*(.+?)\s*$", line)
        if m and m[1].strip().lower() in ("source", "target", "owner", "grain", "schedule", "dependencies", "description"):
            found.setdefault(m[1].strip().lower(), m[2])
        elif line.strip() and about is None:
            about = line.strip()
    return found, found.get("description") or about


def rows_of(result: Result, job_id: str, path: str, language: str, engine: str, text: str, name: str | None = None) -> Rows:
    """A result as rows of all facts about one job."""
    head, about = header_of(text, language != "sql")
    if head.get("schedule"):
        when = [{"id": f"comment.{job_id}", "orchestrator": "cron_comment", "interval_text": head["schedule"], "source_file": path, "line": 1, "job_id": job_id}]
    else:
        when = []
    ids = result.inputs | result.outputs | {e["src"] for e in result.table_edges} | {e["dst"] for e in result.table_edges}
    ref = lambda r: {"dataset": r[0], "column": r[1]}
    return {
        "jobs": [{"job_id": job_id, "name": name or os.path.basename(job_id), "source_file": path, "language": language, "engine": engine, "owner": head.get("owner"), "description": about, "inputs": sorted(result.inputs), "outputs": sorted(result.outputs)}],
        "job_io": [{"job_id": job_id, "dataset_id": x, "direction": d} for d, xs in (("in", result.inputs), ("out", result.outputs)) for x in sorted(xs)],
        "datasets": [{"id": x} for x in sorted(ids)],
        "table_edges": result.table_edges,
        "column_edges": [e | {"sources": [ref(r) for r in e["sources"]], "indirect": [ref(i) | {"role": i[2]} for i in e["indirect"]]} for e in result.column_edges],
        "unresolved": result.unresolved,
        "comment_schedules": when,
    }


class SqlReader(Reader):
    name = "sql"

    def accepts(self, path: str, text: str) -> bool:
        return path.endswith(".sql")

    def read(self, path: str, text: str, context: Context) -> Rows:
        for k, v in context.bindings.items():
            text = re.sub(r"\{\{\s*" + re.escape(k) + r"\s*\}\}|\$\{" + re.escape(k) + r"\}", lambda _, v=v: v, text)
        job = job_id_of(path)
        result = Analysis(context.spark, context.schema, context.sql_engine, context.default_db, job, path).run(text)
        return rows_of(result, job, path, "sql", context.sql_engine, text)


class PythonReader(Reader):
    name = "python"

    def accepts(self, path: str, text: str) -> bool:
        return path.endswith(".py") and not airflow.imports_airflow(text)

    def read(self, path: str, text: str, context: Context) -> Rows:
        found = Inspector(path, job_id_of(path), context.bindings).read(text)
        return self.job(path, text, context, job_id_of(path)) | {"references": found.references}

    def job(self, path: str, text: str, context: Context, job: str) -> Rows:
        i = Interpreter(context.spark, text, job, path, context.schema, context.bindings, context.default_db, context.sql_engine, context.module(path))
        result = i.run()
        if not result.inputs and not result.outputs and not result.unresolved:
            return {}  # a module of helpers is no job
        return rows_of(result, job, path, "python", i.engine, text)


class AirflowReader(Reader):
    name = "airflow"

    def accepts(self, path: str, text: str) -> bool:
        return path.endswith(".py") and airflow.imports_airflow(text)

    def read(self, path: str, text: str, context: Context) -> Rows:
        o = airflow.read(text, path, context.bindings)
        calls = Inspector(path, "", context.bindings).read(text).references
        has_upstream = {b for _, b in o.edges}
        out: Rows = {"schedules": o.schedules, "unresolved": o.unresolved, "references": calls, "task_edges": [{"src": a, "dst": b} for a, b in o.edges]}
        out["tasks"] = [{"task": t.name, "dag_id": t.dag_id, "task_id": t.task_id, "is_root": t.name not in has_upstream, "source_file": path} for t in o.tasks]
        out["external_refs"] = [{"task": t.name, "kind": t.external[0], "dag_id": t.external[1], "task_id": t.external[2]} for t in o.tasks if t.external]
        jobs: list[Rows] = []
        out["task_jobs"] = []
        for t in o.tasks:
            job = None
            if t.script is not None:
                found = context.script(t.script)
                job = job_id_of(found) if found else None
                if found is None:
                    out["unresolved"].append({"kind": "external_job", "reason": f"{t.name}: no file for {t.script}", "line": t.line, "source_file": path, "job_id": ""})
            elif t.function is not None:
                body = airflow.function_source(text, t.function)
                if body is not None:
                    job = t.name
                    jobs.append(PythonReader().job(path, body, context, job))
            elif t.sql is not None:
                job = t.name
                r = Analysis(context.spark, context.schema, t.sql[1], context.default_db, job, path).run(t.sql[0])
                jobs.append(rows_of(r, job, path, "airflow", t.sql[1], "", t.task_id))
            if job is not None:
                out["task_jobs"].append({"task": t.name, "job_id": job})
        for rows in jobs:
            for k, v in rows.items():
                out[k] = out.get(k, []) + v
        return out


READERS: list[Reader] = [SqlReader(), AirflowReader(), PythonReader()]


def with_readers(*more: Reader) -> list[Reader]:
    """The readers and further ones; two of one name are an error."""
    out = [*READERS, *more]
    names = [r.name for r in out]
    if len(set(names)) != len(names):
        raise ValueError(f"readers share a name: {sorted(names)}")
    return out


@dataclass
class Scan:
    """The facts of a repository, each a DataFrame of SCHEMAS, and questions to them."""

    spark: SparkSession
    facts: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["facts"][name]
        except KeyError:
            raise AttributeError(name) from None

    def column_links(self) -> DataFrame:
        """(src, dst, job_id) between columns, named dataset#column, direct and indirect."""
        both = self.column_edges.select(F.concat_ws("#", "target", "target_column").alias("dst"), "job_id", F.explode(F.array_union(F.transform("sources", lambda r: F.concat_ws("#", r["dataset"], r["column"])), F.transform("indirect", lambda r: F.concat_ws("#", r["dataset"], r["column"])))).alias("src"))
        return both.select("src", "dst", "job_id").distinct()

    def impact(self, node: str, direction: str = "downstream", max_depth: int | None = None) -> DataFrame:
        """(node, hop): datasets around a dataset, or columns around a column."""
        links = self.column_links() if "#" in node else self.table_edges
        return impact.hops(links.select("src", "dst"), node, direction, max_depth)

    def owners(self) -> DataFrame:
        return self.datasets.filter("product IS NOT NULL").select(F.col("id").alias("dataset_id"), "product")

    def product_dependencies(self) -> DataFrame:
        seen = products.observed_dependencies(self.job_dependencies.select("job_id", "upstream"), self.jobs.filter("product IS NOT NULL").select("job_id", "product"))
        return products.dependency_status(seen, products.resolve_codes(self.declared, self.products))

    def orchestration_drift(self) -> DataFrame:
        return products.orchestration_drift(self.job_dependencies, self.task_jobs.select("job_id").distinct())

    def summary(self) -> DataFrame:
        return graph.summary(self.column_edges, self.unresolved)

    def references(self) -> DataFrame:
        return self.facts["references"]

    def to_json(self) -> str:
        return exports.document(self.facts)

    def to_catalog(self, prior: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """Columns and scripts of the catalogue, put into a prior one (its columns and scripts) if there is one."""
        columns, scripts = prior or (None, None)
        mine = exports.catalog_scripts(self.jobs, self.job_io, self.job_dependencies)
        return exports.catalog_columns(self.datasets, columns), exports.described_scripts(self.jobs, self.schedules, mine, scripts)

    def to_events(self) -> DataFrame:
        e = self.column_edges
        of = ("job_id", "target", "target_column", "kind", "expression")
        direct = e.select(*of, F.explode("sources").alias("r"), F.lit("direct").alias("role"))
        indirect = e.select(*of, F.explode(F.transform("indirect", lambda r: F.struct(r["dataset"].alias("dataset"), r["column"].alias("column")))).alias("r"), F.lit("indirect").alias("role"))
        refs = direct.unionByName(indirect).select(*of, F.col("r.dataset").alias("source"), F.col("r.column").alias("source_column"), "role")
        return exports.lineage_events(self.jobs, exports.lineage_fields(refs), exports.field_kinds(e), self.datasets)

    def described(self, answers: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
        """(node, description, decision, inherited, prompt): what is said of each written column.

        known: (node, description) as people wrote them; answers: (node, proposed) to the prompts,
        from whoever was asked. Nothing is asked from here. Columns that only copy another take its words.
        """
        node = F.concat_ws("#", "target", "target_column")
        sources = F.transform("sources", lambda r: F.concat_ws("#", r["dataset"], r["column"]))
        e = self.column_edges.select(node.alias("node"), "kind", "expression", sources.alias("sources"), "confidence")
        by = e.groupBy("node").agg(F.min("kind").alias("kind"), F.array_join(F.array_sort(F.collect_set("expression")), "\n").alias("expression"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"), F.bool_and(F.col("confidence") == "exact").alias("complete"), F.count("*").alias("n"))
        none = "node string, {} string"
        rows = by.join(known if known is not None else self.spark.createDataFrame([], none.format("description")), "node", "left")
        rows = rows.join(answers if answers is not None else self.spark.createDataFrame([], none.format("proposed")), "node", "left")
        decided = policy.description_decisions(rows).withColumn("description", F.when(F.col("decision") == "described", F.trim("proposed")).otherwise(F.col("description")))
        copies = decided.filter("kind = 'identity' AND complete AND n = 1 AND size(sources) = 1").select(F.col("sources")[0].alias("src"), F.col("node").alias("dst"))
        words = policy.inherit_descriptions(decided.select("node", "description"), copies)
        return words.join(decided.select("node", "decision"), "node").join(policy.prompts(by.select("node", "kind", "expression", "sources")), "node").select("node", "description", "decision", "inherited", "prompt")

    @property
    def failed(self) -> bool:
        return not self.unresolved.filter("kind = 'unsupported_syntax'").isEmpty()


def _frame(spark: SparkSession, name: str, rows: Iterable[dict], more: str = "") -> DataFrame:
    """Rows as a DataFrame whose size Spark knows, so that it plans joins of small facts as broadcasts."""
    schema = StructType.fromDDL(SCHEMAS[name] + more)
    names = set(schema.fieldNames())
    table = pa.Table.from_pylist([{k: v for k, v in r.items() if k in names} for r in rows], to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def _read(path: str, text: str, context: Context, readers: list[Reader]) -> Rows:
    """A file's rows by all readers that accept it."""
    out: Rows = {}
    for reader in readers:
        try:
            if not reader.accepts(path, text):
                continue
            rows = reader.read(path, text, context)
        except Exception as e:  # one file's failure is a row; the others go on
            rows = {"unresolved": [{"kind": "unsupported_syntax", "source_file": path, "reason": f"{reader.name}: {type(e).__name__}: {e}"[:300], "line": 1, "job_id": job_id_of(path)}]}
        for k, v in rows.items():
            out.setdefault(k, []).extend(v)
    return out


def scan(
    spark: SparkSession,
    path: str | repo.Source,
    schema: Mapping | Callable[[str], list[str] | None] | None = None,
    bindings: Mapping[str, str] | None = None,
    default_db: str | None = None,
    sql_engine: str = "athena",
    readers: Iterable[Reader] | None = None,
    **limits: int,
) -> Scan:
    """Reads a repository, a file, an archive or a Source; nothing in it is imported or run.

    Sources are read by Spark; their texts are parsed on the driver, where Catalyst's parser is.
    All that follows (identity, merging, dependencies, products) are joins over the facts.
    """
    sources = (repo.LocalSource(path, limits) if isinstance(path, str) else path).read(spark)
    found = sorted(sources.collect(), key=lambda r: r["path"])  # source code: megabytes at most
    texts = {r["path"]: r["text"] for r in found if r["text"] is not None}
    columns = schema if callable(schema) else catalogs.lookup(dict(schema) if schema else None)
    context = Context(spark, columns, dict(bindings or {}), default_db, sql_engine, texts)
    all_rows: Rows = {k: [] for k in [*SCHEMAS, "comment_schedules"]}
    all_rows["unresolved"] += [{"kind": "source_unreadable", "source_file": r["path"], "reason": r["problem"], "line": 1, "job_id": ""} for r in found if r["problem"]]
    product_files = {p: t for p, t in texts.items() if os.path.basename(p) in ("product.yaml", "product.yml")}
    good, bad = readable_products(product_files)
    all_rows["unresolved"] += [{"kind": "source_unreadable", "source_file": p, "reason": why, "line": 1, "job_id": ""} for p, why in bad.items()]
    for k, rows in read_products(good).items():
        all_rows[k] += rows
    entries = [(r["path"], r["text"]) for r in found if r["text"] is not None and r["is_entry"]]
    with ThreadPoolExecutor(PARSERS) as pool:  # the parser runs in the JVM, several files at a time
        for rows in pool.map(lambda e: _read(*e, context, list(readers or READERS)), entries):
            for k, v in rows.items():
                all_rows[k] += v
    return assembled(spark, all_rows, sources)


def assembled(spark: SparkSession, rows: Rows, sources: DataFrame | None = None) -> Scan:
    """All facts from readers' rows: merged, named, related."""
    f = {k: _frame(spark, k, rows[k]) for k in SCHEMAS if k not in ("sources", "datasets", "jobs", "schedules")}
    scheme, namespace, name = identity.split_dataset_id(F.col("id"))
    columns = [{"id": e["target"], "columns": [e["target_column"]]} for e in rows["column_edges"]] + [{"id": r["dataset"], "columns": [r["column"]]} for e in rows["column_edges"] for r in e["sources"]]
    raw = _frame(spark, "datasets", rows["datasets"] + columns).withColumn("seq", F.monotonically_increasing_id())
    empty = F.array().cast("array<string>")
    raw = raw.withColumn("aliases", F.coalesce("aliases", empty)).withColumn("columns", F.coalesce("columns", empty))
    merged = graph.merge_datasets(raw)
    # What readers found is known here: without an alias or a task there is nothing to follow.
    if any(r.get("aliases") for r in rows["datasets"]):
        one, many = graph.alias_owners(merged)
        names = graph.canonical_aliases(one)
        rewritten = lambda df, *ends: graph.rewrite(df, names, *ends)
        datasets = graph.merge_datasets(rewritten(merged.withColumn("seq", F.lit(0)), "id"))
    else:
        many, rewritten, datasets = None, (lambda df, *ends: df), merged
    for k, ends in (("table_edges", ("src", "dst")), ("job_io", ("dataset_id",))):
        f[k] = graph.dedup(rewritten(f[k], *ends))
    datasets = datasets.withColumn("namespace", namespace).withColumn("name", name).withColumn("kind", identity.dataset_kind(F.col("id")))
    f["datasets"] = graph.enrich_products(datasets, f["product_databases"])
    when = _frame(spark, "schedules", rows["schedules"] + rows["comment_schedules"])
    f["schedules"] = when.withColumn("cron", cron.normalize_cron(F.col("interval_text")))
    if many is not None:
        f["unresolved"] = f["unresolved"].unionByName(many.select(F.lit("alias_conflict").alias("kind"), F.lit(None).cast("string").alias("source_file"), F.concat(F.lit("claimed by several: "), "alias").alias("reason"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("job_id")))
    jobs = _frame(spark, "jobs", rows["jobs"]).withColumn("seq", F.monotonically_increasing_id())
    jobs = graph.merge_jobs(jobs).drop("product", "schedule_id")
    folders = f["products"].select(F.regexp_replace("source_file", "/?[^/]*$", "").alias("folder"), F.col("code").alias("product"))
    owners = f["datasets"].filter("product IS NOT NULL").select(F.col("id").alias("dataset_id"), "product")
    jobs = jobs.join(graph.job_products(f["job_io"], owners, jobs.select("job_id", "source_file"), folders), "job_id", "left")
    tasks = f["tasks"].join(f["task_jobs"], "task").select("job_id", F.col("dag_id").alias("schedule_id"))
    comments = _frame(spark, "jobs", [{"job_id": r["job_id"], "schedule_id": r["id"]} for r in rows["comment_schedules"]]).select("job_id", "schedule_id")
    of_product = jobs.filter("product IS NOT NULL").select("job_id", F.concat(F.lit("product."), "product", F.lit(".__primary__")).alias("schedule_id")).join(f["schedules"].select(F.col("id").alias("schedule_id")), "schedule_id", "left_semi")
    f["jobs"] = jobs.join(graph.attach_schedules(jobs, tasks, of_product, comments), "job_id", "left")
    deps = graph.data_dependencies(f["job_io"])
    if not rows["task_edges"] and not rows["external_refs"]:
        f["job_dependencies"] = graph.merge_evidence(deps, None)
        return _scanned(spark, f, sources)
    edges, lost = graph.external_references(f["external_refs"], f["tasks"])
    f["task_edges"] = graph.dedup(f["task_edges"].unionByName(edges))
    f["unresolved"] = f["unresolved"].unionByName(lost.select(F.lit("external_job").alias("kind"), F.lit(None).cast("string").alias("source_file"), F.concat_ws(" ", F.lit("no single DAG"), "dag_id").alias("reason"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("job_id")))
    f["job_dependencies"] = graph.merge_evidence(deps, graph.dag_dependencies(f["task_edges"], f["task_jobs"]))
    return _scanned(spark, f, sources)


def _scanned(spark: SparkSession, f: dict[str, DataFrame], sources: DataFrame | None) -> Scan:
    if sources is not None:
        f["modules"] = repo.modules(sources)
    return Scan(spark, f)


def read_native(spark: SparkSession, path: str) -> Scan:
    """A scan that to_json() wrote, from a file of any file system Spark reads.

    Strict: another version, a fact or field that isn't known, a missing fact, or a value of
    another type is an error.
    """
    [text] = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    return Scan(spark, exports.facts_of(spark, text))


def review(scanned: Scan, proposals: DataFrame, shadow: bool = False) -> DataFrame:
    """Proposed column edges judged against the facts; nothing is asked from any service.

    proposals: (id, target, target_column, source, source_column, evidence_ok). Returns them with
    reason, confidence and decision.
    """
    known = scanned.datasets.select(F.col("id").alias("dataset_id"))
    out = policy.judged(proposals, known, scanned.datasets.filter(F.size("columns") > 0).select(F.col("id").alias("dataset_id"), "columns"))
    target = F.concat_ws("#", "target", "target_column")
    existing = scanned.column_edges.select(target.alias("target"), policy.edge_key(target, F.transform("sources", lambda r: F.concat_ws("#", r["dataset"], r["column"]))).alias("key"), "confidence")
    ok = out.filter("reason IS NULL").select("id", target.alias("target"), policy.edge_key(target, F.array(F.concat_ws("#", "source", "source_column"))).alias("key"))
    decided = policy.merge_decisions(ok.select("target", "key"), existing, shadow).distinct()
    return out.join(ok.join(decided.select("key", "decision"), "key").select("id", "decision"), "id", "left").withColumn("decision", F.coalesce("decision", F.lit("rejected")))

