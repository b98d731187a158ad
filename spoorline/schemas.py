"""Schemas of all facts."""

from __future__ import annotations

REF = "struct<dataset: string, column: string>"
SCHEMAS = {
    "sources": "path string, text string, suffix string, archive string, is_entry boolean",
    "datasets": "id string, namespace string, name string, kind string, aliases array<string>, columns array<string>, physical_location string, product string, layer string",
    "jobs": "job_id string, name string, source_file string, language string, engine string, schedule_id string, product string, owner string, description string, inputs array<string>, outputs array<string>",
    "job_io": "job_id string, dataset_id string, direction string",
    "table_edges": "src string, dst string, job_id string, source_file string, line int, confidence string",
    "column_edges": f"target string, target_column string, sources array<{REF}>, indirect array<struct<dataset: string, column: string, role: string>>, kind string, expression string, confidence string, job_id string, source_file string, line_start int, line_end int",
    "unresolved": "kind string, source_file string, reason string, line int, job_id string",
    "schedules": "id string, orchestrator string, dag_id string, task_id string, cron string, interval_text string, owner string, start_date string, catchup boolean, tags array<string>, source_file string, line int",
    "task_edges": "src string, dst string",
    "tasks": "task string, dag_id string, task_id string, is_root boolean, source_file string",
    "task_jobs": "task string, job_id string",
    "external_refs": "task string, kind string, dag_id string, task_id string",
    "products": "code string, name string, domain string, owners array<string>, source_file string",
    "product_databases": "name string, product string, layer string",
    "declared": "product string, depends_on string, tables array<string>",
    "references": "source_file string, line int, callee string, direction string, value string, complete boolean, symbols array<string>, assumptions map<string, string>",
}
#: Facts that follow from others; those that a scan from memory lacks.
DERIVED = {
    "job_dependencies": "job_id string, upstream string, sources array<string>, via array<string>, in_place_writer boolean",
    "modules": "module string, path string",
}
OPTIONAL = frozenset(["sources", "modules"])
CONFIDENCE = ("exact", "inferred", "partial")
LANGUAGES = ("sql", "python", "airflow")
UNRESOLVED = ("dynamic_sql", "dynamic_path", "dynamic_table_name", "dynamic_schedule", "dynamic_control_flow", "missing_schema", "unknown_column", "unsupported_syntax", "external_job", "source_unreadable", "alias_conflict")
