"""Columns of tables from catalogue files or Spark's own catalogue."""

from __future__ import annotations

from pyspark.sql import SparkSession


def from_mapping(tables: dict) -> dict[str, list[str]]:
    """{db: {table: [columns]}} or a catalogue document -> columns by lower-case db.table."""
    if not isinstance(tables, dict):
        raise ValueError("a schema is a mapping")
    out: dict[str, list[str]] = {}
    if isinstance(tables.get("databases"), list):
        for db in tables["databases"]:
            for t in db.get("tables", []):
                out[f"{db['db_name']}.{t['table_name']}".lower()] = [c["field_name"] for c in t.get("schema", [])]
        return out
    for db, content in tables.items():
        if not isinstance(content, dict):
            raise ValueError(f"{db}: tables must be a mapping")
        for t, columns in content.items():
            if not isinstance(columns, list) or not all(isinstance(c, str) for c in columns):
                raise ValueError(f"{db}.{t}: columns must be a list of names")
            out[f"{db}.{t}".lower()] = list(columns)
    return out


def lookup(tables: dict | None):
    """A function from dataset ids to columns, or None where they aren't known."""
    known = from_mapping(tables) if tables else {}

    def columns(ident: str) -> list[str] | None:
        rest = ident.split("://", 1)[-1]
        return known.get(rest.replace("/", ".", 1).lower())

    return columns


def spark_catalog(spark: SparkSession):
    """Columns from the session's catalogue, asked once for each table."""
    seen: dict[str, list[str] | None] = {}

    def columns(ident: str) -> list[str] | None:
        if ident not in seen:
            scheme, rest = ident.split("://", 1)
            name = rest.replace("/", ".", 1)
            ok = scheme == "glue" and spark.catalog.tableExists(name)
            seen[ident] = list(dict.fromkeys(c.name for c in spark.catalog.listColumns(name))) if ok else None
        return seen[ident]

    return columns

