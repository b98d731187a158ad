"""The calls that read, write or hold SQL, as a table; matched by the longest dotted ending."""

from __future__ import annotations

from dataclasses import dataclass

# Callee ending, direction, argument (place or keyword), its keyword, keyword of
# the namespace, scheme, engine, dialect.
CALLS: tuple[tuple[str, str, int | str, str, str, str, str, str], ...] = (
    ("spark.table", "read", 0, "tableName", "", "table", "spark", "spark"),
    ("read.table", "read", 0, "tableName", "", "table", "spark", "spark"),
    ("read.parquet", "read", 0, "path", "", "path", "spark", "spark"),
    ("read.csv", "read", 0, "path", "", "path", "spark", "spark"),
    ("read.json", "read", 0, "path", "", "path", "spark", "spark"),
    ("read.orc", "read", 0, "path", "", "path", "spark", "spark"),
    ("read.text", "read", 0, "path", "", "path", "spark", "spark"),
    ("load", "read", 0, "path", "", "path", "spark", "spark"),
    ("spark.sql", "sql", 0, "sqlQuery", "", "sql", "spark", "spark"),
    ("write.saveAsTable", "write", 0, "name", "", "table", "spark", "spark"),
    ("saveAsTable", "write", 0, "name", "", "table", "spark", "spark"),
    ("insertInto", "write", 0, "tableName", "", "table", "spark", "spark"),
    ("write.parquet", "write", 0, "path", "", "path", "spark", "spark"),
    ("write.csv", "write", 0, "path", "", "path", "spark", "spark"),
    ("write.json", "write", 0, "path", "", "path", "spark", "spark"),
    ("write.orc", "write", 0, "path", "", "path", "spark", "spark"),
    ("save", "write", 0, "path", "", "path", "spark", "spark"),
    ("create_dynamic_frame.from_catalog", "read", "table_name", "", "database", "table", "spark", "spark"),
    ("write_dynamic_frame.from_catalog", "write", "table_name", "", "database", "table", "spark", "spark"),
    ("pd.read_sql", "sql", 0, "sql", "", "sql", "pandas", ""),
    ("pd.read_sql_query", "sql", 0, "sql", "", "sql", "pandas", ""),
    ("pd.read_sql_table", "read", 0, "table_name", "schema", "table", "pandas", ""),
    ("pd.read_csv", "read", 0, "filepath_or_buffer", "", "path", "pandas", ""),
    ("pd.read_parquet", "read", 0, "path", "", "path", "pandas", ""),
    ("pd.read_json", "read", 0, "path_or_buf", "", "path", "pandas", ""),
    ("pd.read_excel", "read", 0, "io", "", "path", "pandas", ""),
    ("to_sql", "write", 0, "name", "schema", "table", "pandas", ""),
    ("to_csv", "write", 0, "path_or_buf", "", "path", "pandas", ""),
    ("to_parquet", "write", 0, "path", "", "path", "pandas", ""),
    ("to_json", "write", 0, "path_or_buf", "", "path", "pandas", ""),
    ("pl.read_parquet", "read", 0, "source", "", "path", "polars", ""),
    ("pl.scan_parquet", "read", 0, "source", "", "path", "polars", ""),
    ("pl.read_csv", "read", 0, "source", "", "path", "polars", ""),
    ("pl.scan_csv", "read", 0, "source", "", "path", "polars", ""),
    ("pl.read_database", "sql", 0, "query", "", "sql", "polars", ""),
    ("write_parquet", "write", 0, "file", "", "path", "polars", ""),
    ("sink_parquet", "write", 0, "path", "", "path", "polars", ""),
    ("write_csv", "write", 0, "file", "", "path", "polars", ""),
    ("start_query_execution", "sql", "QueryString", "", "", "sql", "athena", "trino"),
    ("get_object", "read", "Key", "", "Bucket", "s3_object", "s3", ""),
    ("download_file", "read", "Key", "", "Bucket", "s3_object", "s3", ""),
    ("put_object", "write", "Key", "", "Bucket", "s3_object", "s3", ""),
    ("upload_file", "write", "Key", "", "Bucket", "s3_object", "s3", ""),
    ("upload_fileobj", "write", "Key", "", "Bucket", "s3_object", "s3", ""),
    ("wr.athena.read_sql_query", "sql", 0, "sql", "", "sql", "athena", "trino"),
    ("wr.athena.read_sql_table", "read", 0, "table", "database", "table", "athena", "trino"),
    ("wr.s3.read_parquet", "read", 0, "path", "", "path", "athena", ""),
    ("wr.s3.read_csv", "read", 0, "path", "", "path", "athena", ""),
    ("wr.s3.to_parquet", "write", "path", "", "", "path", "athena", ""),
    ("wr.s3.to_csv", "write", "path", "", "", "path", "athena", ""),
    ("cursor.execute", "sql", 0, "operation", "", "sql", "unknown", ""),
    ("cur.execute", "sql", 0, "operation", "", "sql", "unknown", ""),
    ("execute", "sql", 0, "", "", "sql", "unknown", ""),
    ("executemany", "sql", 0, "", "", "sql", "unknown", ""),
    ("text", "sql", 0, "", "", "sql", "unknown", ""),
)
# What in a connection's URL or driver tells its engine; short names of modules.
ENGINE_HINTS = (
    ("postgres", ("postgresql", "postgres", "psycopg2", "psycopg")),
    ("mysql", ("pymysql", "mysql")),
    ("athena", ("awsathena", "pyathena", "trino", "presto")),
    ("sqlite", ("sqlite",)),
    ("redshift", ("redshift",)),
    ("snowflake", ("snowflake",)),
)
MODULE_ALIASES = {"pandas": "pd", "polars": "pl", "awswrangler": "wr"}
#: Endings that many other objects have too: they count on a connection, or with text that is SQL.
BROAD = frozenset(["execute", "executemany", "text", "load", "save"])


@dataclass(frozen=True)
class Sink:
    callee: str
    direction: str
    arg: int | str
    keyword: str
    namespace: str
    scheme: str
    engine: str
    dialect: str


SINKS: tuple[Sink, ...] = tuple(Sink(*x) for x in CALLS)
_by_callee = {s.callee: s for s in SINKS}


def match(callee: str) -> Sink | None:
    """The sink with the longest ending of a dotted name."""
    parts = callee.split(".")
    return next((s for i in range(len(parts)) if (s := _by_callee.get(".".join(parts[i:])))), None)


def engine_of_url(url: str) -> str:
    low = url.lower()
    return next((engine for engine, words in ENGINE_HINTS if any(w in low for w in words)), "unknown")
