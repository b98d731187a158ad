"""Dataset identity: canonical ids of tables, paths and services, as column expressions.

An id is scheme://namespace/name. Names with a scheme keep their path; names from SQL are split at
dots outside quotes, and the engine decides scheme and letter case. Everything is a built-in
expression, so identity is computed inside the scan's code stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Engines whose catalogs fold names, schemes of the other engines, kinds by scheme.
FOLDING_ENGINES = ("athena", "spark", "glue", "trino", "presto", "hive")
ENGINE_SCHEMES = {"postgres": "postgres", "mysql": "mysql", "redshift": "redshift", "snowflake": "snowflake", "sqlite": "sqlite"}
SCHEME_KINDS = {"s3": "s3_path", "api": "api", "http": "api", "https": "api", "kafka": "kafka", "kinesis": "kinesis", "file": "file"}

_PART = r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^.]+'


def _scheme(name: Column) -> Column:
    s = F.lower(F.substring_index(name, "://", 1))
    return F.when(s.isin("s3a", "s3n"), F.lit("s3")).otherwise(s)


def _unquoted(part: Column) -> Column:
    """A name part without its quotes; doubled quotes inside stand for one."""
    first = F.substring(part, 1, 1)
    inner = F.substr(part, F.lit(2), F.greatest(F.char_length(part) - 2, F.lit(0)))
    return F.when(first == '"', F.replace(inner, F.lit('""'), F.lit('"'))).when(first == "`", F.replace(inner, F.lit("``"), F.lit("`"))).when(first == "[", inner).otherwise(part)


def normalize_dataset_id(name: Column, engine: Column | str = "spark", default_db: Column | str | None = None) -> Column:
    """The canonical id of a table or path name under an engine; null stays null."""
    engine = F.lit(engine) if isinstance(engine, str) else engine
    default_db = F.lit(default_db) if default_db is None or isinstance(default_db, str) else default_db
    trimmed = F.trim(name)
    folds = engine.isin(*FOLDING_ENGINES)
    known = F.lit(None).cast("string")
    for k, v in ENGINE_SCHEMES.items():
        known = F.when(engine == k, F.lit(v)).otherwise(known)
    scheme = F.when(folds, F.lit("glue")).otherwise(F.coalesce(known, F.when(engine != "", engine), F.lit("table")))
    parts = F.transform(F.regexp_extract_all(trimmed, F.lit(_PART), F.lit(0)), lambda p: F.trim(p))
    quoted = lambda p: F.substring(p, 1, 1).isin('"', "`", "[")
    cased = F.transform(parts, lambda p: F.when(folds | ~quoted(p), F.lower(_unquoted(p))).otherwise(_unquoted(p)))
    n = F.size(cased)
    db = F.coalesce(F.when(default_db != "", default_db), F.lit("default"))
    namespace = F.when(n >= 2, F.get(cased, n - 2)).otherwise(F.when(folds, F.lower(db)).otherwise(db))
    table = F.concat(scheme, F.lit("://"), namespace, F.lit("/"), F.get(cased, n - 1))
    rest = F.substr(trimmed, F.locate("://", trimmed) + 3)
    return F.when(F.locate("://", trimmed) > 0, F.concat(_scheme(trimmed), F.lit("://"), rest)).when(trimmed.startswith("/"), F.concat(F.lit("file://"), trimmed)).otherwise(table)


def split_dataset_id(dataset_id: Column) -> tuple[Column, Column, Column]:
    """scheme, namespace (database or bucket), name (table or path) of a canonical id."""
    rest = F.substr(dataset_id, F.locate("://", dataset_id) + 3)
    namespace = F.substring_index(rest, "/", 1)
    return F.substring_index(dataset_id, "://", 1), namespace, F.when(F.locate("/", rest) > 0, F.substr(rest, F.char_length(namespace) + 2)).otherwise(F.lit(""))


def dataset_kind(dataset_id: Column) -> Column:
    scheme = F.substring_index(dataset_id, "://", 1)
    out = F.lit("table")
    for k, v in SCHEME_KINDS.items():
        out = F.when(scheme == k, F.lit(v)).otherwise(out)
    return F.when(F.locate("://", dataset_id) > 0, out).otherwise(F.lit("unknown"))


def agent_table_name(dataset_id: Column) -> Column:
    """namespace.name of tables; other datasets keep their id."""
    _, namespace, name = split_dataset_id(dataset_id)
    return F.when(dataset_kind(dataset_id) == "table", F.concat_ws(".", namespace, name)).otherwise(dataset_id)
