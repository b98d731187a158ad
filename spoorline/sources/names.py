"""Dataset ids of names that are already split, for single names on the driver.

The rules are those of functions.identity, which states them for whole columns.
"""

from __future__ import annotations

import re

from spoorline.functions.identity import ENGINE_SCHEMES, FOLDING_ENGINES

_part = re.compile(r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^.]+')


def table_id(parts: list[str], engine: str, default_db: str | None = None) -> str:
    """The id of a table from its unquoted name parts; folding engines ignore case."""
    folds = engine in FOLDING_ENGINES
    parts = [p.lower() for p in parts] if folds else parts
    db = parts[-2] if len(parts) > 1 else default_db or "default"
    scheme = "glue" if folds else ENGINE_SCHEMES.get(engine, engine or "table")
    return f"{scheme}://{db.lower() if folds else db}/{parts[-1]}"


def dataset_id(name: str, engine: str, default_db: str | None = None, path: bool = False) -> str:
    """The id of a name as written: with a scheme, a path, or a table name with quotes."""
    name = name.strip()
    if "://" in name:
        scheme, rest = name.split("://", 1)
        scheme = scheme.lower()
        return f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}"
    if path or name.startswith("/"):
        return f"file://{name}"
    parts = []
    for p in _part.findall(name):
        p = p.strip()
        if p[:1] in "\"`[" and len(p) > 1:
            parts.append(p[1:-1].replace(p[0] * 2, p[0]))
        else:
            parts.append(p.lower())
    return table_id(parts, engine, default_db)
