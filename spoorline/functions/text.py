"""Text functions of the event log and the policies: redaction, digests, globs, templates, headers."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys whose values are never logged, what stands for them, and the patterns of
# credentials in urls, authorization headers and named secrets.
SENSITIVE_KEYS = (
    "authorization",
    "password",
    "passwd",
    "secret",
    "token",
    "access_token",
    "refresh_token",
    "api_key",
    "anthropic_api_key",
    "extra_headers",
    "aws_access_key_id",
    "aws_secret_access_key",
    "aws_session_token",
    "github_token",
    "gh_token",
    "cookie",
    "set-cookie",
    "headers",
    "source_text",
    "prompt",
    "response",
    "body",
    "expression",
    "bindings",
    "traceback",
    "exception_message",
)
REDACTED, CUT, TOO_DEEP = "[redacted]", "[truncated]", "[depth-limit]"
# Letters and blanks are Unicode's; both engines' own classes know ASCII alone.
URL_CREDENTIALS = r"(?i)(^|[^\p{L}\p{N}_])([a-z][a-z0-9+.-]*://)[^\s\p{Z}/@]+:[^\s\p{Z}/@]+@"
AUTHORIZATION = r"(?i)(^|[^\p{L}\p{N}_])(bearer|basic)[\s\p{Z}]+[^\s\p{Z},;]+"
NAMED_SECRET = r"(?i)((?:password|secret|token|api[_-]?key|access[_-]?key)[\p{L}\p{N}_-]*[\s\p{Z}]*[=:][\s\p{Z}]*)[^\s\p{Z}&,;]+"
LONGEST_TEXT, LONGEST_LIST, DEEPEST = 2000, 100, 8
HEADER_KEYS = ("source", "target", "owner", "grain", "schedule", "dependencies", "description")


def redact(text: Column) -> Column:
    """Credentials in urls, authorization values and key=value secrets become [redacted]."""
    out = F.regexp_replace(text, URL_CREDENTIALS, f"$1$2{REDACTED}@")
    out = F.regexp_replace(out, AUTHORIZATION, f"$1$2 {REDACTED}")
    return F.regexp_replace(out, NAMED_SECRET, f"$1{REDACTED}")


def redact_sql(column: str) -> str:
    """The same in DuckDB's notation."""
    return rf"""regexp_replace(regexp_replace(regexp_replace({column}, '{URL_CREDENTIALS}', '\1\2{REDACTED}@', 'g'), '{AUTHORIZATION}', '\1\2 {REDACTED}', 'g'), '{NAMED_SECRET}', '\1{REDACTED}', 'g')"""


def redact_value(key: Column, value: Column, depth: int = 0) -> Column:
    """The value of a field, hidden altogether under a sensitive key or below the deepest level."""
    if depth > DEEPEST:
        return F.lit(TOO_DEEP)
    return F.when(F.lower(key).isin(*SENSITIVE_KEYS), F.lit(REDACTED)).otherwise(truncate(redact(value)))


def truncate(text: Column, longest: int = LONGEST_TEXT) -> Column:
    return F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit(CUT))).otherwise(text)


def first_of_list(items: Column, most: int = LONGEST_LIST) -> tuple[Column, Column]:
    """The first items of a list, and how many were left out."""
    return F.slice(items, 1, most), F.greatest(F.size(items) - most, F.lit(0))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: * and ? within a name too, ** across folders."""
    out = []
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part)))
    return "^" + "".join(out) + "$"


def in_scope(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a path is included and not excluded; no globs include everything."""
    any_of = lambda globs: path.rlike("|".join(map(glob_pattern, globs)))
    inside = any_of(include) if include else F.lit(True)
    return inside & ~any_of(exclude) if exclude else inside


def bind_templates(text: Column, bindings: Mapping[str, str]) -> Column:
    """{{ name }} and ${name} replaced by their values."""
    for name, value in sorted(bindings.items()):
        key = re.escape(name)
        text = F.regexp_replace(text, r"\{\{\s*" + key + r"\s*\}\}|\$\{" + key + r"\}", value.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def template_holes(text: Column) -> Column:
    """The names of placeholders that are still there."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{[^}]*\}\}|\$\{[^}]*\}|\{%[^%]*%\}"), F.lit(0)))


def header(text: Column) -> Column:
    """Key: value lines of the comment block that a text begins with, as a map; the first value counts."""
    block = F.regexp_extract(text, r"^((?:[ \t]*(?:--|#)[^\n]*(?:\n|$)|[ \t]*\n)*)", 1)
    lines = F.transform(F.split(block, "\n"), lambda x: F.regexp_extract(x, r"^\s*(?:--|#)[-# ]*(.*?)\s*$", 1))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([A-Za-z][A-Za-z _]*):\s*(.+)$", 1))).alias("key"), F.regexp_extract(x, r"^([A-Za-z][A-Za-z _]*):\s*(.+)$", 2).alias("value")))
    known = F.filter(pairs, lambda p: p["key"].isin(*HEADER_KEYS))
    first = F.filter(known, lambda p, i: ~F.exists(F.slice(known, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


def valid_repository_url(url: Column) -> Column:
    """https://host/owner/name, without credentials, query or fragment."""
    return url.rlike(r"^https://[A-Za-z0-9.-]+/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?(?:\.git)?/?$") & ~url.contains("..")


def valid_gateway_url(url: Column) -> Column:
    """https anywhere, http on the own machine only; no credentials."""
    return url.rlike(r"^https://[^/@\s?#]+(/[^\s?#]*)?$") | url.rlike(r"^http://(localhost|127\.0\.0\.1|\[::1\])(:[0-9]+)?(/[^\s?#]*)?$")


def valid_header(name: Column, value: Column) -> Column:
    return name.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$") & ~value.rlike(r"[\r\n\x00]")
