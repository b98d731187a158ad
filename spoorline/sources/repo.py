"""Repositories as tables of source texts: folders, single files and archives; modules by name."""

from __future__ import annotations

import io
import os
import stat
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Folders that hold no sources, and what is read.
SKIPPED = (".git", ".venv", "venv", "node_modules", "__pycache__", "build", "dist")
SUFFIXES = (".py", ".sql", ".yaml", ".yml", ".zip")
MAX_FILE, MAX_ARCHIVE, MAX_MEMBERS = 5_000_000, 50_000_000, 2000
ROW = "path string, text string, suffix string, archive string, is_entry boolean, problem string"


def member_problem(info: zipfile.ZipInfo, seen: set[str], max_file: int = MAX_FILE) -> str | None:
    """Why an archive's member isn't read."""
    name = info.filename
    if name.startswith("/") or "\\" in name or ":" in name or ".." in name.split("/"):
        return "unsafe path"
    if stat.S_ISLNK(info.external_attr >> 16):
        return "symbolic link"
    if name in seen:
        return "duplicate member"
    return "too large" if info.file_size > max_file else None


def _texts(max_file: int, max_archive: int, max_members: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, content, size, entry in zip(pdf["path"], pdf["content"], pdf["length"], pdf["is_entry"]):
                suffix = os.path.splitext(path)[1]
                if suffix != ".zip":
                    rows.append(_row(path, content, suffix, None, entry, "too large" if size > max_file else None))
                    continue
                try:
                    if size > max_archive:
                        raise zipfile.BadZipFile("too large")
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    infos = [i for i in archive.infolist() if not i.is_dir()]
                    if len(infos) > max_members:
                        raise zipfile.BadZipFile("too many members")
                except zipfile.BadZipFile as e:
                    rows.append((path, None, suffix, None, entry, f"archive: {e}"))
                    continue
                seen: set[str] = set()
                for i in sorted(infos, key=lambda i: i.filename):
                    ending = os.path.splitext(i.filename)[1]
                    problem = member_problem(i, seen, max_file)
                    seen.add(i.filename)
                    if problem or ending in SUFFIXES[:4]:
                        rows.append(_row(f"{path}!/{i.filename}", b"" if problem else archive.read(i), ending, path, entry, problem))
            yield pd.DataFrame(rows, columns=["path", "text", "suffix", "archive", "is_entry", "problem"])

    return run


def _row(path: str, content: bytes, suffix: str, archive: str | None, entry: bool, problem: str | None) -> tuple:
    text = None
    if problem is None:
        try:
            text = content.decode("utf-8")
        except UnicodeDecodeError:
            problem = "not UTF-8"
    return path, text, suffix, archive, entry, problem


def read_repository(spark: SparkSession, root: str, max_file: int = MAX_FILE, max_archive: int = MAX_ARCHIVE, max_members: int = MAX_MEMBERS) -> DataFrame:
    """ROW for each source below root; for a single file its siblings too, which are no entries.

    Files are read by Spark's binary reader, so any store that Spark reads will do. On the local
    disk symbolic links are left out.
    """
    local = root.removeprefix("file://")
    single = os.path.splitext(root)[1] in SUFFIXES
    top = os.path.dirname(root) if single else root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,sql,yaml,yml,zip}").load(top)
    full = F.regexp_replace("path", "^file:/+", "/")
    prefix = top.removeprefix("file://").rstrip("/") + "/"
    rel = F.when(full.startswith(prefix), F.substr(full, F.lit(len(prefix) + 1))).otherwise(full)
    skipped = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    entry = (F.col("path") == os.path.basename(root)) | F.col("path").startswith(os.path.basename(root) + "!/") if single else F.lit(True)
    rows = files.select(rel.alias("path"), F.when(F.col("length") <= max(max_file, max_archive), F.col("content")).alias("content"), "length").filter(~F.col("path").rlike(skipped)).withColumn("is_entry", entry)
    out = rows.select("path", F.coalesce("content", F.lit(b"")).alias("content"), "length", "is_entry").mapInPandas(_texts(max_file, max_archive, max_members), ROW)
    if os.path.isdir(prefix) and not local.startswith("viewfs"):
        links = [os.path.relpath(os.path.join(d, n), prefix) for d, subs, names in os.walk(prefix) for n in subs + names if os.path.islink(os.path.join(d, n))]
        for link in links:
            out = out.filter((F.col("path") != link) & ~F.col("path").startswith(link + "/"))
    return out


class Source(Protocol):
    """Where a scan takes its sources from; a store of another kind needs only this."""

    def read(self, spark: SparkSession) -> DataFrame:
        """ROW for each source."""


@dataclass(frozen=True)
class LocalSource:
    """A folder, file or archive of any file system that Spark reads."""

    path: str
    limits: Mapping[str, int] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        return read_repository(spark, self.path, **self.limits)


@dataclass(frozen=True)
class TextSource:
    """Texts by path, from memory: what a client of some service has fetched."""

    texts: Mapping[str, str]

    def read(self, spark: SparkSession) -> DataFrame:
        rows = [(p, t, os.path.splitext(p)[1], None, True, None) for p, t in self.texts.items() if os.path.splitext(p)[1] in SUFFIXES[:4]]
        return spark.createDataFrame(rows, ROW)


def modules(sources: DataFrame) -> DataFrame:
    """(module, path): every dotted ending of a Python file's path."""
    py = sources.filter("suffix = '.py' AND text IS NOT NULL")
    inner = F.regexp_replace(F.regexp_replace("path", r"^.*!/", ""), r"(/__init__)?\.py$", "")
    parts = F.split(inner, "/")
    return py.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("module"))


def resolve_modules(names: DataFrame, known: DataFrame) -> DataFrame:
    """(caller, module) -> (caller, module, path): the one file of that name, else the one in the caller's folder."""
    met = names.join(known, "module")
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    by = Window.partitionBy("caller", "module")
    met = met.withColumn("n", F.count("*").over(by)).withColumn("near", (folder(F.col("path")) == folder(F.col("caller"))).cast("int")).withColumn("n_near", F.sum("near").over(by))
    return met.filter("n = 1 OR (near = 1 AND n_near = 1)").select("caller", "module", "path")


def script_paths(names: DataFrame, sources: DataFrame) -> DataFrame:
    """(script) -> (script, path): the file of that path, or of its shortest ending that one file alone has."""
    parts = F.split("path", "/")
    ends = sources.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("ending"))
    sole = ends.groupBy("ending").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1")
    want = F.split("script", "/")
    asked = names.select("script", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(want)), lambda i: F.array_join(F.slice(want, i, F.size(want)), "/"))).alias("cut", "ending"))
    return asked.join(sole, "ending").groupBy("script").agg(F.min_by("path", "cut").alias("path"))
