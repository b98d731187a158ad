"""Exports of facts: catalogue rows, lineage events, native documents."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, MapType, StringType, StructType
from pyspark.sql.window import Window

from spoorline.functions.identity import ENGINE_SCHEMES, FOLDING_ENGINES, agent_table_name, split_dataset_id
from spoorline.schemas import DERIVED, OPTIONAL, SCHEMAS

VERSION = "1"

# Sub-types of direct dependencies by kind of transformation.
SUBTYPES = {"identity": "IDENTITY", "aggregation": "AGGREGATION"}


def _of_engine(db_type: Column) -> Column:
    """The scheme of ids that a database of that kind has; empty if it says none."""
    kind = F.lower(F.coalesce(db_type, F.lit("")))
    out = kind
    for name, scheme in ENGINE_SCHEMES.items():
        out = F.when(kind == name, F.lit(scheme)).otherwise(out)
    return F.when(kind.isin(*FOLDING_ENGINES), F.lit("glue")).otherwise(out)


def catalog_columns(datasets: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Datasets (id, kind, columns, product, layer) as rows of a catalogue, one for each column:
    (db_name, db_type, product, layer, table_name, dataset_id, field_name, place, description).

    A table without columns has one row with field_name null. prior: rows (db_name, db_type,
    product, layer, table_name, dataset_id, field_name, place, description) of the catalogue as it
    is. Its databases, tables, columns, their order and people's words stay; new columns follow by
    name. Databases of one name are apart by engine; one that names no engine takes the least.
    Frames, and datasets other than tables, have no place in a catalogue.
    """
    scheme, namespace, name = split_dataset_id(F.col("id"))
    mine = datasets.filter("kind = 'table' AND NOT startswith(id, 'frame://')").select(namespace.alias("db_name"), scheme.alias("scheme"), name.alias("table_name"), F.col("id").alias("dataset_id"), F.col("product").alias("new_product"), F.col("layer").alias("new_layer"), F.explode_outer("columns").alias("field_name"))
    if prior is None:
        none = F.lit(None).cast("string")
        prior = mine.select("db_name", F.lit("").alias("db_type"), none.alias("product"), none.alias("layer"), "table_name", "dataset_id", "field_name", F.lit(0).alias("place"), none.alias("description")).limit(0)
    named = prior.withColumn("scheme", _of_engine(F.col("db_type")))
    typed = named.filter("scheme != ''").select("db_name", "scheme").distinct()
    least = mine.select("db_name", "scheme").join(typed, ["db_name", "scheme"], "left_anti").groupBy("db_name").agg(F.min("scheme").alias("adopted"))
    named = named.join(least, "db_name", "left").withColumn("db_type", F.when(F.col("scheme") == "", F.coalesce("adopted", F.lit(""))).otherwise(F.col("db_type")))
    named = named.withColumn("scheme", F.when(F.col("scheme") == "", F.coalesce("adopted", F.lit(""))).otherwise(F.col("scheme"))).drop("adopted")
    key = ["db_name", "scheme", "table_name"]
    # A table's row without a column is dropped where the other side knows columns.
    both = named.select(*key, "field_name", "place", "description").unionByName(mine.select(*key, "field_name", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("description")))
    both = both.groupBy(*key, "field_name").agg(F.min("place").alias("place"), F.max("description").alias("description"))
    of = Window.partitionBy(*key)
    both = both.withColumn("has", F.max(F.col("field_name").isNotNull()).over(of)).filter("field_name IS NOT NULL OR NOT has")
    order = Window.partitionBy(*key).orderBy(F.col("place").asc_nulls_last(), "field_name")
    both = both.withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    ids = named.select(*key, "dataset_id").unionByName(mine.select(*key, "dataset_id")).groupBy(*key).agg(F.max("dataset_id").alias("dataset_id"))
    first = lambda c: F.max(c).alias(c)
    old = named.groupBy("db_name", "scheme").agg(first("db_type"), first("product"), first("layer"))
    new = mine.groupBy("db_name", "scheme").agg(first("new_product"), first("new_layer"))
    dbs = old.join(new, ["db_name", "scheme"], "full")
    dbs = dbs.select("db_name", "scheme", F.coalesce("db_type", "scheme").alias("db_type"), F.coalesce("new_product", "product").alias("product"), F.coalesce("new_layer", "layer").alias("layer"))
    out = both.join(ids, key).join(dbs, ["db_name", "scheme"])
    return out.select("db_name", "db_type", "product", "layer", "table_name", "dataset_id", "field_name", "place", F.coalesce("description", F.lit("")).alias("description"))


def catalog_scripts(jobs: DataFrame, job_io: DataFrame, deps: DataFrame) -> DataFrame:
    """(job_id, reads_from, writes_to, depends_on), each comma-joined and sorted."""
    names = job_io.select("job_id", "direction", agent_table_name(F.col("dataset_id")).alias("name"))
    of = lambda d: F.array_join(F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.col("name")))), ",")
    io = names.groupBy("job_id").agg(of("in").alias("reads_from"), of("out").alias("writes_to"))
    up = deps.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("upstream")), ",").alias("depends_on"))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return jobs.select("job_id").distinct().join(io, "job_id", "left").join(up, "job_id", "left").select("job_id", empty("reads_from"), empty("writes_to"), empty("depends_on"))


def described_scripts(jobs: DataFrame, schedules: DataFrame, scripts: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """catalog_scripts() rows with script_name, script_path, language, the schedule's text, and the
    description that a prior catalogue (job_id, script_path, description) has for the job or, failing
    that, for its path."""
    out = jobs.select("job_id", F.col("name").alias("script_name"), F.col("source_file").alias("script_path"), "language", "schedule_id")
    out = out.join(schedules.select(F.col("id").alias("schedule_id"), F.col("interval_text").alias("schedule")), "schedule_id", "left").drop("schedule_id")
    out = out.join(scripts, "job_id", "left")
    if prior is None:
        return out.withColumn("description", F.lit(""))
    by_job = prior.filter("job_id IS NOT NULL").groupBy("job_id").agg(F.max(F.coalesce("description", F.lit(""))).alias("of_job"))
    by_path = prior.groupBy("script_path").agg(F.max("description").alias("of_path"))
    return out.join(by_job, "job_id", "left").join(by_path, "script_path", "left").withColumn("description", F.coalesce("of_job", "of_path", F.lit(""))).drop("of_job", "of_path")


def lineage_fields(refs: DataFrame) -> DataFrame:
    """Column references -> the transformations that events state, each once:
    (job_id, output, field, input, input_field, type, subtype, description).

    refs: (job_id, target, target_column, source, source_column, role, kind, expression). Indirect
    ones have no subtype.
    """
    sub = F.lit("TRANSFORMATION")
    for kind, name in SUBTYPES.items():
        sub = F.when(F.col("kind") == kind, F.lit(name)).otherwise(sub)
    type_ = F.upper("role")
    return refs.select("job_id", F.col("target").alias("output"), F.col("target_column").alias("field"), F.col("source").alias("input"), F.col("source_column").alias("input_field"), type_.alias("type"), F.when(type_ == "DIRECT", sub).alias("subtype"), F.col("expression").alias("description")).distinct()


def field_kinds(edges: DataFrame) -> DataFrame:
    """Column edges (job_id, target, target_column, kind, expression, line_start) -> for each field
    its transformation: the one kind or MIXED, and all expressions, the last stated first."""
    said = F.transform(F.sort_array(F.collect_list(F.when(F.col("expression") != "", F.struct("line_start", "expression"))), asc=False), lambda x: x["expression"])
    by = edges.groupBy("job_id", F.col("target").alias("output"), F.col("target_column").alias("field")).agg(F.min("kind").alias("a"), F.max("kind").alias("b"), F.array_join(F.array_distinct(said), "\n").alias("said"))
    kind = F.when(F.col("a") == F.col("b"), F.upper("a")).otherwise(F.lit("MIXED"))
    return by.select("job_id", "output", "field", kind.alias("transformationType"), F.when(F.col("said") != "", F.col("said")).alias("transformationDescription"))


def run_id(name: Column) -> Column:
    """A name's version-5 UUID in the URL namespace: the same for every export of the same job."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def lineage_events(jobs: DataFrame, fields: DataFrame, kinds: DataFrame, datasets: DataFrame, namespace: str = "lineage", commit: str = "static") -> DataFrame:
    """(job_id, event): a run event's JSON for each job with its inputs, outputs, schemas and column facets.

    A job's own lists meet in one row, as its event holds them.
    """
    _, ns, name = split_dataset_id(F.col("input"))
    one = fields.groupBy("job_id", "output", "field", "input", "input_field").agg(F.array_sort(F.collect_set(F.struct("type", "subtype", "description"))).alias("transformations"))
    inputs = F.struct(ns.alias("namespace"), name.alias("name"), F.col("input_field").alias("field"), "transformations")
    per_field = one.groupBy("job_id", "output", "field").agg(F.array_sort(F.collect_list(inputs)).alias("inputFields"))
    per_field = kinds.join(per_field, ["job_id", "output", "field"], "left")
    per_field = per_field.withColumn("inputFields", F.coalesce("inputFields", F.array().cast(per_field.schema["inputFields"].dataType)))
    facet = F.struct("field", "inputFields", "transformationType", "transformationDescription")
    per_output = per_field.groupBy("job_id", F.col("output").alias("id")).agg(F.array_sort(F.collect_list(facet)).alias("columnLineage"))
    known = datasets.select("id", F.when(F.size("columns") > 0, F.col("columns")).alias("schema"))
    _, ns, name = split_dataset_id(F.col("id"))

    def side(column: str, facets: bool) -> DataFrame:
        rows = jobs.select("job_id", F.explode(column).alias("id")).join(known, "id", "left")
        if facets:
            rows = rows.join(per_output, ["job_id", "id"], "left")
        row = F.struct(ns.alias("namespace"), name.alias("name"), "schema", *(["columnLineage"] if facets else []))
        return rows.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias(column))

    ins, outs = side("inputs", False), side("outputs", True)
    out = jobs.select("job_id").join(ins, "job_id", "left").join(outs, "job_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    event = F.struct(F.lit("COMPLETE").alias("eventType"), F.lit("1970-01-01T00:00:00Z").alias("eventTime"), F.struct(run_id(F.concat(F.lit(commit + ":"), "job_id")).alias("runId")).alias("run"), F.struct(F.lit(namespace).alias("namespace"), F.col("job_id").alias("name")).alias("job"), none("inputs"), none("outputs"))
    return out.select("job_id", F.to_json(event).alias("event"))


def document(facts: Mapping[str, DataFrame]) -> str:
    """All facts of a scanned repository as one JSON text, the same for the same facts."""
    # One query over all facts: what several of them are made from is computed once.
    rows = reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("fact"), F.to_json(F.struct("*")).alias("row")) for name, df in facts.items()])
    out: dict[str, list[dict]] = {name: [] for name in facts}
    for r in rows.collect():
        out[r["fact"]].append(json.loads(r["row"]))
    for found in out.values():
        found.sort(key=lambda r: json.dumps(r, sort_keys=True))
    return json.dumps({"version": VERSION} | out, sort_keys=True, indent=1, ensure_ascii=False) + "\n"


def facts_of(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The facts of a document() as DataFrames; what doesn't fit their schemas is an error."""
    doc = json.loads(text)
    if not isinstance(doc, dict) or doc.pop("version", None) != VERSION:
        raise ValueError("not a document of this version")
    schemas = {name: StructType.fromDDL(ddl) for name, ddl in (SCHEMAS | DERIVED).items()}
    if odd := (set(doc) - set(schemas)) | (set(schemas) - OPTIONAL - set(doc)):
        raise ValueError(f"facts unknown or missing: {sorted(odd)}")
    out = {}
    for name, rows in doc.items():
        if odd := {k for r in rows for k in r} - set(schemas[name].fieldNames()):
            raise ValueError(f"{name} has no {sorted(odd)}")
        out[name] = spark.createDataFrame([tuple(_typed(r.get(f.name), f.dataType, f"{name}.{f.name}") for f in schemas[name].fields) for r in rows], schemas[name])
    return out


def _typed(value: object, kind: DataType, where: str) -> object:
    """A value of JSON as the type asks; rows are dictionaries there and tuples here."""
    if value is None:
        return None
    match kind:
        case ArrayType() if isinstance(value, list):
            return [_typed(v, kind.elementType, where) for v in value]
        case MapType() if isinstance(value, dict):
            return {k: _typed(v, kind.valueType, where) for k, v in value.items()}
        case StructType() if isinstance(value, dict) and set(value) <= set(kind.fieldNames()):
            return tuple(_typed(value.get(f.name), f.dataType, f"{where}.{f.name}") for f in kind.fields)
        case StringType() if isinstance(value, str):
            return value
        case BooleanType() if isinstance(value, bool):
            return value
        case IntegerType() if isinstance(value, int) and not isinstance(value, bool):
            return value
    raise ValueError(f"{where}: {value!r} is no {kind.simpleString()}")


def write_artifacts(folder: str | Path, files: Mapping[str, str], run: str | None = None) -> Path:
    """Writes files to a new folder of their own; the manifest with their digests comes last."""
    top = Path(folder)
    name = run or uuid.uuid4().hex
    new = top / f".{name}.tmp"
    new.mkdir(parents=True)
    digests = {}
    for k, text in sorted(files.items()):
        (new / k).write_text(text, encoding="utf-8")
        digests[k] = hashlib.sha256(text.encode()).hexdigest()
    (new / "manifest.json").write_text(json.dumps({"files": digests}, sort_keys=True, indent=1) + "\n")
    os.replace(new, top / name)
    return top / name
