"""python -m spoorline run|scan|describe|impact|products|references|export ... : facts of a repository as JSON.

PATH is a repository, a file, an archive, or a saved scan (.json).
"""

from __future__ import annotations

import argparse
import json
import sys

COMMANDS = (
    ("run", "a scan and all its exports, written to a new folder of --out-dir"),
    ("scan", "all facts"),
    ("describe", "prompts for columns without words; with --answers, what becomes of the answers"),
    ("impact", "what lies around a dataset or column"),
    ("products", "product dependencies and drift"),
    ("references", "recognised calls"),
    ("export", "catalogue or lineage events"),
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spoorline")
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in COMMANDS:
        s = sub.add_parser(name, help=about)
        s.add_argument("path")
        s.add_argument("--schema", help="JSON file of tables and columns")
        s.add_argument("--binding", action="append", default=[], metavar="NAME=VALUE")
        s.add_argument("--default-db")
        s.add_argument("--sql-engine", default="athena")
        s.add_argument("--strict", action="store_true", help="exit 1 on any unresolved row")
        if name == "run":
            s.add_argument("--out-dir", default="artifacts")
        if name == "describe":
            s.add_argument("--answers", help="JSON file: words by dataset#column")
        if name == "impact":
            s.add_argument("node")
            s.add_argument("--upstream", action="store_true")
            s.add_argument("--max-depth", type=int)
        if name == "export":
            s.add_argument("format", choices=["catalog", "events"])
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from spoorline.api import read_native, scan
    from spoorline.operators.exports import write_artifacts

    spark = SparkSession.builder.getOrCreate()
    if a.path.endswith(".json"):
        found = read_native(spark, a.path)
    else:
        schema = json.load(open(a.schema)) if a.schema else None
        found = scan(spark, a.path, schema, dict(b.split("=", 1) for b in a.binding), a.default_db, a.sql_engine)
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    events = lambda: "\n".join(r["event"] for r in found.to_events().orderBy("job_id").collect())

    def catalog() -> str:
        columns, scripts = found.to_catalog()
        return json.dumps({"columns": rows(columns.orderBy("db_name", "db_type", "table_name", "place")), "scripts": rows(scripts.orderBy("job_id"))}, indent=1)

    if a.command == "run":
        print(write_artifacts(a.out_dir, {"lineage.json": found.to_json(), "catalog.json": catalog() + "\n", "events.jsonl": events() + "\n"}))
    elif a.command == "scan":
        print(found.to_json(), end="")
    elif a.command == "describe":
        answers = spark.createDataFrame(list(json.load(open(a.answers)).items()), "node string, proposed string") if a.answers else None
        print(json.dumps(rows(found.described(answers).orderBy("node")), indent=1))
    elif a.command == "impact":
        print(json.dumps(rows(found.impact(a.node, "upstream" if a.upstream else "downstream", a.max_depth).orderBy("hop", "node")), indent=1))
    elif a.command == "products":
        print(json.dumps({"dependencies": rows(found.product_dependencies()), "drift": rows(found.orchestration_drift())}, indent=1))
    elif a.command == "references":
        print(json.dumps(rows(found.references()), indent=1))
    else:
        print(catalog() if a.format == "catalog" else events())
    return int(found.failed or a.strict and not found.unresolved.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
