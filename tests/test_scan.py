"""A repository from disk to facts, questions and exports."""

import json
import os
import uuid
import zipfile

import pytest

from spoorline import api
from spoorline.operators import exports
from spoorline.plans.corpus import FILES
from spoorline.sources.products import ProductError, read_products


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    (top / "bad.sql").write_bytes(b"\xff\xfe select")
    (top / "node_modules").mkdir()
    (top / "node_modules/x.sql").write_text("create table n.n as select 1 as a")
    os.symlink(top / "sql/temp.sql", top / "link.sql")
    with zipfile.ZipFile(top / "more.zip", "w") as z:
        z.writestr("z.sql", "create table arch.t as select a from arch.s")
        z.writestr("../evil.sql", "create table e.e as select 1 as a")
    return api.scan(spark, str(top))


def test_sources_and_problems(scanned):
    problems = {r["source_file"]: r["reason"] for r in scanned.unresolved.filter("kind = 'source_unreadable'").collect()}
    assert problems == {"bad.sql": "not UTF-8", "more.zip!/../evil.sql": "unsafe path"}
    jobs = {r["job_id"] for r in scanned.jobs.collect()}
    assert "more.zip!/z" in jobs and not any("node_modules" in j or "link" in j for j in jobs)


def test_facts_relate(scanned):
    rows = {(r["job_id"], r["upstream"]): r["sources"] for r in scanned.job_dependencies.collect()}
    assert rows["sql/revenue", "sql/orders_clean"] == ["dag", "data"]
    assert {(r["node"], r["hop"]) for r in scanned.impact("glue://shop/orders").collect()} == {("glue://stage/orders", 1), ("glue://mart/revenue", 2), ("glue://mart/features", 2)}
    hops = {r["node"]: r["hop"] for r in scanned.impact("glue://shop/orders#amount").collect()}
    assert hops["glue://stage/orders#amount_eur"] == 1 and hops["glue://mart/revenue#revenue"] == 2
    with pytest.raises(KeyError):
        scanned.impact("glue://no/where")
    with pytest.raises(ValueError):
        scanned.impact("glue://shop/orders", max_depth=-1)


def test_exports(scanned, tmp_path):
    assert json.loads(scanned.to_json())["version"] == "1" and scanned.to_json() == scanned.to_json()
    events = {r["job_id"]: json.loads(r["event"]) for r in scanned.to_events().collect()}
    fields = {f["field"]: f["inputFields"] for o in events["sql/revenue"]["outputs"] for f in o["columnLineage"]}
    direct = {(f["namespace"], f["name"], f["field"]): f["transformations"] for f in fields["revenue"]}
    assert [(t["type"], t.get("subtype")) for t in direct["stage", "orders", "amount_eur"]] == [("DIRECT", "AGGREGATION"), ("INDIRECT", None)]
    kinds = {f["field"]: f["transformationType"] for o in events["sql/revenue"]["outputs"] for f in o["columnLineage"]}
    assert kinds == {"order_id": "IDENTITY", "revenue": "AGGREGATION", "place": "WINDOW"}
    assert {(i["namespace"], i["name"]) for i in events["sql/revenue"]["inputs"]} == {("stage", "orders"), ("shop", "customers")}
    assert events["sql/revenue"]["run"]["runId"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "static:sql/revenue"))
    folder = exports.write_artifacts(tmp_path, {"a.json": "{}"}, "r1")
    assert json.loads((folder / "manifest.json").read_text())["files"].keys() == {"a.json"}


def test_review_judges_and_merges(spark, scanned):
    rows = [
        (1, "glue://mart/revenue", "revenue", "glue://stage/orders", "amount_eur", True),
        (2, "glue://mart/features", "total", "glue://stage/orders", "amount_eur", True),
        (3, "glue://mart/revenue", "revenue", "glue://no/where", "x", True),
        (4, "glue://mart/revenue", "revenue", "glue://stage/orders", "status", False),
    ]
    got = {r["id"]: (r["reason"], r["decision"]) for r in api.review(scanned, spark.createDataFrame(rows, "id int, target string, target_column string, source string, source_column string, evidence_ok boolean")).collect()}
    assert got == {1: (None, "unchanged"), 2: (None, "accepted"), 3: ("unknown_source", "rejected"), 4: ("evidence", "rejected")}


def test_plugins_and_products():
    with pytest.raises(ValueError):
        api.with_readers(api.SqlReader())
    with pytest.raises(ProductError):
        read_products({"a/product.yaml": "code: x", "b/product.yaml": "code: x"})
    got = read_products({"p/product.yaml": "product: {code: x, owner: me, databases: [d], dependencies: [{product: y, reads: [t]}], orchestration: {steps: [{name: s, schedule: hourly}]}}"})
    assert got["declared"][0]["depends_on"] == "y" and got["schedules"][0]["id"] == "product.x.s"


def test_saved_scans_come_back(spark, scanned, tmp_path):
    path = tmp_path / "lineage.json"
    path.write_text(scanned.to_json())
    again = api.read_native(spark, str(path))
    assert again.to_json() == scanned.to_json()
    assert {(r["node"], r["hop"]) for r in again.impact("glue://shop/orders").collect()} == {(r["node"], r["hop"]) for r in scanned.impact("glue://shop/orders").collect()}
    doc = json.loads(scanned.to_json())
    for change in ({"version": "2"}, {"more": []}, {"jobs": [{"job_id": 1}]}, {"jobs": [{"jobid": "x"}]}, {"tasks": [{"is_root": "yes"}]}, {"column_edges": [{"sources": [{"table": "x"}]}]}):
        path.write_text(json.dumps(doc | change))
        with pytest.raises(ValueError):
            api.read_native(spark, str(path))
    path.write_text(json.dumps({k: v for k, v in doc.items() if k != "jobs"}))
    with pytest.raises(ValueError):
        api.read_native(spark, str(path))


def test_catalogue_keeps_what_people_wrote(spark):
    columns = "db_name string, db_type string, product string, layer string, table_name string, dataset_id string, field_name string, place int, description string"
    prior = spark.createDataFrame([("mart", "athena", None, "gold", "t", "glue://mart/t", "z", 0, "last letter"), ("mart", "athena", None, "gold", "t", "glue://mart/t", "gone", 1, "kept"), ("mart", "postgres", None, None, "t", "postgres://mart/t", "z", 0, "another"), ("old", "", None, None, "x", None, None, None, None)], columns)
    found = spark.createDataFrame([("glue://mart/t", "table", ["b", "a", "z"], "p", None), ("glue://mart/u", "table", [], None, None), ("frame://a/b", "table", ["c"], None, None), ("s3://b/c", "s3_path", ["c"], None, None), ("mysql://old/x", "table", ["c"], None, None)], "id string, kind string, columns array<string>, product string, layer string")
    got = sorted(map(str, map(tuple, exports.catalog_columns(found, prior).collect())))
    want = [("mart", "athena", "p", "gold", "t", "glue://mart/t", n, i, d) for i, (n, d) in enumerate([("z", "last letter"), ("gone", "kept"), ("a", ""), ("b", "")])]
    want += [("mart", "athena", "p", "gold", "u", "glue://mart/u", None, 0, ""), ("mart", "postgres", None, None, "t", "postgres://mart/t", "z", 0, "another"), ("old", "mysql", None, None, "x", "mysql://old/x", "c", 0, "")]
    assert got == sorted(map(str, want))
    assert exports.catalog_columns(found).count() == 5
    jobs = spark.createDataFrame([("a", "a", "new/a.sql", "sql", "s"), ("b", "b", "b.sql", "sql", None), ("c", "c", "c.sql", "sql", None)], "job_id string, name string, source_file string, language string, schedule_id string")
    scripts = spark.createDataFrame([("a", "", "", "")], "job_id string, reads_from string, writes_to string, depends_on string")
    when = spark.createDataFrame([("s", "@daily")], "id string, interval_text string")
    old = spark.createDataFrame([("a", "a.sql", "of the job"), (None, "b.sql", "of the path"), ("z", "c2.sql", "no more")], "job_id string, script_path string, description string")
    out = {r["job_id"]: (r["description"], r["schedule"]) for r in exports.described_scripts(jobs, when, scripts, old).collect()}
    assert out == {"a": ("of the job", "@daily"), "b": ("of the path", None), "c": ("", None)}


def test_answers_and_copies_describe_columns(spark, scanned):
    asked = scanned.described()
    assert all(r["decision"] in ("missing", "incomplete_lineage") for r in asked.collect())
    answers = spark.createDataFrame([("glue://stage/orders#amount_eur", "The amount in euros."), ("glue://stage/orders#channel", "x"), ("glue://mart/features#total", "Not traced for sure.")], "node string, proposed string")
    known = spark.createDataFrame([("glue://stage/orders#order_id", "Names the order.")], "node string, description string")
    got = {r["node"]: r for r in scanned.described(answers, known).collect()}
    say = lambda n: (got[n]["description"], got[n]["decision"], got[n]["inherited"])
    assert say("glue://stage/orders#amount_eur") == ("The amount in euros.", "described", False)
    assert say("glue://stage/orders#channel") == (None, "invalid", False)
    assert say("glue://mart/features#total")[1] == "incomplete_lineage"
    assert say("glue://mart/revenue#order_id") == ("Names the order.", "missing", True)
    assert json.loads(got["glue://mart/revenue#order_id"]["prompt"])["sources"] == ["glue://stage/orders#order_id"]


def test_commands(spark, tmp_path, capsys):
    from spoorline.__main__ import main

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.sql").write_text("create table m.t as select a from s.t")
    (tmp_path / "src/product.yaml").write_text("code: [")
    assert main(["run", str(tmp_path / "src"), "--out-dir", str(tmp_path / "out")]) == 0
    folder = capsys.readouterr().out.strip()
    saved = f"{folder}/lineage.json"
    problems = [r for r in json.load(open(saved))["unresolved"] if r["kind"] == "source_unreadable"]
    assert [r["source_file"] for r in problems] == ["product.yaml"]
    for args, part in ((["impact", saved, "glue://s/t"], "glue://m/t"), (["describe", saved], "glue://m/t#a"), (["export", saved, "catalog"], "glue://m/t"), (["export", saved, "events"], "COMPLETE"), (["products", saved], "drift"), (["references", saved], "[]"), (["scan", saved], "glue://m/t")):
        assert main(args) == 0
        assert part in capsys.readouterr().out
    assert main(["scan", saved, "--strict"]) == 1


def test_look_ups_by_ending(spark):
    texts = dict.fromkeys(["a/x.sql", "b/x.sql", "b/y.sql", "lib/m.py", "z.zip!/lib/n/__init__.py", "b/m.py", "main.py"], "")
    c = api.Context(spark, lambda _: None, {}, None, "athena", texts)
    assert c.script("/home/b/x.sql") == "b/x.sql" and c.script("x.sql") is None and c.script("./y.sql") == "b/y.sql" and c.script("q.sql") is None
    find = c.module("main.py")
    assert find("lib.n", 0)[1] == "z.zip!/lib/n/__init__.py" and find("m", 0) is None and c.module("lib/q.py")("m", 0)[1] == "lib/m.py" and find("main", 0) is None
    assert c.module("b/q.py")("m", 1)[1] == "b/m.py"


def test_sources_from_elsewhere(spark):
    from spoorline.sources.repo import TextSource

    found = api.scan(spark, TextSource({"b.sql": "create table m.t as select a from s.t", "notes.txt": "x", "product.yaml": "code: p\ndatabases: [m]"}))
    assert [(r["job_id"], r["product"]) for r in found.jobs.collect()] == [("b", "p")]
    assert {r["path"] for r in found.modules.collect()} == set()

    class Two:
        def read(self, spark):
            return TextSource({"a.py": "from lib import load\nload('s.t').write.saveAsTable('m.u')", "lib.py": "def load(n):\n    return spark.table(n)"}).read(spark)

    assert [(r["src"], r["dst"]) for r in api.scan(spark, Two()).table_edges.collect()] == [("glue://s/t", "glue://m/u")]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from spoorline.operators import shared

    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    assert shared.shared_dir(session("spark://h:7077", "hdfs://c/shared/")) == "hdfs://c/shared"
    assert shared.shared_dir(session("local[2]", None)).startswith("file://")
    with pytest.raises(RuntimeError):
        shared.shared_dir(session("spark://h:7077", None))
