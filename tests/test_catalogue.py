"""Every query of the engine against DuckDB on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    return round(float(v), 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not re.match(r"op[0-9]+_|pipeline$", n)))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(str(plain(r[c])) for c in columns) for r in got.collect())
    names = want.columns
    other = sorted(tuple(str(plain(r[names.index(c)])) for c in columns) for r in want.fetchall())
    assert rows == other and rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["node", "hop"]


def test_all_lines_are_read(spark, tmp_path):
    lines = [(1, 1, 10, 1, "A", 50.0), (1, 2, 10, 2, "A", 50.0), (1, 3, 10, 3, "A", 50.0)]
    columns = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double"
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    q = entry.queries()
    got = {name: [tuple(r) for r in q[name](spark, str(tmp_path)).collect()] for name in ("alias_owners", "edge_set_compare", "proposal_merge_decisions")}
    assert got["alias_owners"] == [("p:10", 3, "s:1,s:2,s:3")]
    assert got["edge_set_compare"] == [("p10<-s1,s2,s3", "agreed")]
    assert got["proposal_merge_decisions"] == [("p10", "p10<-s1,s2,s3", "unchanged")]


def test_descriptions_reach_any_distance(spark):
    from spoorline.operators import policy

    nodes = [(0, "d")] + [(i, None) for i in range(1, 151)] + [(200, None), (201, None), (300, "e"), (301, None)]
    copies = [(i - 1, i) for i in range(1, 151)] + [(200, 201), (201, 200), (0, 301), (300, 301)]
    got = policy.inherit_descriptions(spark.createDataFrame(nodes, "node long, description string"), spark.createDataFrame(copies, "src long, dst long"))
    want = {(0, "d", False), (200, None, False), (201, None, False), (300, "e", False), (301, None, False)} | {(i, "d", True) for i in range(1, 151)}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_facts_of_one_seq_do_not_depend_on_the_order_of_rows(spark):
    from spoorline.operators import graph

    rows = [("t", [], [], None, p, None, 5) for p in ("A", "R")] + [("t", [], [], None, "Z", None, 6), ("t", [], [], None, None, None, 1)]
    columns = "id string, aliases array<string>, columns array<string>, physical_location string, product string, layer string, seq long"
    jobs = [("j", [], [], f, 5) for f in ("a.sql", "r.sql")]
    for turn in (1, -1):
        got = graph.merge_datasets(spark.createDataFrame(rows[::turn], columns).coalesce(1)).collect()
        assert [r["product"] for r in got] == ["A"]
        got = graph.merge_jobs(spark.createDataFrame(jobs[::turn], "job_id string, inputs array<string>, outputs array<string>, source_file string, seq long").coalesce(1)).collect()
        assert [r["source_file"] for r in got] == ["a.sql"]


def test_dag_dependencies_keep_jobs_and_not_pairs_of_tasks(spark, monkeypatch):
    from spoorline.operators import graph

    layers = [[f"{a}{i}" for i in range(30)] for a in "abc"]
    edges = [(x, y) for up, down in zip(layers, layers[1:]) for x in up for y in down] + [("p", "q"), ("q", "p"), ("q", "r")]
    jobs = [(x, f"job:{x[0]}") for x in layers[0] + layers[2]] + [("p", "job:p"), ("r", "job:r"), ("r", None)]
    kept = []
    settled = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    frames = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(jobs, "task string, job_id string")
    got = {tuple(r) for r in graph.dag_dependencies(*frames).collect()}
    assert got == {("job:c", "job:a"), ("job:r", "job:p")}
    assert max(df.count() for df in kept[1:]) <= 4 * 93  # jobs times tasks; pairs of tasks are 2,700 and more
    assert sum(df.count() for df in kept[1:]) <= 4 * 93
    assert not graph.dag_dependencies(*frames, max_depth=1).collect()


def test_data_dependencies_tell_both_ways_from_one_row(spark):
    from spoorline.operators import graph

    io = [("w", "d", "out"), ("w", "d", "out"), ("x", "d", "out"), ("x", "d", "in"), ("r", "d", "in"), (None, "d", "out"), (None, "d", "in"), ("w", None, "out"), ("w", None, "in"), ("r", None, "in")]
    got = {tuple(map(str, r)) for r in graph.data_dependencies(spark.createDataFrame(io, "job_id string, dataset_id string, direction string")).collect()}
    assert got == {("r", "w", "['d']", "False"), ("x", "w", "['d']", "False")}


def test_implied_edges_are_dealt_out_before_they_are_made_distinct(spark, tmp_path):
    lines = [(1, 10, "A", 5.0), (2, 10, "A", 5.0), (2, 10, "A", 50.0), (3, 10, None, 5.0), (3, 10, None, 50.0), (4, 10, None, 5.0), (5, 11, "R", 5.0), (5, 11, "R", 5.0), (6, 11, "N", 50.0)]
    rows = [(k, *r) for k, r in zip((1, 2, 3, 1, 2, 2, 1, 2, None), lines)]
    df = spark.createDataFrame(rows, "l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_quantity double")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = entry.queries()["implied_table_edges"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["implied_table_edges"]).fetchall()
    assert sorted(map(str, map(tuple, got.select("src", "dst", "job_id").collect()))) == sorted(map(str, want)) and len(want) == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan  # its sorts held whole splits
    aggregate, dealt = plan.index("partial_bool_or") if "partial_bool_or" in plan else plan.index("partial_max"), plan.index("REPARTITION_BY_NUM")
    assert aggregate < dealt and "hashpartitioning(src#" in plan and ", 16), REPARTITION_BY_NUM" in plan
