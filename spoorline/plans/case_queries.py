"""Queries over the small cases; their SQL lists what a reader derives from each by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spoorline import api
from spoorline.plans import cases
from spoorline.plans.frames import Interpreter
from spoorline.plans.sqlfront import Analysis, Result
from spoorline.sources import catalogs

ENTRIES: dict = {}
EDGES = "name string, target_column string, sources string, indirect string, kind string, confidence string"
EFFECTS = "name string, inputs string, outputs string, problems string"


def query(columns: str, *values: str):
    sql = f"SELECT * FROM (VALUES {', '.join(values)}) t({', '.join(c.split()[0] for c in columns.split(', '))})" if values else None

    def add(f):
        ENTRIES[f.__name__] = (f, sql)
        return f

    return add


def _sql(spark: SparkSession, text: str) -> Result:
    return Analysis(spark, catalogs.lookup(cases.SCHEMA), "athena").run(text)


def _frame(spark: SparkSession, text: str) -> Result:
    return Interpreter(spark, text, "", "", catalogs.lookup(cases.SCHEMA), {}, None, "athena", lambda name, level: None).run()


def _short(dataset: str, column: str) -> str:
    return dataset.rpartition("/")[2] + "." + column


def _edges(name: str, r: Result) -> list[tuple]:
    return [(name, e["target_column"], " ".join(_short(*x) for x in e["sources"]), " ".join(f"{_short(d, c)}:{role}" for d, c, role in e["indirect"]), e["kind"], e["confidence"]) for e in r.column_edges]


def _effects(name: str, r: Result) -> tuple:
    return name, " ".join(sorted(r.inputs)), " ".join(sorted(r.outputs)), " ".join(sorted({u["kind"] for u in r.unresolved}))


@query(
    EDGES,
    "('star_known', 'id', 'orders.id', 'orders.status:filter', 'identity', 'exact')",
    "('star_known', 'amount', 'orders.amount', 'orders.status:filter', 'identity', 'exact')",
    "('star_known', 'status', 'orders.status', 'orders.status:filter', 'identity', 'exact')",
    "('star_derived', 'k', 'orders.id', '', 'identity', 'exact')",
    "('star_derived', 'twice', 'orders.amount', '', 'expression', 'exact')",
    "('star_unknown', 'k', 'unknown.id', '', 'identity', 'partial')",
    "('union_all', 'id', 'orders.id returns.id', 'orders.status:filter returns.status:filter', 'identity', 'exact')",
    "('union_all', 'amount', 'orders.amount returns.amount', 'orders.status:filter returns.status:filter', 'expression', 'exact')",
    "('intersect', 'id', 'orders.id returns.id', '', 'identity', 'exact')",
    "('except', 'id', 'orders.id returns.id', '', 'identity', 'exact')",
    "('order_limit', 'id', 'orders.id', '', 'identity', 'exact')",
    "('insert_cte', 'id', 'orders.id', 'orders.amount:filter orders.id:aggregation', 'identity', 'exact')",
    "('insert_cte', 'total', 'orders.amount', 'orders.amount:filter orders.id:aggregation', 'aggregation', 'exact')",
    "('merge_branches', 'total', 'orders.amount orders.status', 'orders.amount:filter sales.id:join orders.id:join', 'expression', 'exact')",
    "('merge_branches', 'id', 'orders.id', 'sales.id:join orders.id:join', 'identity', 'exact')",
)
def sql_case_lineage(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([e for n, t in cases.SQL.items() for e in _edges(n, _sql(spark, t))], EDGES)


@query(
    EFFECTS,
    "('star_known', 'glue://shop/orders', 'glue://out/a', '')",
    "('star_derived', 'glue://shop/orders', 'glue://out/b', '')",
    "('star_unknown', 'glue://other/unknown', 'glue://out/c', 'missing_schema')",
    "('union_all', 'glue://shop/orders glue://shop/returns', 'glue://out/d', '')",
    "('intersect', 'glue://shop/orders glue://shop/returns', 'glue://out/e', '')",
    "('except', 'glue://shop/orders glue://shop/returns', 'glue://out/f', '')",
    "('order_limit', 'glue://shop/orders', 'glue://out/g', '')",
    "('insert_cte', 'glue://shop/orders', 'glue://mart/sales', '')",
    "('merge_branches', 'glue://mart/sales glue://shop/orders', 'glue://mart/sales', '')",
    "('select', 'glue://shop/orders', '', '')",
    "('ddl', '', 'glue://out/t', '')",
    "('insert_values', '', 'glue://mart/sales', '')",
    "('delete', 'glue://mart/sales', 'glue://mart/sales', '')",
    "('use', 'glue://shop/orders', 'glue://out/u', '')",
    "('drop_temp', 'glue://default/t1 glue://shop/orders', 'glue://default/t1 glue://out/v', '')",
    "('ignored', '', '', '')",
    "('other', '', '', 'unsupported_syntax')",
    "('placeholder', '', '', 'dynamic_sql')",
)
def sql_case_effects(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([_effects(n, _sql(spark, t)) for n, t in (cases.SQL | cases.STATEMENTS).items()], EFFECTS)


@query(
    "name string, place int, selected string, sources string",
    "('select', 0, 'id', 'orders.id')",
    "('select', 1, 'amount', 'orders.amount')",
)
def sql_selected_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, i, c.name, " ".join(_short(*x) for x in c.refs)) for n in ("select", "ddl") for i, c in enumerate(_sql(spark, cases.STATEMENTS[n]).selected)]
    return spark.createDataFrame(rows, "name string, place int, selected string, sources string")


@query(
    EDGES,
    "('select_expr', 'k', 'orders.id', '', 'identity', 'exact')",
    "('select_expr', 'twice', 'orders.amount', '', 'expression', 'exact')",
    "('select_expr', 's', 'orders.status', '', 'expression', 'exact')",
    "('assign', 'id', 'orders.id', '', 'identity', 'exact')",
    "('assign', 'amount', 'orders.amount', '', 'identity', 'exact')",
    "('assign', 'status', 'orders.status', '', 'identity', 'exact')",
    "('assign', 'twice', 'orders.amount', '', 'expression', 'exact')",
    "('with_columns', 'id', 'orders.id', '', 'identity', 'exact')",
    "('with_columns', 'k', 'orders.id', '', 'identity', 'exact')",
    "('with_columns', 'j', '', '', 'expression', 'exact')",
    "('to_df', 'a', 'orders.id', '', 'identity', 'exact')",
    "('to_df', 'b', 'orders.amount', '', 'identity', 'exact')",
    "('rename', 'a', 'orders.id', '', 'identity', 'exact')",
    "('rename', 'b', 'orders.amount', '', 'identity', 'exact')",
    "('drop', 'id', 'orders.id', '', 'identity', 'exact')",
    "('grouped_sum', 'id', 'orders.id', 'orders.id:aggregation', 'identity', 'exact')",
    "('grouped_sum', 'amount', 'orders.amount', 'orders.id:aggregation', 'aggregation', 'exact')",
    "('grouped_pick', 'status', 'orders.status', 'orders.status:aggregation', 'identity', 'exact')",
    "('grouped_pick', 'amount', 'orders.amount', 'orders.status:aggregation', 'aggregation', 'exact')",
    "('union', 'id', 'orders.id returns.amount', '', 'identity', 'exact')",
    "('union_by_name', 'id', 'orders.id returns.id', '', 'identity', 'exact')",
    "('union_by_name', 'amount', 'orders.amount', '', 'identity', 'exact')",
    "('union_by_name', 'status', 'returns.status', '', 'identity', 'exact')",
    "('unknown_method', 'id', 'orders.id', '', 'identity', 'partial')",
    "('embedded_sql', 'id', 'orders.id', 'orders.status:filter orders.id:aggregation', 'identity', 'exact')",
    "('embedded_sql', 'total', 'orders.amount', 'orders.status:filter orders.id:aggregation', 'aggregation', 'exact')",
    "('mask', 'id', 'orders.id', 'orders.amount:filter', 'identity', 'exact')",
    "('cast', 'a', 'orders.amount', '', 'identity', 'exact')",
    "('cast', 'b', 'orders.amount', '', 'aggregation', 'exact')",
    "('expr', 'a', 'orders.amount orders.id', '', 'expression', 'exact')",
    "('strings', 'a', 'orders.id orders.status', '', 'expression', 'exact')",
    "('strings', 'b', 'orders.status', '', 'expression', 'exact')",
    "('strings', 'c', 'orders.status orders.id', '', 'expression', 'exact')",
    "('dates', 'a', 'orders.status', '', 'expression', 'exact')",
    "('dates', 'b', '', '', 'expression', 'exact')",
    "('maths', 'a', 'orders.amount', '', 'expression', 'exact')",
    "('maths', 'b', 'orders.status', '', 'expression', 'exact')",
    "('maths', 'c', '', '', 'expression', 'exact')",
    "('conditions', 'a', 'orders.status orders.amount orders.id', '', 'expression', 'exact')",
    "('conditions', 'b', 'orders.status', '', 'expression', 'exact')",
    "('arrays', 'a', 'orders.status', '', 'expression', 'exact')",
    "('arrays', 'b', 'orders.amount', '', 'aggregation', 'exact')",
    "('json', 'a', 'orders.status', '', 'expression', 'exact')",
    "('unknown_function', 'a', 'orders.status', '', 'expression', 'partial')",
    "('if_else', 'id', 'returns.id orders.id', '', 'identity', 'partial')",
    "('unrolled', 'id', 'orders.id', '', 'identity', 'exact')",
    "('unrolled', 'id', 'orders.id', '', 'identity', 'exact')",
    "('loop', 'id', 'orders.id', '', 'identity', 'partial')",
    "('loop', 'k', '', '', 'expression', 'partial')",
    "('try', 'id', 'orders.id', '', 'identity', 'partial')",
    "('try', 'k', 'orders.id', '', 'identity', 'partial')",
)
def frame_case_lineage(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([e for n, t in cases.FRAMES.items() for e in _edges(n, _frame(spark, cases.HEAD + t))], EDGES)


@query(
    EFFECTS,
    "('select_expr', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('assign', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('with_columns', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('to_df', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('rename', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('drop', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('grouped_sum', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('grouped_pick', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('union', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('union_by_name', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('unknown_method', 'glue://shop/orders glue://shop/returns', 'glue://out/t', 'unknown_column')",
    "('embedded_sql', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('mask', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('cast', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('expr', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('strings', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('dates', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('maths', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('conditions', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('arrays', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('json', 'glue://shop/orders glue://shop/returns', 'glue://out/t', '')",
    "('unknown_function', 'glue://shop/orders glue://shop/returns', 'glue://out/t', 'unknown_column')",
    "('if_else', 'glue://shop/orders glue://shop/returns', 'glue://out/t', 'unknown_column')",
    "('unrolled', 'glue://shop/orders glue://shop/returns', 'glue://out/a glue://out/b', '')",
    "('loop', 'glue://shop/orders glue://shop/returns', 'glue://out/t', 'dynamic_control_flow unknown_column')",
    "('try', 'glue://shop/orders glue://shop/returns', 'glue://out/t', 'dynamic_control_flow unknown_column')",
)
def frame_case_effects(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([_effects(n, _frame(spark, cases.HEAD + t)) for n, t in cases.FRAMES.items()], EFFECTS)


@query(
    EFFECTS,
    "('glue', 'glue://raw/t', 'glue://mart/u', 'missing_schema')",
    "('pandas_sql', 'postgres://s/t', 'postgres://m/u', '')",
    "('polars', 's3://b/in', 's3://b/out', 'missing_schema')",
    "('boto3', 's3://b/k/in.csv', 's3://b/k/out.csv', '')",
    "('wrangler', 'glue://s/t', 's3://b/out', '')",
    "('db_api', 'postgres://s/u', 'postgres://m/t', '')",
    "('builder', 'mysql://s/t', 's3://b/out', 'missing_schema')",
    "('several_paths', 's3://b/x s3://b/y', 's3://b/z', 'missing_schema')",
    "('athena_query', 'glue://s/u', 'glue://m/t', '')",
    "('runtime_name', '', 'glue://m/t', 'dynamic_table_name missing_schema')",
    "('missing_argument', '', 'glue://m/t', 'dynamic_table_name missing_schema')",
    "('environment', '', 'glue://m/t', 'dynamic_table_name missing_schema')",
)
def call_effects(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([_effects(n, _frame(spark, t)) for n, t in cases.CALLS.items()], EFFECTS)


@query(
    "job_id string, engine string, inputs string, outputs string",
    "('sql.pg', 'postgres', 'postgres://s/u', 'postgres://m/t')",
    "('sql.ath', 'athena', 'glue://s/u', 'glue://m/v')",
    "('sql.any', 'mysql', 'mysql://s/u', 'mysql://m/w')",
)
def airflow_sql_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = _airflow(spark)["jobs"]
    return spark.createDataFrame([(r["job_id"], r["engine"], " ".join(r["inputs"]), " ".join(r["outputs"])) for r in rows], "job_id string, engine string, inputs string, outputs string")


@query(
    "kind string, task string",
    "('unsupported_syntax', 'sql.blind')",
    "('dynamic_sql', 'sql.late')",
)
def airflow_sql_problems(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(r["kind"], r["reason"].partition(":")[0]) for r in _airflow(spark)["unresolved"]], "kind string, task string")


def _airflow(spark: SparkSession) -> api.Rows:
    context = api.Context(spark, lambda _: None, cases.AIRFLOW_BINDINGS, None, "athena", {"d.py": cases.AIRFLOW})
    return api.AirflowReader().read("d.py", cases.AIRFLOW, context)
