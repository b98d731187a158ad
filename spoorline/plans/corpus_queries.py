"""Queries over the authored corpus; their SQL lists what a reader derives from it by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline import api
from spoorline.functions import cron, text
from spoorline.operators import exports, graph, policy, products
from spoorline.plans.corpus import FILES
from spoorline.sources import repo
from spoorline.sources.products import read_products

ENTRIES: dict = {}


def query(sql: str | None):
    def add(f):
        ENTRIES[f.__name__] = (f, sql)
        return f

    return add


def scanned(spark: SparkSession) -> api.Scan:
    """The corpus as scan() reads it, from memory."""
    context = api.Context(spark, lambda _: None, {}, None, "athena", FILES)
    rows = {k: [] for k in [*api.SCHEMAS, "comment_schedules"]}
    for k, v in read_products({p: t for p, t in FILES.items() if p.endswith("product.yaml")}).items():
        rows[k] += v
    for path, text in sorted(FILES.items()):
        for r in api.READERS:
            if r.accepts(path, text):
                for k, v in r.read(path, text, context).items():
                    rows[k] += v
    return api.assembled(spark, rows)


def _edges(spark: SparkSession, *files: str) -> DataFrame:
    refs = F.array_join(F.transform("sources", lambda r: F.concat_ws("#", r["dataset"], r["column"])), ",")
    indirect = F.array_join(F.transform("indirect", lambda r: F.concat(F.substring_index(r["dataset"], "/", -1), F.lit("."), r["column"], F.lit(":"), r["role"])), ",")
    e = scanned(spark).column_edges
    e = e.filter(F.col("source_file").isin(*files))
    return e.select("target", "target_column", refs.alias("sources"), indirect.alias("indirect"), "kind", "confidence")


@query("""SELECT * FROM (VALUES
 ('glue://stage/orders', 'order_id', 'glue://shop/orders#order_id', 'identity', 'exact'),
 ('glue://stage/orders', 'status', 'glue://shop/orders#status', 'expression', 'exact'),
 ('glue://stage/orders', 'amount_eur', 'glue://shop/orders#amount,glue://shop/rates#rate', 'expression', 'exact'),
 ('glue://stage/orders', 'channel', '', 'expression', 'exact'),
 ('glue://mart/revenue', 'order_id', 'glue://stage/orders#order_id', 'identity', 'exact'),
 ('glue://mart/revenue', 'revenue', 'glue://stage/orders#amount_eur', 'aggregation', 'exact'),
 ('glue://mart/revenue', 'place', 'glue://shop/customers#tier', 'window', 'exact')) t(target, target_column, sources, kind, confidence)""")
def sql_column_lineage(spark, d):
    return _edges(spark, "sql/orders_clean.sql", "sql/revenue.sql").drop("indirect")


@query("""SELECT 'glue://stage/orders' AS target, c AS target_column, 'orders.deleted:filter,orders.currency:join,rates.currency:join' AS indirect FROM (VALUES ('order_id'), ('status'), ('amount_eur'), ('channel')) v(c)
 UNION ALL SELECT 'glue://mart/revenue', c, 'orders.status:filter,orders.amount_eur:filter,orders.order_id:join,customers.last_order:join,orders.order_id:aggregation,customers.tier:aggregation' FROM (VALUES ('order_id'), ('revenue'), ('place')) v(c)""")
def sql_indirect_lineage(spark, d):
    return _edges(spark, "sql/orders_clean.sql", "sql/revenue.sql").select("target", "target_column", "indirect")


@query("""SELECT * FROM (VALUES
 ('glue://mart/customers', 'name', 'glue://stage/changes#new_name,glue://stage/changes#first_name', 'changes.gone:filter,customers.id:join,changes.id:join', 'identity'),
 ('glue://mart/customers', 'id', 'glue://stage/changes#id', 'customers.id:join,changes.id:join', 'identity'),
 ('glue://mart/customers', 'tier', 'glue://stage/tiers#tier', 'customers.id:filter,tiers.id:filter', 'identity')) t(target, target_column, sources, indirect, kind)""")
def merge_update_lineage(spark, d):
    return _edges(spark, "sql/merge_dim.sql").select("target", "target_column", "sources", "indirect", "kind")


@query("""SELECT * FROM (VALUES
 ('glue://default/recent', 'id', 'glue://shop/visits#id', 'visits.day:filter'),
 ('glue://default/recent', 'day', 'glue://shop/visits#day', 'visits.day:filter'),
 ('glue://mart/visits', 'visitor', 'glue://shop/visits#id', 'visits.day:filter,visits.id:aggregation'),
 ('glue://mart/visits', 'last_day', 'glue://shop/visits#day', 'visits.day:filter,visits.id:aggregation')) t(target, target_column, sources, indirect)""")
def temp_table_lineage(spark, d):
    return _edges(spark, "sql/temp.sql").select("target", "target_column", "sources", "indirect")


@query("""SELECT * FROM (VALUES
 ('glue://mart/features', 'country', 'glue://shop/customers#country', 'identity', 'exact'),
 ('glue://mart/features', 'total', '', 'aggregation', 'partial'),
 ('file:///out/share.parquet', 'share', 's3://lake/visits#visits,s3://lake/visits#total', 'expression', 'exact')) t(target, target_column, sources, kind, confidence)""")
def frame_column_lineage(spark, d):
    return _edges(spark, "jobs/features.py", "jobs/export.py").drop("indirect")


@query("""SELECT * FROM (VALUES
 ('jobs/export.py', 3, 'pd.read_parquet', 'read', 's3://lake/visits', true), ('jobs/export.py', 5, 'to_csv', 'write', '/out/today.csv', true), ('jobs/export.py', 6, 'to_parquet', 'write', '/out/share.parquet', true),
 ('jobs/features.py', 11, 'load', 'read', 'stage.orders', true), ('jobs/lib.py', 2, 'spark.table', 'read', '{{?}}', false), ('jobs/features.py', 12, 'spark.table', 'read', 'shop.customers', true), ('jobs/features.py', 16, 'write.saveAsTable', 'write', 'mart.features', true),
 ('jobs/features.py', 17, 'spark.table', 'read', 'mart.visits', true)) t(source_file, line, callee, direction, value, complete)""")
def sink_references(spark, d):
    r = scanned(spark).facts["references"].filter("source_file LIKE 'jobs/%'")
    return r.select("source_file", "line", "callee", "direction", "value", "complete").distinct()


@query("""SELECT * FROM (VALUES ('shop', '@daily', '0 0 * * *', 'airflow', 'sales'), ('feeds', '0 */2 * * *', '0 */2 * * *', 'airflow', NULL),
 ('comment.sql/orders_clean', 'daily 06:30 UTC', '30 6 * * *', 'cron_comment', NULL), ('product.shop.__primary__', 'every 2 hours', '0 */2 * * *', 'product_yaml', NULL)) t(id, interval_text, cron, orchestrator, owner)""")
def airflow_schedules(spark, d):
    return scanned(spark).schedules.select("id", "interval_text", "cron", "orchestrator", "owner")


@query("""SELECT * FROM (VALUES ('shop.gate', 'shop.clean'), ('shop.clean', 'shop.revenue'), ('shop.clean', 'shop.features'), ('feeds.pull', 'shop.gate')) t(src, dst)""")
def airflow_task_edges(spark, d):
    return scanned(spark).task_edges


@query("""SELECT * FROM (VALUES
 ('sql/revenue', 'sql/orders_clean', 'dag,data'), ('jobs/features', 'sql/orders_clean', 'dag,data'), ('sql/orders_clean', 'feeds.pull', 'dag'), ('sql/revenue', 'feeds.pull', 'dag'),
 ('jobs/features', 'feeds.pull', 'dag'), ('sql/merge_dim', 'feeds.pull', 'data'), ('jobs/features', 'sql/temp', 'data'), ('jobs/export', 'jobs/features', 'data')) t(job_id, upstream, sources)""")
def corpus_job_dependencies(spark, d):
    return scanned(spark).job_dependencies.select("job_id", "upstream", F.array_join("sources", ",").alias("sources"))


@query("""SELECT * FROM (VALUES ('sql/orders_clean', 'shop', 'shop'), ('sql/revenue', 'shop', 'shop'), ('sql/merge_dim', 'shop', 'product.shop.__primary__'), ('sql/temp', 'shop', 'product.shop.__primary__'),
 ('jobs/features', 'shop', 'shop'), ('jobs/export', 'shop', 'product.shop.__primary__'), ('feeds.pull', 'shop', 'feeds')) t(job_id, product, schedule_id)""")
def corpus_job_products(spark, d):
    return scanned(spark).jobs.select("job_id", "product", "schedule_id")


@query("""SELECT * FROM (VALUES ('glue://mart/revenue', 1), ('glue://mart/features', 1)) t(node, hop)""")
def corpus_impact(spark, d):
    return scanned(spark).impact("glue://stage/orders")


@query("""SELECT * FROM (VALUES ('@daily', '0 0 * * *'), ('@once', NULL), ('hourly', '0 * * * *'), ('daily 7:05', '5 7 * * *'), ('daily 25:00', NULL), ('daily 06:30 PST', NULL), ('daily 06:305', NULL), ('Daily 06:30 utc', '30 6 * * *'), ('every 15 minutes or so', NULL), ('every 15 minutes', '*/15 * * * *'), ('every 7 minutes', NULL),
 ('every 6 hours', '0 */6 * * *'), ('every 1 day', '0 0 * * *'), ('every 2 days', NULL), ('0  6 * * MON-FRI', '0 6 * * MON-FRI'), ('61 * * * *', NULL), ('*/5 0-12 1,15 JAN *', '*/5 0-12 1,15 JAN *'),
 ('5-1 * * * *', NULL), ('* * * *', NULL), ('timedelta(days=1)', NULL), ('@quarterly', '0 0 1 */3 *')) t(interval_text, cron)""")
def cron_normalize(spark, d):
    texts = "@daily|@once|hourly|daily 7:05|daily 25:00|daily 06:30 PST|daily 06:305|Daily 06:30 utc|every 15 minutes or so|every 15 minutes|every 7 minutes|every 6 hours|every 1 day|every 2 days|0  6 * * MON-FRI|61 * * * *|*/5 0-12 1,15 JAN *|5-1 * * * *|* * * *|timedelta(days=1)|@quarterly"
    df = spark.createDataFrame([(t,) for t in texts.split("|")], "interval_text string")
    return df.withColumn("cron", cron.normalize_cron(F.col("interval_text")))


@query("""SELECT * FROM (VALUES ('{{?}}_x', false, 'name'), ('a_b', true, ''), ('p.q', true, ''), ('n=003', true, ''), ('t_005', true, ''), ('    3|a   ', true, ''), ('{{?}}.b', false, 'x'), ('{{?}}', false, '%05d'), ('100%', true, '')) t(text, complete, symbols)""")
def folded_strings(spark, d):
    import ast

    from spoorline.plans.strings import fold

    made = [fold(ast.parse(t, mode="eval").body, {}) for t in ("f'{name}_x'", "'a' + '_' + 'b'", "'.'.join(['p', 'q'])", "'n={:03d}'.format(3)", "'t_%03d' % 5", "'%5d|%-4s' % (3, 'a')", "'%s.%s' % (x, 'b')", "'%05d' % x", "'100%%' % ()")]
    return spark.createDataFrame([(f.text, f.complete, ",".join(f.symbols)) for f in made], "text string, complete boolean, symbols string")


@query(r"""SELECT * FROM (VALUES
 (1, 'see https://[redacted]@host/db and http://host/x'), (2, 'Authorization: Bearer [redacted], then'), (3, 'api-key=[redacted]&x=1'), (4, 'password_old=[redacted] client_secret_value: [redacted]; next'),
 (5, 'ACCESS_KEY = [redacted],b'), (6, 'a token of thanks'), (7, 'notbasic abc Basic [redacted]'), (8, NULL), (9, 'paßwort x://[redacted]@h Secreté=[redacted]')) t(id, redacted)""")
def redact_samples(spark, d):
    rows = [(1, "see https://me:pw@host/db and http://host/x"), (2, "Authorization: Bearer abc.def==, then"), (3, "api-key=abc&x=1"), (4, "password_old=abc client_secret_value: x1y2; next"), (5, "ACCESS_KEY = abc,b"), (6, "a token of thanks"), (7, "notbasic abc Basic dXNlcg=="), (8, None), (9, "paßwort x://u:p@h Secreté=abc")]
    return spark.createDataFrame(rows, "id int, t string").select("id", text.redact(F.col("t")).alias("redacted"))


@query("""SELECT * FROM (VALUES ('Password', '[redacted]'), ('set-cookie', '[redacted]'), ('prompt', '[redacted]'), ('note', 'token=[redacted]'), ('tokens', 'abc'), ('long', repeat('x', 2000) || '[truncated]')) t(key, value)""")
def redact_fields(spark, d):
    rows = [("Password", "abc"), ("set-cookie", "a=b"), ("prompt", "say"), ("note", "token=abc"), ("tokens", "abc"), ("long", "x" * 2001)]
    return spark.createDataFrame(rows, "key string, v string").select("key", text.redact_value(F.col("key"), F.col("v")).alias("value"))


@query("""SELECT * FROM (VALUES ('a.sql', 'sales', 'daily', NULL), ('b.py', NULL, NULL, 'first'), ('c.sql', NULL, NULL, NULL)) t(path, owner, schedule, source)""")
def comment_headers(spark, d):
    rows = [("a.sql", "-- Title\n--\n-- Owner: sales\n-- Schedule: daily\nSELECT 1\n-- Source: later\n"), ("b.py", "# Source: first\n# Source: second\nx = 1\n"), ("c.sql", "SELECT 1 -- Owner: x\n")]
    head = spark.createDataFrame(rows, "path string, t string").withColumn("h", text.header(F.col("t")))
    return head.select("path", *[F.try_element_at("h", F.lit(k)).alias(k) for k in ("owner", "schedule", "source")])


@query("""SELECT * FROM (VALUES ('https://h.com/o/r', true), ('https://h.com/o/r.git', true), ('http://h.com/o/r', false), ('https://u@h.com/o/r', false), ('https://h.com/o/r?x', false), ('https://h.com/o', false), ('https://h.com/../r', false)) t(url, ok)""")
def repository_urls(spark, d):
    urls = ["https://h.com/o/r", "https://h.com/o/r.git", "http://h.com/o/r", "https://u@h.com/o/r", "https://h.com/o/r?x", "https://h.com/o", "https://h.com/../r"]
    return spark.createDataFrame([(u,) for u in urls], "url string").withColumn("ok", text.valid_repository_url(F.col("url")))


@query("""SELECT * FROM (VALUES ('https://h.com/v1', true), ('http://localhost:80/x', true), ('http://h.com', false), ('https://u:p@h.com', false), ('ftp://h', false)) t(url, ok)""")
def gateway_urls(spark, d):
    return spark.createDataFrame([(u,) for u in ("https://h.com/v1", "http://localhost:80/x", "http://h.com", "https://u:p@h.com", "ftp://h")], "url string").withColumn("ok", text.valid_gateway_url(F.col("url")))


@query("""SELECT * FROM (VALUES ('x-a', 'b', true), ('x a', 'b', false), ('x', 'b' || chr(10) || 'c', false)) t(name, value, ok)""")
def gateway_headers(spark, d):
    return spark.createDataFrame([("x-a", "b"), ("x a", "b"), ("x", "b\nc")], "name string, value string").withColumn("ok", text.valid_header(F.col("name"), F.col("value")))


@query("""SELECT * FROM (VALUES ('jobs/features.py', 'missing_schema,partial_lineage,unknown_column'), ('jobs/export.py', 'dynamic_path'), ('jobs/lib.py', 'sparse_extraction'), ('dags/feeds.py', 'missing_schema,sparse_extraction'),
 ('dags/shop.py', 'sparse_extraction')) t(source_file, reasons)""")
def files_for_review(spark, d):
    s = scanned(spark)
    files = spark.createDataFrame([(p,) for p in FILES if not p.endswith(".yaml")], "source_file string")
    return policy.eligible_files(files, s.unresolved, s.column_edges).select("source_file", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT * FROM (VALUES ('glue://a/t', true), ('glue://a/u', true), ('glue://a/v', false), ('not an id', false)) t(id, ok)""")
def allowed_datasets(spark, d):
    rows = [("glue://a/t", True, ""), ("glue://a/u", False, "select * from u"), ("glue://a/v", False, "select 1"), ("not an id", True, "not an id")]
    return spark.createDataFrame(rows, "id string, known boolean, t string").select("id", policy.dataset_allowed(F.col("id"), F.col("known"), F.col("t")).alias("ok"))


@query("""SELECT * FROM (VALUES ('a', 'kept'), ('b', 'incomplete_lineage'), ('c', 'missing'), ('d', 'invalid'), ('e', 'described')) t(node, decision)""")
def description_choices(spark, d):
    rows = [("a", "words", True, "more"), ("b", None, False, "words of it"), ("c", None, True, None), ("d", None, True, "x"), ("e", None, True, "words of it")]
    return policy.description_decisions(spark.createDataFrame(rows, "node string, description string, complete boolean, proposed string")).select("node", "decision")


@query("""SELECT 'a' AS node, '{"column":"a","expression":"x + y","kind":"expression","sources":["t#x","t#y"]}' AS prompt""")
def description_prompts(spark, d):
    return policy.prompts(spark.createDataFrame([("a", "expression", "x + y", ["t#y", "t#x"])], "node string, kind string, expression string, sources array<string>"))


@query("""SELECT * FROM (VALUES ('m/a.py', 'lib.u', 'm/lib/u.py'), ('m/a.py', 'n', 'm/n.py'), ('b.py', 'pkg', 'z.zip!/pkg/__init__.py')) t(caller, module, path)""")
def resolved_modules(spark, d):
    paths = ["m/a.py", "m/lib/u.py", "m/n.py", "k/n.py", "z.zip!/pkg/__init__.py", "b.py", "x.sql"]
    sources = spark.createDataFrame([(p, "", p[p.rindex(".") :]) for p in paths], "path string, text string, suffix string")
    names = spark.createDataFrame([("m/a.py", "lib.u"), ("m/a.py", "n"), ("b.py", "n"), ("b.py", "pkg"), ("b.py", "none")], "caller string, module string")
    return repo.resolve_modules(names, repo.modules(sources))


@query("""SELECT * FROM (VALUES ('/home/me/b/x.sql', 'b/x.sql'), ('y.sql', 'b/y.sql')) t(script, path)""")
def resolved_scripts(spark, d):
    sources = spark.createDataFrame([(p,) for p in ("a/x.sql", "b/x.sql", "b/y.sql")], "path string")
    return repo.script_paths(spark.createDataFrame([("/home/me/b/x.sql",), ("x.sql",), ("y.sql",), ("q.sql",)], "script string"), sources)


@query("""SELECT * FROM (VALUES ('glue://c/z')) t(id)""")
def datasets_without_rows(spark, d):
    edges = spark.createDataFrame([("glue://a/x", "glue://c/z"), ("glue://b/y", "glue://a/x")], "src string, dst string")
    return graph.missing_datasets(edges, spark.createDataFrame([("glue://a/x",), ("glue://b/y",)], "id string"))


@query("""SELECT * FROM (VALUES ('a', 'shop'), ('a', 'feeds'), ('b', 'unknown')) t(product, depends_on)""")
def product_codes(spark, d):
    declared = spark.createDataFrame([("a", "THE SHOP"), ("a", "feeds"), ("b", "unknown")], "product string, depends_on string")
    return products.resolve_codes(declared, spark.createDataFrame([("shop", "The Shop"), ("feeds", "Feeds")], "code string, name string"))


@query("""SELECT * FROM (VALUES ('shop.gate', 'feeds', 'pull'), ('x.blind', 'none', NULL)) t(task, dag_id, task_id) WHERE task = 'x.blind'""")
def lost_external_tasks(spark, d):
    refs = spark.createDataFrame([("shop.gate", "sensor", "feeds", "pull"), ("x.blind", "sensor", "none", None)], "task string, kind string, dag_id string, task_id string")
    return graph.external_references(refs, scanned(spark).tasks)[1].select("task", "dag_id", "task_id")


@query("""SELECT * FROM (VALUES
 ('mart', 'athena', 't', 'z', 0, 'last letter'), ('mart', 'athena', 't', 'gone', 1, 'kept'), ('mart', 'athena', 't', 'a', 2, ''), ('mart', 'athena', 't', 'b', 3, ''),
 ('mart', 'athena', 'u', NULL, 0, ''), ('mart', 'postgres', 't', 'z', 0, 'another'), ('old', 'mysql', 'x', 'c', 0, '')) t(db_name, db_type, table_name, field_name, place, description)""")
def catalog_upsert(spark, d):
    prior = [("mart", "athena", None, "gold", "t", "glue://mart/t", "z", 0, "last letter"), ("mart", "athena", None, "gold", "t", "glue://mart/t", "gone", 1, "kept"), ("mart", "postgres", None, None, "t", "postgres://mart/t", "z", 0, "another"), ("old", "", None, None, "x", None, None, None, None)]
    found = [("glue://mart/t", "table", ["b", "a", "z"], "p", None), ("glue://mart/u", "table", [], None, None), ("frame://a/b", "table", ["c"], None, None), ("s3://b/c", "s3_path", ["c"], None, None), ("mysql://old/x", "table", ["c"], None, None)]
    before = spark.createDataFrame(prior, "db_name string, db_type string, product string, layer string, table_name string, dataset_id string, field_name string, place int, description string")
    now = spark.createDataFrame(found, "id string, kind string, columns array<string>, product string, layer string")
    return exports.catalog_columns(now, before).drop("product", "layer", "dataset_id")


@query("""SELECT * FROM (VALUES ('jobs/features', '', 'Features of customers.', '@daily', 'feeds.pull,sql/orders_clean,sql/temp'), ('sql/orders_clean', '', 'Cleans orders.', '@daily', 'feeds.pull')) t(job_id, description, about, schedule, depends_on)""")
def corpus_catalog_scripts(spark, d):
    s = scanned(spark)
    out = s.to_catalog()[1].filter("job_id IN ('jobs/features', 'sql/orders_clean')")
    return out.join(s.jobs.select("job_id", F.col("description").alias("about")), "job_id").select("job_id", "description", "about", "schedule", "depends_on")
