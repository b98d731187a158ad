"""Small sources, one for each operator that the corpus does not show; nothing here is run.

A case is a name and a text. Catalogue columns that the cases know are in SCHEMA.
"""

SCHEMA = {"shop": {"orders": ["id", "amount", "status"], "returns": ["id", "amount", "status"]}, "mart": {"sales": ["id", "total"]}}

SQL: dict[str, str] = {
    "star_known": "CREATE TABLE out.a AS SELECT o.* FROM shop.orders o WHERE o.status = 'x'",
    "star_derived": "CREATE TABLE out.b AS SELECT * FROM (SELECT id AS k, amount * 2 AS twice FROM shop.orders) d",
    "star_unknown": "CREATE TABLE out.c AS SELECT u.*, u.id AS k FROM other.unknown u",
    "union_all": "CREATE TABLE out.d AS SELECT id, amount FROM shop.orders WHERE status = 'a' UNION ALL SELECT id, -amount AS refund FROM shop.returns WHERE status = 'b'",
    "intersect": "CREATE TABLE out.e AS SELECT id FROM shop.orders INTERSECT SELECT id FROM shop.returns",
    "except": "CREATE TABLE out.f AS SELECT id FROM shop.orders EXCEPT SELECT id FROM shop.returns",
    "order_limit": "CREATE TABLE out.g AS SELECT DISTINCT id FROM shop.orders ORDER BY amount LIMIT 3",
    "insert_cte": "WITH big AS (SELECT id, amount FROM shop.orders WHERE amount > 10) INSERT INTO mart.sales SELECT id, sum(amount) FROM big GROUP BY id",
    "merge_branches": "MERGE INTO mart.sales t USING shop.orders s ON t.id = s.id WHEN MATCHED AND s.status = 'gone' THEN DELETE WHEN MATCHED AND s.amount > 0 THEN UPDATE SET total = s.amount WHEN NOT MATCHED THEN INSERT (id, total) VALUES (s.id, upper(s.status))",
}

#: Statements by what they read and write.
STATEMENTS: dict[str, str] = {
    "select": "SELECT id, amount FROM shop.orders",
    "ddl": "CREATE TABLE out.t (a INT, b STRING)",
    "insert_values": "INSERT INTO mart.sales VALUES (1, 2)",
    "delete": "DELETE FROM mart.sales WHERE id = 1",
    "use": "USE shop; CREATE TABLE out.u AS SELECT id FROM orders",
    "drop_temp": "CREATE TEMP TABLE t1 AS SELECT id FROM shop.orders; DROP TABLE t1; CREATE TABLE out.v AS SELECT id FROM t1",
    "ignored": "SET x = 1; ALTER TABLE mart.sales ADD COLUMNS (c INT)",
    "other": "GRANT SELECT ON mart.sales TO someone",
    "placeholder": "SELECT id FROM shop.{{ name }}",
}

HEAD = "from pyspark.sql import functions as F\no = spark.table('shop.orders')\nr = spark.table('shop.returns')\n"

FRAMES: dict[str, str] = {
    "select_expr": "o.selectExpr('id AS k', 'amount * 2 AS twice', 'upper(status) AS s').write.saveAsTable('out.t')",
    "assign": "o.assign(twice=lambda d: d.amount * 2).write.saveAsTable('out.t')",
    "with_columns": "o.select('id').with_columns(F.col('id').alias('k'), j=F.lit(1)).write.saveAsTable('out.t')",
    "to_df": "o.select('id', 'amount').toDF('a', 'b').write.saveAsTable('out.t')",
    "rename": "o.select('id', 'amount').withColumnRenamed('amount', 'b').rename({'id': 'a'}).write.saveAsTable('out.t')",
    "drop": "o.drop('status', 'amount').write.saveAsTable('out.t')",
    "grouped_sum": "o.drop('status').groupBy('id').sum().write.saveAsTable('out.t')",
    "grouped_pick": "o.groupby('status')['amount'].mean().write.saveAsTable('out.t')",
    "union": "o.select('id').union(r.select('amount')).write.saveAsTable('out.t')",
    "union_by_name": "o.select('id', 'amount').unionByName(r.select('id', 'status')).write.saveAsTable('out.t')",
    "unknown_method": "o.select('id').mystery().write.saveAsTable('out.t')",
    "embedded_sql": "spark.sql('SELECT id, sum(amount) AS total FROM shop.orders WHERE status = 1 GROUP BY id').write.saveAsTable('out.t')",
    "mask": "o[o['amount'] > 1].select('id').write.saveAsTable('out.t')",
    "cast": "o.select(F.col('amount').cast('int').alias('a'), F.sum('amount').cast('int').alias('b')).write.saveAsTable('out.t')",
    "expr": "o.select(F.expr('amount + id').alias('a')).write.saveAsTable('out.t')",
    "strings": "o.select(F.concat_ws('-', 'id', 'status').alias('a'), F.substring('status', 1, 2).alias('b'), F.coalesce('status', 'id').alias('c')).write.saveAsTable('out.t')",
    "dates": "o.select(F.to_date('status').alias('a'), F.current_date().alias('b')).write.saveAsTable('out.t')",
    "maths": "o.select(F.round('amount', 2).alias('a'), F.md5('status').alias('b'), F.monotonically_increasing_id().alias('c')).write.saveAsTable('out.t')",
    "conditions": "o.select(F.when(o.status == 'x', o.amount).otherwise(o.id).alias('a'), o.status.isNull().alias('b')).write.saveAsTable('out.t')",
    "arrays": "o.select(F.explode(F.split('status', ',')).alias('a'), F.collect_list('amount').alias('b')).write.saveAsTable('out.t')",
    "json": "o.select(F.get_json_object('status', '$.a').alias('a')).write.saveAsTable('out.t')",
    "unknown_function": "o.select(my_udf(F.col('status')).alias('a')).write.saveAsTable('out.t')",
    "if_else": "x = o.select('id')\nif flag:\n    x = r.select('id')\nx.write.saveAsTable('out.t')",
    "unrolled": "for n in ['a', 'b']:\n    o.select('id').write.saveAsTable('out.' + n)",
    "loop": "x = o.select('id')\nwhile more():\n    x = x.withColumn('k', F.lit(1))\nx.write.saveAsTable('out.t')",
    "try": "x = o.select('id')\ntry:\n    x = x.withColumn('k', x.id)\nexcept ValueError:\n    pass\nx.write.saveAsTable('out.t')",
}

#: Calls by what they read and write.
CALLS: dict[str, str] = {
    "glue": "f = glueContext.create_dynamic_frame.from_catalog(database='raw', table_name='t')\nglueContext.write_dynamic_frame.from_catalog(frame=f, database='mart', table_name='u')",
    "pandas_sql": "import pandas as pd\nfrom sqlalchemy import create_engine\ne = create_engine('postgresql://h/db')\nd = pd.read_sql('select a from s.t', e)\nd.to_sql('u', e, schema='m')",
    "polars": "import polars as pl\npl.scan_parquet('s3://b/in').sink_parquet('s3://b/out')",
    "boto3": "s3.get_object(Bucket='b', Key='k/in.csv')\ns3.put_object(Bucket='b', Key='k/out.csv', Body=x)",
    "wrangler": "import awswrangler as wr\nd = wr.athena.read_sql_query('select a from s.t', database='s')\nwr.s3.to_parquet(df=d, path='s3://b/out')",
    "db_api": "import psycopg2\nc = psycopg2.connect('postgresql://h/db')\ncur = c.cursor()\ncur.execute('insert into m.t select a from s.u')",
    "builder": "d = spark.read.format('jdbc').option('url', 'jdbc:mysql://h/db').option('dbtable', 's.t').load()\nd.write.parquet('s3://b/out')",
    "several_paths": "spark.read.parquet('s3://b/x', 's3://b/y').write.parquet('s3://b/z')",
    "athena_query": "c = boto3.client('athena')\nc.start_query_execution(QueryString='create table m.t as select a from s.u')",
    "runtime_name": "spark.table('s.' + name).write.saveAsTable('m.t')",
    "missing_argument": "spark.table().write.saveAsTable('m.t')",
    "environment": "import os\nspark.table('s.' + os.getenv('T', 'x')).write.saveAsTable('m.t')",
}

AIRFLOW = '''from airflow import DAG
from airflow.providers.postgres.operators.postgres import PostgresOperator

with DAG("sql", schedule=None) as dag:
    PostgresOperator(task_id="pg", sql="insert into m.t select a from s.u")
    AthenaOperator(task_id="ath", query="create table m.v as select a from s.u")
    SQLExecuteQueryOperator(task_id="any", conn_id="lake", sql="insert into m.w select a from s.u")
    SQLExecuteQueryOperator(task_id="blind", conn_id="other", sql="insert into m.x select a from s.u")
    TrinoOperator(task_id="late", sql=build())
'''
AIRFLOW_BINDINGS = {"connection:lake": "mysql"}
