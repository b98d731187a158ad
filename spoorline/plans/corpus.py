"""A small repository of sources, written for the queries and tests; nothing here is run."""

FILES: dict[str, str] = {
    "sql/orders_clean.sql": """-- Source: shop.orders
-- Owner: sales
-- Schedule: daily 06:30 UTC
-- Cleans orders.
CREATE TABLE stage.orders AS
SELECT o.order_id, upper(o.status) AS status, o.amount * r.rate AS amount_eur, 'web' AS channel
FROM shop.orders o LEFT JOIN shop.rates r ON o.currency = r.currency
WHERE o.deleted = 0;
""",
    "sql/revenue.sql": """CREATE TABLE mart.revenue AS
WITH paid AS (SELECT order_id, amount_eur FROM stage.orders WHERE status = 'PAID')
SELECT p.order_id, sum(p.amount_eur) AS revenue, rank() OVER (ORDER BY c.tier) AS place
FROM paid p JOIN shop.customers c ON p.order_id = c.last_order
GROUP BY p.order_id, c.tier
HAVING sum(p.amount_eur) > 0;
""",
    "sql/merge_dim.sql": """MERGE INTO mart.customers t USING stage.changes s ON t.id = s.id
WHEN MATCHED AND s.gone = 0 THEN UPDATE SET name = s.new_name
WHEN NOT MATCHED THEN INSERT (id, name) VALUES (s.id, s.first_name);
UPDATE mart.customers SET tier = x.tier FROM stage.tiers x WHERE mart.customers.id = x.id;
""",
    "sql/temp.sql": """CREATE TEMP TABLE recent AS SELECT id, day FROM shop.visits WHERE day > 10;
INSERT INTO mart.visits (visitor, last_day) SELECT id, max(day) FROM recent GROUP BY id;
""",
    "jobs/features.py": '''"""Features of customers.

Owner: ml
"""
from pyspark.sql import SparkSession, functions as F, Window
from jobs.lib import load

TARGET = "mart." + "features"

def main():
    orders = load("stage.orders").alias("o")
    people = spark.table("shop.customers").select("id", "country").alias("c")
    w = Window.partitionBy("country").orderBy("amount_eur")
    df = orders.join(people, F.col("o.order_id") == F.col("c.id"), "left")
    df = df.filter(F.col("status") == "PAID").withColumn("rank", F.row_number().over(w))
    df.groupBy("country").agg(F.sum("amount_eur").alias("total")).write.saveAsTable(TARGET)
    spark.table("mart.visits").write.mode("overwrite").parquet("s3a://lake/visits")
''',
    "jobs/lib.py": "def load(name):\n    return spark.table(name)\n",
    "jobs/export.py": '''import os
import pandas as pd
df = pd.read_parquet("s3://lake/visits")
df["share"] = df["visits"] / df["total"]
df[["share"]].to_csv(f"/out/{os.getenv('DAY', 'today')}.csv")
df[["share"]].to_parquet("/out/share.parquet")
''',
    "dags/shop.py": '''from airflow import DAG
from airflow.operators.bash import BashOperator
from airflow.sensors.external_task import ExternalTaskSensor
from datetime import datetime

with DAG("shop", schedule="@daily", start_date=datetime(2024, 1, 1), tags=["core"], catchup=False, default_args={"owner": "sales"}) as dag:
    clean = BashOperator(task_id="clean", bash_command="spark-sql -f sql/orders_clean.sql")
    gate = ExternalTaskSensor(task_id="gate", external_dag_id="feeds", external_task_id="pull")
    revenue = BashOperator(task_id="revenue", bash_command="run $(cat sql/revenue.sql)")
    features = BashOperator(task_id="features", bash_command="python jobs/features.py")
    gate >> clean >> [revenue, features]
''',
    "dags/feeds.py": '''from airflow.decorators import dag, task

@dag(schedule="0 */2 * * *")
def feeds():
    @task
    def pull():
        spark.table("raw.feed").write.saveAsTable("stage.changes")

    pull()
''',
    "product.yaml": """code: shop
name: Shop
owners: [sales]
databases:
  - {name: stage, layer: staging}
  - {name: mart, layer: mart}
dependencies:
  - {code: feeds, tables: [raw.feed]}
orchestration: {schedule: every 2 hours}
""",
}
