"""All queries of the lineage engine by name, and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions import cron, identity, text
from spoorline.operators import exports, graph, impact, observability, policy, products
from spoorline.plans import bridges as B
from spoorline.plans import case_queries, corpus_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- identity -------------------------------------------------------------------------------


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([^:]+)', 1)) AS scheme, regexp_extract(url, '^[^:]+://([^/]*)', 1) AS namespace,
 regexp_extract(url, '^[^:]+://[^/]*/(.*)$', 1) AS name, 'api' AS kind FROM pages""")
def dataset_identity_urls(spark, d):
    ident = identity.normalize_dataset_id(F.col("url"))
    scheme, namespace, name = identity.split_dataset_id(F.col("id"))
    return B.table(spark, d, "pages").select("page_id", ident.alias("id")).select("page_id", scheme.alias("scheme"), namespace.alias("namespace"), name.alias("name"), identity.dataset_kind(F.col("id")).alias("kind"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'glue://sales/' || lower(o_orderpriority) WHEN 'F' THEN 'postgres://sales/' || o_orderpriority
 ELSE 'mysql://default/orders_' || (o_orderkey % 7) END AS id FROM orders""")
def dataset_identity_tables(spark, d):
    o = B.table(spark, d, "orders")
    engine = F.when(F.col("o_orderstatus") == "O", "athena").when(F.col("o_orderstatus") == "F", "postgres").otherwise("mysql")
    name = F.when(F.col("o_orderstatus").isin("O", "F"), F.concat(F.lit('Cat.SALES."'), F.col("o_orderpriority"), F.lit('"'))).otherwise(F.concat(F.lit("Orders_"), (F.col("o_orderkey") % 7).cast("string")))
    return o.select("o_orderkey", identity.normalize_dataset_id(name, engine).alias("id"))


@query("""SELECT CASE WHEN url LIKE 'http%' THEN 'api' ELSE 'table' END AS kind, count(*) AS n FROM pages GROUP BY 1
 UNION ALL SELECT CASE r_regionkey % 5 WHEN 0 THEN 's3_path' WHEN 1 THEN 'kafka' WHEN 2 THEN 'kinesis' WHEN 3 THEN 'file' ELSE 'table' END, count(*) FROM region GROUP BY 1""")
def dataset_kind_counts(spark, d):
    scheme = F.element_at(F.array(*map(F.lit, ("s3a://b/", "kafka://b/", "kinesis://b/", "/b/", "db.b"))), (F.col("r_regionkey") % 5 + 1).cast("int"))
    names = B.table(spark, d, "pages").select(F.col("url").alias("n")).unionAll(B.table(spark, d, "region").select(F.concat(scheme, F.col("r_regionkey").cast("string"))))
    return names.groupBy(identity.dataset_kind(identity.normalize_dataset_id(F.col("n"))).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_partkey % 50 AS k, l_orderkey * 10 + l_linenumber AS seq, l_returnflag, l_linestatus, l_suppkey % 7 AS s FROM lineitem)
SELECT 'glue://db/t' || k AS id, string_agg(DISTINCT 'a' || s, ',' ORDER BY 'a' || s) AS aliases, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS columns,
 arg_min(l_returnflag, seq) FILTER (l_returnflag <> 'N') AS product FROM l GROUP BY k""")
def dataset_merge_columns(spark, d):
    li = B.table(spark, d, "lineitem")
    rows = li.select(F.concat(F.lit("glue://db/t"), (F.col("l_partkey") % 50).cast("string")).alias("id"), F.array(F.concat(F.lit("a"), (F.col("l_suppkey") % 7).cast("string"))).alias("aliases"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("columns"), F.lit(None).cast("string").alias("physical_location"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("product"), F.lit(None).cast("string").alias("layer"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.merge_datasets(rows).select("id", F.array_join("aliases", ",").alias("aliases"), F.array_join("columns", ",").alias("columns"), "product")


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS a, c_custkey // 2 AS o FROM customer WHERE c_custkey >= 2),
 w AS (SELECT a, o FROM p UNION ALL SELECT w.a, p.o FROM w JOIN p ON w.o = p.a)
 SELECT 'c:' || a AS alias, 'c:' || min(o) AS canonical FROM w GROUP BY a""")
def alias_canonicalize(spark, d):
    c = B.table(spark, d, "customer").filter("c_custkey >= 2")
    return graph.canonical_aliases(c.select(B.name("c", "c_custkey").alias("alias"), B.name("c", F.floor(F.col("c_custkey") / 2)).alias("owner")))


@query("""WITH c AS (SELECT DISTINCT 'p:' || l_partkey AS alias, 's:' || l_suppkey AS owner FROM lineitem)
 SELECT alias, count(*) AS n_owners, string_agg(owner, ',' ORDER BY owner) AS owners FROM c GROUP BY alias""")
def alias_owners(spark, d):
    li = B.table(spark, d, "lineitem").groupBy(B.name("s", "l_suppkey").alias("id")).agg(F.collect_set(B.name("p", "l_partkey")).alias("aliases"))
    one, many = graph.alias_owners(li)
    rows = one.select("alias", F.array("owner").alias("owners")).unionByName(many.select("alias", "owners"))
    return rows.select("alias", F.size("owners").cast("long").alias("n_owners"), F.array_join("owners", ",").alias("owners"))


# ---- dependencies -----------------------------------------------------------------------------


@query(f"WITH {B.DEPS} SELECT job_id, upstream, n_via, via, in_place_writer FROM deps")
def job_data_dependencies(spark, d):
    deps = graph.data_dependencies(B.job_io(spark, d))
    return deps.select("job_id", "upstream", F.size("via").cast("long").alias("n_via"), F.array_join("via", ",").alias("via"), "in_place_writer")


DAG = f"""{B.TASKS}, {B.TASK_JOBS}, reach AS (SELECT src, dst FROM tasks UNION SELECT r.src, t.dst FROM reach r JOIN tasks t ON r.dst = t.src),
 dag AS (SELECT DISTINCT b.job_id, a.job_id AS upstream FROM reach JOIN task_jobs a ON a.task = src JOIN task_jobs b ON b.task = dst WHERE a.job_id <> b.job_id)"""


@query(f"WITH RECURSIVE {DAG} SELECT job_id, upstream FROM dag")
def dag_ancestor_dependencies(spark, d):
    return graph.dag_dependencies(B.tasks(spark, d), B.task_jobs(spark, d))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey + 1 + n_regionkey) % 25 AS dst FROM nation),
 r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT 'n:' || src AS node FROM r WHERE src = dst""")
def task_cycles(spark, d):
    e = B.table(spark, d, "nation").select(B.name("n", "n_nationkey").alias("src"), B.name("n", (F.col("n_nationkey") + 1 + F.col("n_regionkey")) % 25).alias("dst"))
    return graph.cyclic_nodes(graph.closure(e))


EVIDENCE = f"""{DAG}, {B.JOB_IO.replace("job_io AS", "raw_io AS")}, io AS (SELECT DISTINCT 'job:' || (CAST(regexp_extract(job_id, '([0-9]+)', 1) AS BIGINT) % 40) AS job_id, dataset_id, direction FROM raw_io),
 dat AS (SELECT DISTINCT r.job_id, w.job_id AS upstream FROM io r JOIN io w USING (dataset_id) WHERE r.direction = 'in' AND w.direction = 'out' AND r.job_id <> w.job_id
   AND NOT EXISTS (SELECT 1 FROM io x WHERE x.job_id = w.job_id AND x.dataset_id = w.dataset_id AND x.direction = 'in')),
 ev AS (SELECT job_id, upstream, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM (SELECT *, 'data' AS s FROM dat UNION ALL SELECT *, 'dag' AS s FROM dag) GROUP BY job_id, upstream)"""


def _evidence(spark, d):
    io = B.job_rows(spark, d).select(B.name("job", F.regexp_extract("job_id", "([0-9]+)", 1).cast("long") % 40).alias("job_id"), "dataset_id", "direction")
    return graph.merge_evidence(graph.data_dependencies(io), graph.dag_dependencies(B.tasks(spark, d), B.task_jobs(spark, d)))


@query(f"WITH RECURSIVE {EVIDENCE} SELECT job_id, upstream, sources FROM ev")
def merged_dependency_evidence(spark, d):
    return _evidence(spark, d).select("job_id", "upstream", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH RECURSIVE {EVIDENCE} SELECT job_id, upstream, CASE sources WHEN 'data' THEN 'missing_task_dependency' ELSE 'ordering_only' END AS drift FROM ev
 WHERE sources IN ('data', 'dag') AND CAST(job_id[5:] AS BIGINT) % 2 = 0 AND CAST(upstream[5:] AS BIGINT) % 2 = 0""")
def orchestration_drift(spark, d):
    scheduled = spark.range(0, 40, 2).select(B.name("job", "id").alias("job_id"))
    return products.orchestration_drift(_evidence(spark, d), scheduled)


@query("""WITH o AS (SELECT DISTINCT s_nationkey AS p, c_nationkey AS q, s_suppkey AS s, c_custkey AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
 obs AS (SELECT p, q, count(*) AS n FROM o WHERE p <> q GROUP BY p, q HAVING (p + q) % 3 <> 0), dec AS (SELECT a.n_nationkey AS p, b.n_nationkey AS q FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + a.n_regionkey + 1) % 25)
 SELECT 'nation:' || coalesce(obs.p, dec.p) AS product, 'nation:' || coalesce(obs.q, dec.q) AS depends_on, coalesce(n, 0) AS n_jobs,
 CASE WHEN dec.p IS NULL THEN 'undeclared' WHEN obs.p IS NULL THEN 'declared_but_unobserved' ELSE 'confirmed' END AS status FROM obs FULL JOIN dec ON obs.p = dec.p AND obs.q = dec.q""")
def product_dependency_drift(spark, d):
    li, s, o, c = (B.table(spark, d, t) for t in ("lineitem", "supplier", "orders", "customer"))
    deps = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(B.name("s", "l_suppkey").alias("job_id"), B.name("c", "o_custkey").alias("upstream")).distinct()
    homes = s.select(B.name("s", "s_suppkey").alias("job_id"), F.col("s_nationkey").alias("k")).unionAll(c.select(B.name("c", "c_custkey"), "c_nationkey"))
    seen = products.observed_dependencies(deps, homes.select("job_id", B.name("nation", "k").alias("product")))
    number = lambda col: F.substring_index(col, ":", -1).cast("int")
    seen = seen.filter((number("product") + number("depends_on")) % 3 != 0)
    declared = B.table(spark, d, "nation").select(B.name("nation", "n_nationkey").alias("product"), B.name("nation", (F.col("n_nationkey") + F.col("n_regionkey") + 1) % 25).alias("depends_on"))
    return products.dependency_status(seen, declared)


# ---- impact -----------------------------------------------------------------------------------

DOWN = f"""{B.EDGES}, {B.OWNERS}, walk AS (SELECT 'region:0' AS node, 0 AS hop UNION SELECT e.dst, w.hop + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.hop < 4),
 hops AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node HAVING min(hop) > 0)"""


@query(f"WITH RECURSIVE {DOWN} SELECT node, hop FROM hops")
def impact_downstream_hops(spark, d):
    return impact.hops(B.edges(spark, d), "region:0", max_depth=4)


@query(f"""WITH RECURSIVE {B.EDGES}, walk AS (SELECT 'supplier:1' AS node, 0 AS hop UNION SELECT e.src, w.hop + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.hop < 4)
 SELECT node, min(hop) AS hop FROM walk GROUP BY node HAVING min(hop) > 0""")
def impact_upstream_hops(spark, d):
    return impact.hops(B.edges(spark, d), "supplier:1", "upstream", max_depth=4)


@query(f"""WITH RECURSIVE {DOWN} SELECT h.hop, count(DISTINCT h.node) AS n_nodes, string_agg(DISTINCT e.job_id, ',' ORDER BY e.job_id) AS jobs, string_agg(DISTINCT o.product, ',' ORDER BY o.product) AS products
 FROM hops h JOIN edges e ON e.dst = h.node JOIN (SELECT * FROM hops UNION ALL SELECT 'region:0', 0) f ON f.node = e.src AND f.hop = h.hop - 1 LEFT JOIN owners o ON o.dataset_id = h.node GROUP BY h.hop""")
def impact_hop_summary(spark, d):
    e = B.edges(spark, d)
    report = impact.hop_report(impact.hops(e, "region:0", max_depth=4), e, B.owners(spark, d), "region:0")
    return report.select("hop", F.size("nodes").cast("long").alias("n_nodes"), F.array_join("jobs", ",").alias("jobs"), F.array_join("products", ",").alias("products"))


@query(f"""WITH RECURSIVE {DOWN}, inside AS (SELECT node FROM hops UNION ALL SELECT 'region:0')
 SELECT DISTINCT e.src, e.dst, a.product AS src_product, b.product AS dst_product FROM edges e JOIN owners a ON a.dataset_id = e.src JOIN owners b ON b.dataset_id = e.dst
 WHERE a.product <> b.product AND e.src IN (SELECT node FROM inside) AND e.dst IN (SELECT node FROM inside)""")
def impact_cross_product_edges(spark, d):
    e = B.edges(spark, d)
    return impact.cross_product_edges(e, impact.hops(e, "region:0", max_depth=4), B.owners(spark, d), "region:0")


# ---- facts --------------------------------------------------------------------------------------


@query("SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, l_returnflag AS job_id FROM lineitem")
def edge_dedup(spark, d):
    return graph.dedup(B.table(spark, d, "lineitem").select(B.name("supplier", "l_suppkey").alias("src"), B.name("part", "l_partkey").alias("dst"), F.col("l_returnflag").alias("job_id")))


@query("""SELECT 'column_edge' AS fact, CASE l_returnflag WHEN 'R' THEN 'partial' WHEN 'A' THEN 'inferred' ELSE 'exact' END AS name, count(*) AS n FROM lineitem GROUP BY 1, 2
 UNION ALL SELECT 'unresolved', event_type, count(*) FROM events GROUP BY 1, 2""")
def lineage_summary(spark, d):
    conf = F.when(F.col("l_returnflag") == "R", "partial").when(F.col("l_returnflag") == "A", "inferred").otherwise("exact")
    return graph.summary(B.table(spark, d, "lineitem").select(conf.alias("confidence")), B.table(spark, d, "events").select(F.col("event_type").alias("kind")))


SIDES = """a AS (SELECT 'p' || l_partkey || '<-' || string_agg(DISTINCT 's' || l_suppkey, ',' ORDER BY 's' || l_suppkey) AS key, min(l_returnflag) AS kind FROM lineitem GROUP BY l_partkey),
 b AS (SELECT 'p' || l_partkey || '<-' || string_agg(DISTINCT 's' || l_suppkey, ',' ORDER BY 's' || l_suppkey) AS key, min(l_returnflag) AS kind FROM lineitem WHERE l_partkey % 3 > 0 OR l_quantity < 40 GROUP BY l_partkey)"""


def _sides(spark, d):
    li = B.table(spark, d, "lineitem")
    side = lambda df: df.groupBy("l_partkey").agg(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("s"), F.min("l_returnflag").alias("kind")).select(policy.edge_key(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.col("s")).alias("key"), "kind")
    return side(li), side(li.filter("l_partkey % 3 > 0 OR l_quantity < 40"))


@query(f"""WITH {SIDES} SELECT key, CASE WHEN b.key IS NULL THEN 'deterministic_only' WHEN a.key IS NULL THEN 'ai_only' WHEN a.kind = b.kind THEN 'agreed' ELSE 'transformation' END AS verdict FROM a FULL JOIN b USING (key)""")
def edge_set_compare(spark, d):
    return policy.compared(*_sides(spark, d))


@query(f"""WITH {SIDES}, ex AS (SELECT key, split_part(key, '<-', 1) AS target, CASE kind WHEN 'A' THEN 'exact' ELSE 'partial' END AS confidence FROM a)
 SELECT split_part(b.key, '<-', 1) AS target, b.key, CASE WHEN b.key IN (SELECT key FROM ex) THEN 'unchanged' WHEN split_part(b.key, '<-', 1) IN (SELECT target FROM ex WHERE confidence = 'exact') THEN 'deferred' ELSE 'accepted' END AS decision FROM b""")
def proposal_merge_decisions(spark, d):
    a, b = _sides(spark, d)
    target = F.substring_index("key", "<-", 1).alias("target")
    return policy.merge_decisions(b.select(target, "key"), a.select(target, "key", F.when(F.col("kind") == "A", "exact").otherwise("partial").alias("confidence")))


@query("""WITH c AS (SELECT DISTINCT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, l_returnflag AS job_id FROM lineitem)
 SELECT src, dst, job_id FROM c EXCEPT SELECT 's:' || l_suppkey, 'p:' || l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 10""")
def implied_table_edges(spark, d):
    li = B.table(spark, d, "lineitem")
    src, dst = B.name("s", "l_suppkey"), B.name("p", "l_partkey")
    even = F.col("l_linenumber") % 2 == 0
    none = F.array().cast("array<string>")
    cols = li.select(dst.alias("target"), F.when(even, F.array(src)).otherwise(none).alias("sources"), F.when(even, none).otherwise(F.array(src)).alias("indirect"), F.col("l_returnflag").alias("job_id"))
    stated = li.filter("l_quantity > 10").select(src.alias("src"), dst.alias("dst"), F.col("l_returnflag").alias("job_id"))
    return policy.implied_table_edges(cols, stated, parts=16 * li.rdd.getNumPartitions())


@query("""WITH RECURSIVE base AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 1 THEN 'd' || c_custkey END AS descr FROM customer),
 up AS (SELECT k, k AS at, descr FROM base UNION ALL SELECT u.k, b.k, b.descr FROM up u JOIN base b ON b.k = u.at // 2 AND u.descr IS NULL AND u.at >= 2)
 SELECT 'c:' || b.k AS node, max(u.descr) AS description, b.descr IS NULL AND max(u.descr) IS NOT NULL AS inherited FROM base b JOIN up u ON u.k = b.k GROUP BY b.k, b.descr""")
def description_inheritance(spark, d):
    c = B.table(spark, d, "customer")
    nodes = c.select(B.name("c", "c_custkey").alias("node"), F.when(F.col("c_custkey") % 11 == 1, F.concat(F.lit("d"), F.col("c_custkey").cast("string"))).alias("description"))
    copies = c.filter("c_custkey >= 2").select(B.name("c", F.floor(F.col("c_custkey") / 2)).alias("src"), B.name("c", "c_custkey").alias("dst"))
    return policy.inherit_descriptions(nodes, copies)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 2 + n_regionkey) % 25 AS t FROM nation),
 r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s), names AS (SELECT n_nationkey AS n, least('n:' || n_nationkey, coalesce((SELECT min('n:' || r.t) FROM r JOIN r q ON q.s = r.t AND q.t = r.s WHERE r.s = n_nationkey), 'n:' || n_nationkey)) AS c FROM nation),
 l AS (SELECT DISTINCT a.c AS a, b.c AS b FROM e JOIN names a ON a.n = s JOIN names b ON b.n = t WHERE a.c <> b.c),
 p AS (SELECT c, 0 AS d FROM names UNION SELECT l.b, p.d + 1 FROM p JOIN l ON l.a = p.c)
 SELECT 'n:' || n AS node, names.c AS component, max(d) AS level FROM names JOIN p ON p.c = names.c GROUP BY n, names.c""")
def description_topo_levels(spark, d):
    n = B.table(spark, d, "nation")
    e = n.select(B.name("n", "n_nationkey").alias("src"), B.name("n", (F.col("n_nationkey") * 2 + F.col("n_regionkey")) % 25).alias("dst"))
    return policy.description_levels(n.select(B.name("n", "n_nationkey").alias("node")), e)


# ---- texts --------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({text.redact_sql('text')}) AS redacted_sha256 FROM documents")
def redact_documents(spark, d):
    return B.table(spark, d, "documents").select("doc_id", text.digest(text.redact(F.col("text"))).alias("redacted_sha256"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def digest_documents(spark, d):
    return B.table(spark, d, "documents").select("doc_id", text.digest(F.col("text")).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '[truncated]' ELSE text END AS short FROM documents")
def truncate_documents(spark, d):
    return B.table(spark, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("short"))


@query(r"""SELECT page_id, regexp_matches(url, '^https://[^/]*/en/') AND NOT regexp_matches(url, '^.*\.html$') AS in_scope FROM pages""")
def scope_globs(spark, d):
    return B.table(spark, d, "pages").select("page_id", text.in_scope(F.col("url"), ("https://*/en/**",), ("**.html",)).alias("in_scope"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) >= 1 + doc_id % 3 AND doc_id % 7 <> 0 AND length(substr(string_split(text, chr(10))[1 + doc_id % 3], 3, 20)) > 0 AS holds FROM documents""")
def evidence_validation(spark, d):
    docs = B.table(spark, d, "documents")
    line = (F.col("doc_id") % 3 + 1).cast("int")
    quote = F.coalesce(F.substring(F.get(F.split("text", "\n"), line - 1), 3, 20), F.lit(""))
    sha = F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.sha2("text", 256))
    return docs.select("doc_id", policy.evidence_holds(F.col("text"), sha, line, line, quote).alias("holds"))


@query(r"""SELECT page_id, 'SELECT * FROM ' || regexp_extract(url, '://([^/]*)', 1) || '.t WHERE d = ''{{ day }}''' AS sql, 1 AS holes FROM pages""")
def template_bindings(spark, d):
    raw = F.lit("SELECT * FROM {{ db }}.${table} WHERE d = '{{ day }}'")
    bound = text.bind_templates(raw, {"table": "t"})
    host = F.regexp_extract("url", "://([^/]*)", 1)
    out = F.regexp_replace(bound, F.lit(r"\{\{ db \}\}"), host)
    return B.table(spark, d, "pages").select("page_id", out.alias("sql")).withColumn("holes", F.size(text.template_holes(F.col("sql"))))


# ---- events -------------------------------------------------------------------------------------


@query("SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_counters(spark, d):
    return observability.counters(B.events(spark, d)).withColumn("total", F.round("total", 4))


@query("SELECT event_type AS stage, arg_max(value, event_id) AS last_value FROM events GROUP BY 1")
def event_gauges(spark, d):
    return observability.gauges(B.events(spark, d))


@query("""WITH l AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events WHERE value IS NOT NULL),
 q AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM l WHERE k <= 256),
 p AS (SELECT event_type, value AS p95 FROM q WHERE r = ceil(0.95 * n))
 SELECT event_type AS stage, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean, any_value(p95) AS p95 FROM events LEFT JOIN p USING (event_type) GROUP BY 1""")
def event_duration_stats(spark, d):
    return observability.durations(B.events(spark, d)).select("stage", "n", "least", "most", F.round("mean", 4).alias("mean"), "p95")


@query("SELECT user_id AS run_id, count(*) / nullif(sum(CAST(floor(value) AS BIGINT)) % 5, 0)::DOUBLE AS files_per_second FROM events GROUP BY 1")
def event_throughput(spark, d):
    runs = B.events(spark, d).groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("files"), F.count("*").alias("bytes"), (F.sum(F.floor("value")) % 5).alias("seconds"))
    return observability.throughput(runs).select("run_id", "files_per_second")


@query("""WITH RECURSIVE l AS (SELECT user_id, event_id, 100 + event_id * 37 % 400 AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 w AS (SELECT user_id, event_id, k, b AS used, 0 AS file FROM l WHERE k = 1 UNION ALL
   SELECT l.user_id, l.event_id, l.k, CASE WHEN w.used + l.b > 1000 THEN l.b ELSE w.used + l.b END, CASE WHEN w.used + l.b > 1000 THEN w.file + 1 ELSE w.file END FROM w JOIN l ON l.user_id = w.user_id AND l.k = w.k + 1)
 SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, CASE WHEN file < 5 THEN file END AS file FROM w""")
def event_log_rotation(spark, d):
    log = B.events(spark, d).select(F.col("user_id").cast("string").alias("run_id"), "seq", (F.lit(100) + F.col("seq") * 37 % 400).alias("bytes"))
    return observability.rotation(log, 1000, 5)


@query("""SELECT event_id // 3 AS span_id, min(CASE WHEN event_id % 3 = 0 THEN event_id END) AS started, max(CASE WHEN event_id % 3 <> 0 THEN event_id END) AS ended,
 CASE WHEN bool_or(event_id % 3 <> 0 AND event_type = 'error') THEN 'failed' WHEN max(CASE WHEN event_id % 3 <> 0 THEN event_id END) IS NULL THEN 'open' ELSE 'finished' END AS status FROM events GROUP BY 1""")
def event_spans(spark, d):
    kind = F.when(F.col("seq") % 3 == 0, "started").when(F.col("stage") == "error", "failed").otherwise("finished")
    return observability.spans(B.events(spark, d).select(F.floor(F.col("seq") / 3).alias("span_id"), F.lit(None).cast("string").alias("parent_id"), kind.alias("kind"), "seq")).drop("parent_id")


@query("""SELECT user_id AS run_id, CASE max(CASE WHEN value < 1 THEN 4 WHEN value < 3 THEN 3 WHEN value < 20 THEN 2 ELSE 1 END) WHEN 4 THEN 'cancelled' WHEN 3 THEN 'failed' WHEN 2 THEN 'partial' ELSE 'success' END AS status FROM events GROUP BY 1""")
def event_run_status(spark, d):
    status = F.when(F.col("value") < 1, "cancelled").when(F.col("value") < 3, "failed").when(F.col("value") < 20, "partial").otherwise("success")
    return observability.run_status(B.events(spark, d).select(F.col("user_id").alias("run_id"), status.alias("status")))


@query("""WITH RECURSIVE f AS (SELECT n_nationkey AS seq, n_name AS path, 10 + n_nationkey * 7 % 30 AS t, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation),
 w AS (SELECT 0::BIGINT AS k, 0::BIGINT AS calls, 0::BIGINT AS used, NULL::INTEGER AS seq, NULL::VARCHAR AS path, '' AS decision UNION ALL
   SELECT f.k, calls + CASE WHEN calls >= 12 OR used + t > 200 THEN 0 ELSE 1 END, used + CASE WHEN calls >= 12 OR used + t > 200 THEN 0 ELSE t END, f.seq, f.path,
   CASE WHEN calls >= 12 THEN 'over_calls' WHEN used + t > 200 THEN 'over_tokens' ELSE 'called' END FROM w JOIN f ON f.k = w.k + 1)
 SELECT CAST(seq AS BIGINT) AS seq, path, decision FROM w WHERE k > 0""")
def call_budget_plan(spark, d):
    return policy.call_plan(B.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("path"), (F.lit(10) + F.col("n_nationkey") * 7 % 30).cast("long").alias("tokens")), 12, 200)


@query("""SELECT * FROM (VALUES (1, 'called'), (2, 'over_context'), (3, 'called'), (4, 'over_tokens'), (5, 'called'), (6, 'over_deadline'), (7, 'over_deadline')) t(seq, decision)""")
def call_budget_limits(spark, d):
    rows = [(1, "a", 50, 10, 2.0), (2, "b", 10, 900, 1.0), (3, "c", 40, 100, 3.0), (4, "d", 20, 1, 1.0), (5, "e", 10, 1, 5.0), (6, "f", 1, 1, 1.0), (7, "g", 1, 999, 1.0)]
    files = spark.createDataFrame(rows, "seq long, path string, tokens long, context long, seconds double")
    return policy.call_plan(files, 9, 100, 500, 10.0).select(F.col("seq").cast("int").alias("seq"), "decision")


# ---- exports ------------------------------------------------------------------------------------


@query("""SELECT DISTINCT 'brand:' || p_brand AS job_id, 'out' AS output, p_type AS field, 'in:' || (p_partkey % 9) AS input, p_type AS input_field, CASE WHEN p_size > 25 THEN 'DIRECT' ELSE 'INDIRECT' END AS type,
 CASE WHEN p_size <= 25 THEN NULL WHEN p_size % 3 = 2 THEN 'TRANSFORMATION' WHEN p_size % 3 = 0 THEN 'IDENTITY' ELSE 'AGGREGATION' END AS subtype, 'e' || (p_size % 4) AS description FROM part""")
def openlineage_fields(spark, d):
    return exports.lineage_fields(_part_refs(spark, d))


def _part_refs(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("identity", "aggregation", "expression"))), (F.col("p_size") % 3 + 1).cast("int"))
    return B.table(spark, d, "part").select(B.name("brand", "p_brand").alias("job_id"), F.lit("out").alias("target"), F.col("p_type").alias("target_column"), B.name("in", F.col("p_partkey") % 9).alias("source"), F.col("p_type").alias("source_column"), F.when(F.col("p_size") > 25, "direct").otherwise("indirect").alias("role"), kind.alias("kind"), F.concat(F.lit("e"), (F.col("p_size") % 4).cast("string")).alias("expression"), F.col("p_partkey").cast("int").alias("line_start"))


@query("""WITH p AS (SELECT 'brand:' || p_brand AS job_id, p_type AS field, p_size % 3 AS k, 'e' || (p_size % 4) AS x, max(p_partkey) AS m FROM part GROUP BY ALL)
 SELECT job_id, 'out' AS output, field, CASE WHEN count(DISTINCT k) > 1 THEN 'MIXED' WHEN min(k) = 0 THEN 'IDENTITY' WHEN min(k) = 1 THEN 'AGGREGATION' ELSE 'EXPRESSION' END AS "transformationType",
 (SELECT string_agg(x, chr(10) ORDER BY m DESC) FROM (SELECT x, max(m) AS m FROM p q WHERE q.job_id = p.job_id AND q.field = p.field GROUP BY x)) AS "transformationDescription" FROM p GROUP BY job_id, field""")
def openlineage_field_kinds(spark, d):
    return exports.field_kinds(_part_refs(spark, d))


@query(f"""WITH {B.DEPS}, n AS (SELECT job_id, string_agg(dataset_id, ',' ORDER BY dataset_id) FILTER (direction = 'in') AS r, string_agg(dataset_id, ',' ORDER BY dataset_id) FILTER (direction = 'out') AS w FROM job_io GROUP BY job_id),
 u AS (SELECT job_id, string_agg(upstream, ',' ORDER BY upstream) AS up FROM deps GROUP BY job_id) SELECT job_id, coalesce(r, '') AS reads_from, coalesce(w, '') AS writes_to, coalesce(up, '') AS depends_on FROM n LEFT JOIN u USING (job_id)""")
def catalog_scripts(spark, d):
    io = B.job_io(spark, d)
    return exports.catalog_scripts(io.select("job_id"), io, graph.data_dependencies(io))


@query(f"""WITH {B.JOB_IO}, o AS (SELECT job_id, min(l) AS a, max(l) AS b FROM (SELECT job_id, 'brand' || p_brand AS l FROM job_io JOIN part ON dataset_id = 'part:' || p_partkey WHERE direction = 'out') GROUP BY job_id)
 SELECT DISTINCT job_id, CASE WHEN a = b THEN a WHEN job_id LIKE 'supplier:1%' THEN 'ones' ELSE 'all' END AS product FROM job_io LEFT JOIN o USING (job_id)""")
def job_products(spark, d):
    io = B.job_io(spark, d)
    owners = B.table(spark, d, "part").select(B.name("part", "p_partkey").alias("dataset_id"), F.concat(F.lit("brand"), F.col("p_brand")).alias("product"))
    jobs = io.select("job_id").distinct().withColumn("source_file", F.concat(F.lit("jobs/"), F.when(F.col("job_id").startswith("supplier:1"), "ones/").otherwise("rest/"), F.col("job_id"), F.lit(".sql")))
    folders = spark.createDataFrame([("jobs", "all"), ("jobs/ones", "ones")], "folder string, product string")
    return graph.job_products(io, owners, jobs, folders)


for _name, (_f, _sql) in (corpus_queries.ENTRIES | case_queries.ENTRIES).items():
    QUERIES[_name] = _f
    if _sql:
        ORACLES[_name] = _sql
