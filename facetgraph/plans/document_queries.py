"""Registered queries on configuration documents (see sources/documents.py), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.operators import bundles, ci, partition, render, topology
from facetgraph.sources import documents, facts
from facetgraph.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _pairs(column: str) -> Column:
    """A map as one text, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


_ORDERS = "WITH o AS (SELECT 'c' || o_custkey AS graph, o_orderkey AS ok, o_orderpriority AS u, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx FROM orders)"
_SERVICES = f"""{_ORDERS}, n AS (
  SELECT graph, 'compose:o' || ok AS id, 'o' || ok AS label, CASE ok % 4 WHEN 0 THEN 'database' ELSE 'service' END AS kind,
         CASE ok % 4 WHEN 0 THEN 'postgres:' || (ok % 7) WHEN 1 THEN (ok % 5)::VARCHAR END AS image,
         CASE ok % 4 WHEN 0 THEN '80:' || (ok % 9) || ', ' || (ok % 5) END AS ports,
         CASE ok % 4 WHEN 2 THEN '{{"it''s": ''' || u || ''', ''z'': [None, True, ' || (ok % 5) || ']}}' END AS build FROM o
), c AS (
  SELECT graph, 'compose:o' || ok AS source, 'compose:o' || nx AS target, unnest(CASE ok % 4 WHEN 0 THEN ['depends_on'] WHEN 1 THEN ['depends_on', 'links', 'links'] ELSE [] END) AS relation FROM o WHERE nx IS NOT NULL
)"""


@query(f"{_SERVICES} SELECT graph, id, label, kind, 'confirmed' AS confidence, 'compose' AS environment, graph AS source, concat_ws('; ', 'build=' || build, 'image=' || image, 'ports=' || ports) AS metadata FROM n")
def ev9_compose_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' services, their metadata as text."""
    return topology.compose_topology(documents.compose_files(spark, sf_dir))[0].withColumn("metadata", _pairs("metadata"))


@query(f"{_SERVICES} SELECT graph, source, target, relation, 'confirmed' AS confidence FROM c")
def ev9_compose_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.compose_topology(documents.compose_files(spark, sf_dir))[1]


_CHART = f"""{_SERVICES}, b AS (SELECT *, 'n' || (row_number() OVER (PARTITION BY graph ORDER BY id) - 1) AS box, row_number() OVER (PARTITION BY graph ORDER BY id) AS p, label || coalesce('\\\\n' || image, '') || '\\\\n[compose]' AS shown FROM n), ln AS (
  SELECT graph, 0 AS part, p, '' AS x, '    ' || box || CASE kind WHEN 'database' THEN '[("' || shown || '")]' ELSE '["' || shown || '"]' END AS line FROM b
  UNION ALL SELECT c.graph, 1, 0, c.source || chr(0) || c.target || chr(0) || relation, '    ' || s.box || ' -->|"' || relation || ' [confirmed]"| ' || t.box FROM c JOIN b s ON s.graph = c.graph AND s.id = c.source JOIN b t ON t.graph = c.graph AND t.id = c.target
  UNION ALL SELECT DISTINCT graph, 2, 0, '', '    classDef confirmed stroke-width:2px;' || chr(10) || '    classDef inferred stroke-dasharray:5 5;' || chr(10) || '    classDef unknown stroke-dasharray:2 4;' FROM b
  UNION ALL SELECT graph, 3, p, '', '    class ' || box || ' confirmed;' FROM b
) SELECT graph, 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, p, x) || chr(10) AS text FROM ln GROUP BY graph"""


@query(_CHART)
def rn8_deployment_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart of each customer's services."""
    return render.deployment_flowchart(*topology.compose_topology(documents.compose_files(spark, sf_dir)))


@query()
def gn10_deployment_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charts of the customers' services, cut into series; tested on a known file."""
    nodes, connections = (written(t, "topology") for t in topology.compose_topology(documents.compose_files(spark, sf_dir)))
    members = partition.partition(nodes.select("graph", F.col("id").alias("node")), connections.select("graph", F.col("source").alias("src"), F.col("target").alias("dst")))
    return bundles.deployment_bundle(members, nodes, connections)


_CLUSTER = f"""{_ORDERS}, w AS (
  SELECT graph, ok, CASE ok % 3 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'Pod' ELSE 'CronJob' END AS kind, CASE WHEN ok % 3 < 2 THEN 'a' || (ok % 4) END AS app, CASE WHEN ok % 3 < 2 THEN ok % 2 END AS n,
         CASE ok % 3 WHEN 0 THEN '; images=i' || (ok % 5) || ', None' ELSE '' END AS images, CASE ok % 3 WHEN 0 THEN (ok % 6)::VARCHAR ELSE 'None' END AS replicas FROM o
)"""


@query(f"""{_CLUSTER} SELECT graph, 'k8s:' || lower(kind) || ':o' || ok AS id, 'o' || ok AS label, 'workload' AS kind, substr(images || '; kind=' || kind || '; replicas=' || replicas, 3) AS metadata FROM w
UNION ALL SELECT graph, 'k8s:service:s' || ok, 's' || ok, 'service-endpoint', '' FROM o UNION ALL SELECT graph, 'k8s:ingress:i' || ok, 'i' || ok, 'ingress', '' FROM o""")
def ev10_cluster_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = topology.cluster_topology(documents.cluster_documents(spark, sf_dir))
    return nodes.select("graph", "id", "label", "kind", _pairs("metadata").alias("metadata"))


@query(f"""{_CLUSTER} SELECT s.graph, 'k8s:service:s' || s.ok AS source, 'k8s:' || lower(w.kind) || ':o' || w.ok AS target, 'routes_to' AS relation FROM o s JOIN w ON w.graph = s.graph
WHERE CASE s.ok % 4 WHEN 0 THEN w.app = 'a' || ((s.ok // 4) % 4) WHEN 1 THEN w.app = 'a' || ((s.ok // 4) % 4) AND w.n = (s.ok // 8) % 2 WHEN 2 THEN w.n IS NULL ELSE false END
UNION ALL SELECT graph, 'k8s:ingress:i' || ok, 'k8s:service:s' || unnest(CASE WHEN nx IS NULL THEN [ok] ELSE [ok, nx] END), 'routes_to' FROM o""")
def ev10_cluster_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What services and ingresses route to."""
    return topology.cluster_topology(documents.cluster_documents(spark, sf_dir))[1].select("graph", "source", "target", "relation")


_JOBS = f"""WITH {facts.FACTS_SQL}, o AS (SELECT 'c' || o_custkey AS graph, o_orderkey AS ok, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS nx FROM orders), j AS (
  SELECT graph, ok, 'o' || ok AS job, row_number() OVER (PARTITION BY graph ORDER BY ok) - 1 AS job_pos, CASE ok % 3 WHEN 0 THEN ['o' || nx] WHEN 1 THEN ['o' || nx, 'gone'] ELSE [] END AS needs FROM o WHERE EXISTS (SELECT 1 FROM l0 WHERE l0.ok = o.ok)
), s AS (
  SELECT ln.graph, j.job, j.job_pos, i - 1 AS step_pos, CASE k % 4 WHEN 0 THEN 'S' || k WHEN 3 THEN 'run' ELSE 'uses' END AS step,
         CASE k % 4 WHEN 0 THEN ['tests/unit/p' || p || '.py', 'a b' || (p % 3) || '.py'] WHEN 1 THEN [] WHEN 2 THEN ['w/' || (s % 3), 'local/l' || (s % 5)] ELSE ['src', 'x' || (p % 4) || '.sh'] END AS paths, k, p
  FROM ln JOIN j ON j.graph = ln.graph AND j.ok = ln.ok
)"""


@query(f"{_JOBS} SELECT graph, job, job_pos, array_to_string(needs, ',') AS needs FROM j")
def ev7_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ci.jobs(documents.workflow_files(spark, sf_dir))
    return rows.select("graph", "job", F.col("job_pos").cast("long").alias("job_pos"), F.array_join("needs", ",").alias("needs"))


@query(f"""{_JOBS} SELECT graph, job, step_pos, step, array_to_string(paths, '|') AS paths, CASE k % 4 WHEN 3 THEN 'B,A' ELSE '' END AS env_names, CASE k % 4 WHEN 3 THEN 'Q' ELSE '' END AS env_refs, CASE k % 4 WHEN 1 THEN 'K' || (p % 5) ELSE '' END AS secret_refs,
CASE k % 4 WHEN 1 THEN 'cache' END AS resource, CASE k % 4 WHEN 1 THEN 'd' || (p % 5) || '|q' END AS resource_paths, CASE k % 4 WHEN 3 THEN k::VARCHAR END AS timeout_minutes FROM s""")
def ev7_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ci.steps(documents.workflow_files(spark, sf_dir))
    joined = lambda c, sign: F.array_join(c, sign).alias(c)
    return rows.select("graph", "job", F.col("step_pos").cast("long").alias("step_pos"), "step", joined("paths", "|"), joined("env_names", ","), joined("env_refs", ","), joined("secret_refs", ","), "resource", joined("resource_paths", "|"), "timeout_minutes")


@query(f"{_JOBS}, x AS (SELECT graph, job, step, job_pos, step_pos, unnest(range(len(paths))) AS path_pos, unnest(paths) AS path FROM s) SELECT graph, job, step, path, job_pos, step_pos, path_pos FROM x QUALIFY row_number() OVER (PARTITION BY graph, job, step, path ORDER BY step_pos, path_pos) = 1")
def ev8_path_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ci.path_hints(ci.steps(documents.workflow_files(spark, sf_dir)))
    return rows.withColumns({c: F.col(c).cast("long") for c in ("job_pos", "step_pos", "path_pos")})


@query(f"""{_JOBS}, nd AS (SELECT graph, job, job_pos, unnest(needs) AS need FROM j), mt AS (SELECT * FROM nd WHERE EXISTS (SELECT 1 FROM j WHERE j.graph = nd.graph AND j.job = nd.need)), ln2 AS (
  SELECT DISTINCT graph, 0 AS part, 0 AS p, '    ci_trigger["' || CASE substr(graph, 2)::INT % 3 WHEN 0 THEN 'push' WHEN 1 THEN 'push, a' ELSE 'z, b' END || '"]' AS line FROM j
  UNION ALL SELECT graph, 1, job_pos, '    ci_' || job || '["' || job || '<br/>' || string_agg(step, '<br/>' ORDER BY step_pos) || '"]' FROM s GROUP BY graph, job, job_pos
  UNION ALL SELECT graph, 2, job_pos, '    ci_' || need || ' --> ci_' || job FROM mt
  UNION ALL SELECT graph, 2, job_pos, '    ci_trigger --> ci_' || job FROM j WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.graph = j.graph AND mt.job = j.job)
) SELECT graph, 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, p) || chr(10) AS text FROM ln2 GROUP BY graph""")
def rn10_workflow_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(documents.workflow_files(spark, sf_dir), "workflows")
    return ci.workflow_chart(ci.workflows(files), ci.jobs(files), ci.steps(files))
