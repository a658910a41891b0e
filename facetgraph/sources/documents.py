"""The given tables as configuration documents in JSON, a file for each customer.

Orders are services, workloads, ingresses and jobs, lines are steps. Fields are scalars,
arrays, objects, null or missing by turns, so that their values have to be normalized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetgraph.sources.facts import order_lines
from facetgraph.sources.tables import table


def _json(text: str, **values: Column) -> Column:
    """A JSON text with each <name> replaced by a value."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value.cast("string"))
    return out


def _by_turn(key: Column, texts: list[Column]) -> Column:
    return F.get(F.array(*texts), (key % len(texts)).cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, ok, nx, urgency): the customers' orders, each with the customer's next one, -1 at the end."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("graph"), F.col("o_orderkey").alias("ok"), F.col("o_orderpriority").alias("urgency"))
    return rows.withColumn("nx", F.coalesce(F.lead("ok").over(Window.partitionBy("graph").orderBy("ok")), F.lit(-1)))


def _gathered(rows: DataFrame, place: str, text: Column) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), text.alias("text"))))
    return rows.groupBy("graph").agg(F.array_join(F.transform(parts, lambda x: x["text"]), ",").alias("parts"))


def compose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, json): orders as services."""
    ok, nx = F.col("ok"), F.col("nx")
    specs = [
        _json('{"image": "postgres:<a>", "ports": ["80:<b>", <c>], "depends_on": ["o<nx>", "gone"]}', a=ok % 7, b=ok % 9, c=ok % 5, nx=nx),
        _json('{"image": <c>, "depends_on": {"o<nx>": {"c": 1}, "gone": null}, "links": ["o<nx>:alias", "o<nx>"]}', c=ok % 5, nx=nx),
        _json('{"build": {"z": [null, true, <c>], "it\'s": "<u>"}, "links": "gone"}', c=ok % 5, u=F.col("urgency")),
        F.lit("null"),
    ]
    service = F.concat(_json('"o<ok>": ', ok=ok), _by_turn(ok, specs))
    return _gathered(orders(spark, sf_dir), "ok", service).select("graph", _json('{"services": {<parts>}}', parts=F.col("parts")).alias("json"))


def cluster_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, pos, json): for each order a workload, a service and an ingress."""
    ok, nx = F.col("ok"), F.col("nx")
    own = {"ok": ok, "nx": nx, "app": ok % 4, "n": ok % 2, "i": ok % 5, "r": ok % 6}
    workloads = [
        _json('{"kind": "Deployment", "metadata": {"name": "o<ok>"}, "spec": {"replicas": <r>, "template": {"metadata": {"labels": {"app": "a<app>", "n": <n>}}, "spec": {"containers": [{"image": "i<i>"}, {}]}}}}', **own),
        _json('{"kind": "Pod", "metadata": {"name": "o<ok>", "labels": {"app": "a<app>", "n": "<n>"}}, "spec": {"containers": [{"image": ""}]}}', **own),
        _json('{"kind": "CronJob", "metadata": {"name": "o<ok>"}, "spec": {}}', **own),
    ]
    wanted = {"app": F.floor(ok / 4) % 4, "n": F.floor(ok / 8) % 2}
    selectors = [_json('{"app": "a<app>"}', **wanted), _json('{"app": "a<app>", "n": <n>}', **wanted), F.lit('{"n": null}'), F.lit("{}")]
    service = F.concat(_json('{"kind": "Service", "metadata": {"name": "s<ok>"}, "spec": {"selector": ', ok=ok), _by_turn(ok, selectors), F.lit("}}"))
    backend = '{"backend": {"service": {"name": "<x>"}}}'
    paths = ", ".join(backend.replace("<x>", x) for x in ("s<nx>", "gone", "s<ok>"))
    ingress = _json('{"kind": "Ingress", "metadata": {"name": "i<ok>"}, "spec": {"defaultBackend": {"service": {"name": "s<ok>"}}, "rules": [{"http": {"paths": [' + paths + "]}}]}}", **own)
    rows = orders(spark, sf_dir).select("graph", "ok", F.posexplode(F.array(_by_turn(ok, workloads), service, ingress)).alias("n", "json"))
    return rows.select("graph", (F.col("ok") * 3 + F.col("n")).alias("pos"), "json")


def workflow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, json): orders as jobs, lines as steps."""
    own = {"k": F.col("k"), "p": F.col("p"), "p3": F.col("p") % 3, "p4": F.col("p") % 4, "p5": F.col("p") % 5, "s3": F.col("s") % 3, "s5": F.col("s") % 5}
    steps = [
        _json('{"name": "S<k>", "run": "python -m pytest tests/unit/p<p>.py \'a b<p3>.py\' --x $HOME/y"}', **own),
        _json('{"uses": "actions/cache@v4", "with": {"path": "d<p5>\\nq", "key": "${{ secrets.K<p5> }}"}}', **own),
        _json('{"uses": "./local/l<s5>", "working-directory": "w/<s3>/"}', **own),
        _json('{"run": "build src/ && ./x<p4>.sh src", "env": {"B": "env.Q", "A": 1}, "timeout-minutes": <k>}', **own),
    ]
    lines = order_lines(spark, sf_dir).select("graph", "ok", "i", _by_turn(F.col("k"), steps).alias("step"))
    jobs = lines.groupBy("graph", "ok").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "step"))), lambda x: x["step"]), ",").alias("steps"))
    rows = orders(spark, sf_dir).join(jobs, ["graph", "ok"])
    needs = _by_turn(F.col("ok"), [_json('"needs": "o<nx>", ', nx=F.col("nx")), _json('"needs": ["o<nx>", "gone"], ', nx=F.col("nx")), F.lit("")])
    job = F.concat(_json('"o<ok>": {', ok=F.col("ok")), needs, F.lit('"steps": ['), "steps", F.lit("]}"))
    triggers = [F.lit('"push"'), F.lit('["push", 1, "a"]'), F.lit('{"z": null, "b": {}}')]
    on = _by_turn(F.substr("graph", F.lit(2)).cast("long"), triggers)
    return _gathered(rows, "ok", job).select("graph", F.concat(_json('{"name": "W<graph>", "on": ', graph=F.col("graph")), on, F.lit(', "jobs": {'), "parts", F.lit("}}")).alias("json"))
