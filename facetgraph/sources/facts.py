"""The driver's tables read as facts about code, a module for each customer.

A line of an order is a method (its part) of a class (its supplier), which calls the next
line of the order; an order is a scope, a job and a branch of the customer's graph. Names
are spelled in several ways, so that references have to be resolved. FACTS_SQL holds the
same tables as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetgraph.sources.tables import table


def _name(sign: str, key: Column | str) -> Column:
    return F.concat(F.lit(sign), (F.col(key) if isinstance(key, str) else key).cast("string"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, ok, i, pos, k, p, s, flag, p2, s2, k2): lines of orders in order, each with the next one of its order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("flag"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ok"), _name("c", "o_custkey").alias("graph"))
    by = Window.partitionBy("ok").orderBy("k", "p", "s", "flag")
    lines = lines.select("*", F.row_number().over(by).alias("i"), *[F.lead(c).over(by).alias(f"{c}2") for c in ("p", "s", "k")])
    return lines.join(orders, "ok").withColumn("pos", F.col("ok") * 100 + F.col("i")).select("graph", "ok", "i", "pos", "k", "p", "s", "flag", "p2", "s2", "k2")


def order_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each customer's graph: customer, orders, parts, suppliers; an edge a line, but one to each order."""
    order, part = _name("O", "ok"), _name("P", "p")
    tops = lines.groupBy("graph", "ok").agg((F.col("ok") * 100).alias("pos")).select("graph", F.lit("C").alias("src"), order.alias("dst"), "pos")
    parts = lines.select("graph", order.alias("src"), part.alias("dst"), "pos")
    suppliers = lines.select("graph", part.alias("src"), _name("S", "s").alias("dst"), "pos")
    edges = tops.union(parts).union(suppliers)
    return edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct(), edges


def classes(lines: DataFrame) -> DataFrame:
    """(graph, name, pos, bases): suppliers; bases are named as they are, with a prefix, or not at all."""
    s = F.col("s")
    bases = F.when(s % 3 == 0, F.array(_name("S", s - 1))).when(s % 3 == 1, F.array(_name("Base.S", s + 1), F.lit("Root"))).otherwise(F.array().cast("array<string>"))
    return lines.groupBy("graph", "s").agg(F.min("pos").alias("pos")).select("graph", _name("S", "s").alias("name"), "pos", bases.alias("bases"))


def methods(lines: DataFrame) -> DataFrame:
    """(graph, parent, name, qualified, visibility, pos): parts of suppliers."""
    grouped = lines.groupBy("graph", "s", "p").agg(F.min("pos").alias("pos"))
    kinds = F.array(*[F.lit(v) for v in ("unspecified", "public", "protected", "internal", "private")])
    return grouped.select("graph", _name("S", "s").alias("parent"), _name("p", "p").alias("name"), F.concat(_name("S", "s"), F.lit("."), _name("p", "p")).alias("qualified"), F.get(kinds, (F.col("p") % 5).cast("int")).alias("visibility"), "pos")


def calls(lines: DataFrame) -> DataFrame:
    """(graph, caller, parent, raw, pos): a line's call of the next one: in full, by its own name, by self, or of a part of it."""
    whole = F.concat(_name("S", "s2"), F.lit("."), _name("p", "p2"))
    raw = F.when(F.col("k2") % 4 == 0, whole).when(F.col("k2") % 4 == 1, _name("p", "p2")).when(F.col("k2") % 4 == 2, _name("self.p", "p2")).otherwise(F.concat(whole, F.lit(".run")))
    return lines.where("p2 IS NOT NULL").select("graph", F.concat(_name("S", "s"), F.lit("."), _name("p", "p")).alias("caller"), _name("S", "s").alias("parent"), raw.alias("raw"), "pos")


def linked_calls(lines: DataFrame) -> DataFrame:
    """calls(), and an order's first line calls that of its customer's next order, in full."""
    by = Window.partitionBy("graph").orderBy("ok")
    firsts = lines.where("i = 1").select("graph", "s", "p", "pos", F.lead("s").over(by).alias("s3"), F.lead("p").over(by).alias("p3")).where("s3 IS NOT NULL")
    whole = F.concat(_name("S", "s3"), F.lit("."), _name("p", "p3"))
    return calls(lines).union(firsts.select("graph", F.concat(_name("S", "s"), F.lit("."), _name("p", "p")), _name("S", "s"), whole, "pos"))


def objects(lines: DataFrame) -> DataFrame:
    """(graph, scope, name, type_name, pos, label, target): lines as objects of their order (the first one of the module), referring to the next."""
    scope = F.when(F.col("i") > 1, _name("o", "ok"))
    return lines.select("graph", scope.alias("scope"), _name("p", "p").alias("name"), _name("S", "s").alias("type_name"), "pos", F.col("flag").alias("label"), F.when(F.col("p2").isNotNull(), _name("p", "p2")).alias("target"))


def imports(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """(graph, module, component, reference, pos): suppliers as modules region.nation.supplier that import the next line's supplier (reference null: none)."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    homes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n")).join(nations, "n")
    module = lambda e: F.concat(_name("r", f"r{e}"), _name(".n", f"n{e}"), _name(".S", f"s{e}"))
    other = homes.select(*[F.col(c).alias(f"{c}2") for c in ("s", "n", "r")])
    rows = lines.join(homes, "s").join(other, "s2", "left")
    k, s2 = F.col("k2") % 4, F.col("s2")
    reference = (
        F.when(k == 0, module("2"))
        .when((k == 1) & (F.col("r") == F.col("r2")), F.concat(_name("..n", "n2"), _name(".S", "s2")))
        .when(k == 1, F.concat(_name("n", "n2"), F.lit(".x")))
        .when(k == 2, _name(".S", "s2"))
        .when(s2 % 2 == 0, F.concat(module("2"), F.lit(".sub")))
        .otherwise(F.concat(_name("ext", s2 % 7), F.lit(".lib")))
    )
    return rows.select("graph", module("").alias("module"), _name("n", "n").alias("component"), F.when(s2.isNotNull(), reference).alias("reference"), "pos")


def input_events(lines: DataFrame) -> DataFrame:
    """(graph, scope, component, handler, pos): orders as input events, handled by their first line's method under one of three names."""
    handler = F.when(F.col("ok") % 3 == 0, _name("self.p", "p")).when(F.col("ok") % 3 == 1, _name("p", "p")).otherwise(F.concat(_name("on_p", "p"), F.lit("_clicked")))
    return lines.where("i = 1").select("graph", _name("S", "s").alias("scope"), _name("o", "ok").alias("component"), handler.alias("handler"), "pos")


def workflow_steps(lines: DataFrame) -> DataFrame:
    """(graph, job, needs, i, command): orders as jobs of a customer's workflow, lines as steps; a job needs the order before its own number, if that is even."""
    verb = F.get(F.array(*[F.lit(v) for v in ("pytest", "build", "compile", "echo")]), ((F.col("k") + F.col("p")) % 4).cast("int"))
    needs = F.when(F.col("ok") % 2 == 0, F.array(_name("o", F.col("ok") - 2), _name("o", F.col("ok") - 4))).otherwise(F.array().cast("array<string>"))
    return lines.select("graph", _name("o", "ok").alias("job"), needs.alias("needs"), "i", F.concat(verb, _name(" x", F.col("p") % 10)).alias("command"))


# The same tables as SQL.
FACTS_SQL = """
l0 AS (
  SELECT l_orderkey AS ok, l_linenumber AS k, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag, row_number() OVER w AS i,
         lead(l_partkey) OVER w AS p2, lead(l_suppkey) OVER w AS s2, lead(l_linenumber) OVER w AS k2
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)
), ln AS (SELECT 'c' || o_custkey AS graph, l0.*, ok * 100 + i AS pos FROM l0 JOIN orders ON o_orderkey = ok),
oe AS (
  SELECT DISTINCT graph, 'C' AS src, 'O' || ok AS dst, ok * 100 AS pos FROM ln
  UNION ALL SELECT graph, 'O' || ok, 'P' || p, pos FROM ln UNION ALL SELECT graph, 'P' || p, 'S' || s, pos FROM ln
), onode AS (SELECT graph, src AS node FROM oe UNION SELECT graph, dst FROM oe),
cls AS (
  SELECT graph, 'S' || s AS name, min(pos) AS pos, CASE s % 3 WHEN 0 THEN ['S' || (s - 1)] WHEN 1 THEN ['Base.S' || (s + 1), 'Root'] ELSE [] END AS bases FROM ln GROUP BY graph, s
), mth AS (
  SELECT graph, 'S' || s AS parent, 'p' || p AS name, 'S' || s || '.p' || p AS qualified, ['unspecified', 'public', 'protected', 'internal', 'private'][1 + p % 5] AS visibility, min(pos) AS pos FROM ln GROUP BY graph, s, p
), cal AS (
  SELECT graph, 'S' || s || '.p' || p AS caller, 'S' || s AS parent, pos,
         CASE k2 % 4 WHEN 0 THEN 'S' || s2 || '.p' || p2 WHEN 1 THEN 'p' || p2 WHEN 2 THEN 'self.p' || p2 ELSE 'S' || s2 || '.p' || p2 || '.run' END AS raw
  FROM ln WHERE p2 IS NOT NULL
), lnk AS (
  SELECT graph, 'S' || s AS parent, 'S' || s || '.p' || p AS caller, pos, 'S' || s3 || '.p' || p3 AS raw
  FROM (SELECT *, lead(s) OVER w AS s3, lead(p) OVER w AS p3 FROM ln WHERE i = 1 WINDOW w AS (PARTITION BY graph ORDER BY ok)) WHERE s3 IS NOT NULL
), obj AS (
  SELECT graph, CASE WHEN i > 1 THEN 'o' || ok END AS scope, 'p' || p AS name, 'S' || s AS type_name, pos, flag AS label, 'p' || p2 AS target FROM ln
), home AS (SELECT s_suppkey AS s, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
imp AS (
  SELECT graph, 'r' || a.r || '.n' || a.n || '.S' || a.s AS module, 'n' || a.n AS component, pos,
         CASE WHEN s2 IS NULL THEN NULL WHEN k2 % 4 = 0 THEN 'r' || b.r || '.n' || b.n || '.S' || b.s
              WHEN k2 % 4 = 1 AND a.r = b.r THEN '..n' || b.n || '.S' || b.s WHEN k2 % 4 = 1 THEN 'n' || b.n || '.x' WHEN k2 % 4 = 2 THEN '.S' || b.s
              WHEN s2 % 2 = 0 THEN 'r' || b.r || '.n' || b.n || '.S' || b.s || '.sub' ELSE 'ext' || (s2 % 7) || '.lib' END AS reference
  FROM ln JOIN home a ON a.s = ln.s LEFT JOIN home b ON b.s = ln.s2
), inp AS (
  SELECT graph, 'S' || s AS scope, 'o' || ok AS component, pos, CASE ok % 3 WHEN 0 THEN 'self.p' || p WHEN 1 THEN 'p' || p ELSE 'on_p' || p || '_clicked' END AS handler FROM ln WHERE i = 1
), stp AS (
  SELECT graph, 'o' || ok AS job, CASE WHEN ok % 2 = 0 THEN ['o' || (ok - 2), 'o' || (ok - 4)] ELSE [] END AS needs, i,
         ['pytest', 'build', 'compile', 'echo'][1 + (k + p) % 4] || ' x' || (p % 10) AS command FROM ln
)
""".strip()
